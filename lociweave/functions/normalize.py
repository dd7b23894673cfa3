"""Normalisation of variant records: type, end, lengths, mate and the reason why a record takes no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.similarity import passes, quantized_qual, six_decimals, size_bin
from lociweave.options import SVTYPES

_NAMED = (*SVTYPES, "TRA")


def info(key: str) -> Column:
    return F.col("info")[key]


def first_int(text: Column) -> Column:
    """First number of a comma-separated list; missing or malformed is null."""
    return F.split_part(text, F.lit(","), F.lit(1)).try_cast("bigint")


def named_type(text: Column) -> Column:
    """A known type name in any case, else null."""
    up = F.upper(text)
    return F.when(up.isin(*_NAMED), up)


def alt_type(alt: Column) -> Column:
    symbolic = (F.length(alt) >= 3) & alt.startswith("<") & alt.endswith(">")
    breakend = (F.length(alt) >= 4) & ~alt.startswith("<") & (alt.contains("[") | alt.contains("]"))
    return F.when(symbolic, named_type(F.substring(alt, F.lit(2), F.length(alt) - 2))).when(breakend, F.lit("BND"))


def resolved_type(alt: Column, info_type: Column) -> Column:
    """The ALT's type; INFO's only where ALT names none."""
    return F.coalesce(alt_type(alt), named_type(info_type))


def bnd_mate(alt: Column) -> tuple[Column, Column]:
    """Contig and position between the first bracket and its next equal, split at the last colon; null where malformed."""
    opening = F.regexp_extract(alt, r"^[^\[\]]*\[([^\[]*)\[", 1)
    closing = F.regexp_extract(alt, r"^[^\[\]]*\]([^\]]*)\]", 1)
    inner = F.when(opening != "", opening).otherwise(closing)
    contig = F.regexp_extract(inner, r"^(.+):([0-9]+)$", 1)
    pos = F.regexp_extract(inner, r"^(.+):([0-9]+)$", 2).try_cast("bigint")
    good = (F.length(alt) >= 4) & (contig != "") & (pos > 0)
    return F.when(good, contig), F.when(good, pos)


def insertion_length(ref: Column, alt: Column, inslen: Column, svlen: Column, left: Column, right: Column) -> Column:
    """First positive of INSLEN, SVLEN, the sequence's surplus and the known flanks; else 0."""
    positive = lambda x: F.when(x > 0, x)
    plain = F.when(alt.rlike("^[ACGTNacgtn]+$"), (F.length(alt) - F.length(ref)).cast("long"))
    flanks = (F.length(F.coalesce(left, F.lit(""))) + F.length(F.coalesce(right, F.lit("")))).cast("long")
    return F.coalesce(positive(F.abs(inslen)), positive(F.abs(svlen)), positive(plain), positive(flanks), F.lit(0).cast("long"))


def added(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns in one projection, all computed from the columns before it."""
    return df.select(*(c for c in df.columns if c not in columns), *(c.alias(n) for n, c in columns.items()))


def bound(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column behind a generator of one row: filters on what follows from it are not pushed below, where each would copy all
    expressions that it rests on."""
    return df.withColumn(name, F.explode(F.array(column)))


def normalize(df: DataFrame, chr_set: tuple[str, ...] | None = None, known_contigs: list[str] | None = None) -> DataFrame:
    """Adds the normal columns of ``schema`` to records with chrom, pos, id, ref, alt, qual, filters, info and lineno.

    A record with more than one ALT raises an error when it is read. Skipped records stay, with ``skip_reason``.
    """
    alt = F.when(F.size("alt") > 1, F.raise_error(F.concat(F.lit("more than one ALT at "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string")))).otherwise(F.get("alt", F.lit(0)))
    df = added(df, {"_alt": alt, "_svlen": first_int(info("SVLEN")), "_inslen": first_int(info("INSLEN"))})
    mate, mate_pos = bnd_mate(F.col("_alt"))
    df = added(df, {
        "_type": F.coalesce(resolved_type(F.col("_alt"), info("SVTYPE")), F.lit("UNKNOWN")), "_chr2": mate, "_pos2": mate_pos,
        "_end": F.coalesce(first_int(info("END")), F.col("pos") + F.abs("_svlen")),
        "_ins": insertion_length(F.col("ref"), F.col("_alt"), F.col("_inslen"), F.col("_svlen"), info("LEFT_SVINSSEQ"), info("RIGHT_SVINSSEQ")),
    })
    kind = F.col("_type")
    unknown = F.lit(False) if known_contigs is None else ~F.col("chrom").isin(known_contigs)
    outside = F.lit(False) if chr_set is None else (kind == "BND") & ~F.col("_chr2").isin(*chr_set)
    reason = (
        F.when(unknown, "unknown_contig").when(kind == "UNKNOWN", "unresolvable_svtype").when(kind == "TRA", "unsupported_tra").when((kind == "BND") & F.col("_chr2").isNull(), "malformed_bnd")
        .when((kind == "INS") & (F.col("_ins") <= 0), "unresolvable_ins_len").when(~kind.isin("BND", "INS") & F.col("_end").isNull(), "unresolvable_end")
        .when(~kind.isin("BND", "INS") & (F.col("_end") <= F.col("pos")), "end_le_pos").when(outside, "chrom_filtered")
    )
    df = bound(df, "skip_reason", reason)
    kept = F.col("skip_reason").isNull()
    point = kind.isin("BND", "INS")
    length = F.when(kind == "INS", F.col("_ins")).when(kind != "BND", F.coalesce(F.abs("_svlen"), F.when(F.col("_end") > F.col("pos"), F.col("_end") - F.col("pos"))))
    nameless = F.coalesce(F.col("id").isin(".", ""), F.lit(True))
    out = added(df, {
        "svtype": F.when(kept, kind),
        "end_pos": F.when(kept, F.when(point, F.col("pos") + 1).otherwise(F.col("_end"))),
        "svlen": F.when(kept, length),
        "chr2": F.when(kept & (kind == "BND"), F.col("_chr2")),
        "pos2": F.when(kept & (kind == "BND"), F.col("_pos2")),
        "size_bin": F.when(kept, F.when(point, F.lit(0)).otherwise(size_bin(F.col("_end") - F.col("pos")))),
        "is_pass": passes(F.col("filters")),
        "qual_q": quantized_qual(F.col("qual")),
        "id": F.when(kept & nameless, synthesized_id(kind)).otherwise(F.col("id")),
    })
    return out.drop("_alt", "_type", "_chr2", "_pos2", "_svlen", "_end", "_ins", "_inslen")


def synthesized_id(kind: Column) -> Column:
    return F.concat_ws("_", "chrom", F.col("pos").cast("string"), kind, F.col("lineno").cast("string"))


def kept_info(keep: list[str], always: tuple[str, ...] = ()) -> Column:
    """INFO entries named in ``keep`` or ``always``, and those renamed to NAME_<caller>."""
    names = [*keep, *always]
    return F.map_filter("info", lambda k, _: F.lit(False) if not names else k.isin(names) | _any(k.startswith(f"{n}_") for n in names))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def info_text(info_map: str, names: list[str], floats: tuple[str, ...] = ()) -> Column:
    """K=V of the names present, joined by semicolons in the order asked for; '.' if none. ``floats`` get six decimals."""

    def one(n: str) -> Column:
        v = F.col(info_map)[n]
        shown = F.array_join(F.transform(F.split(v, ","), lambda x: six_decimals(x.cast("float").cast("double"))), ",") if n in floats else v
        return F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), shown))

    joined = F.concat_ws(";", *(one(n) for n in names))
    return F.when(joined == "", ".").otherwise(joined)


def symbolic_alt(svtype: Column) -> Column:
    return F.when(svtype.isin("DEL", "DUP", "INV", "INS"), F.concat(F.lit("<"), svtype, F.lit(">"))).otherwise(F.lit("."))


def skip_statistics(df: DataFrame) -> DataFrame:
    """Read records by caller and reason; kept ones count under 'kept'."""
    return df.groupBy("caller_idx", F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))

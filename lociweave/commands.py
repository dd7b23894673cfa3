"""The six commands over files: each reads callsets, composes the operators and writes one output."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions.aggspec import SIMILARITY, Aggregate, checked, parse_aggregate
from lociweave.functions.normalize import info_text, kept_info, skip_statistics, symbolic_alt
from lociweave.functions.similarity import signed_svlen
from lociweave.operators import annotate as an
from lociweave.operators import setops
from lociweave.operators.cluster import component_report
from lociweave.operators.collapse import collapse
from lociweave.operators.match import active, match, match_self, resolved
from lociweave.operators.merge import alternate, called, merge
from lociweave.options import ClusterOptions, MatchOptions
from lociweave.plans.runtime import materialize
from lociweave.sources.header import Field, collapse_sample, contig_union, output_header, single_samples, unify
from lociweave.sources.tsv import write_pairs
from lociweave.sources.vcf import assign_index, check_output, read_callset, read_header, record_line, show_number, write_callset

log = logging.getLogger("lociweave")


def _warn_missing(options: MatchOptions, known: set[str]) -> None:
    gone = [c for c in options.chrs or () if c not in known]
    if gone:
        log.warning("contigs in no header: %s", ", ".join(gone))


def _summary(df: DataFrame, verbose: bool) -> None:
    if verbose:
        for r in skip_statistics(df).orderBy("caller_idx", "reason").collect():
            log.info("input %d: %s %d", r["caller_idx"], r["reason"], r["n"])


def run_match(spark: SparkSession, a: str, b: str | None, output: str = "-", options: MatchOptions = MatchOptions(), info: list[str] | None = None, verbose: bool = False, index_needed: bool = False) -> int:
    """Pairs of two files, or of one with itself if ``b`` is None, as TSV. Returns the number of pairs."""
    left, header = read_callset(spark, a, 0, chr_set=options.chr_set, index_needed=index_needed)
    right, header_b = (left, header) if b is None else read_callset(spark, b, 1, chr_set=options.chr_set, index_needed=index_needed)
    _warn_missing(options, {*header.contigs, *header_b.contigs})
    _summary(left, verbose)
    pairs = match_self(left, options) if b is None else match(left, right, options)
    floats = lambda h: tuple(k for k in info or [] if k in h.info and h.info[k].type == "Float")
    if info:
        left = left.withColumn("info", info_text("info", info, floats(header)))
        right = left if b is None else right.withColumn("info", info_text("info", info, floats(header_b)))
    order = left.select(F.col("src_index").alias("src_a"), "chrom_idx")
    full = resolved(pairs, left, right, ("id", "info") if info else ("id",)).join(order, "src_a")
    return write_pairs(full, output, options.metric, bool(info))


def run_annotate(spark: SparkSession, a: str, db: str, expressions: list[str], output: str, options: MatchOptions = MatchOptions(), overwrite: bool = False, write_index: bool = False, verbose: bool = False, index_needed: bool = False) -> int:
    """File ``a`` with one INFO field per expression, aggregated over the matches in ``db``."""
    check_output(output)
    left, header = read_callset(spark, a, 0, chr_set=options.chr_set, index_needed=index_needed)
    right, header_db = read_callset(spark, db, 1, chr_set=options.chr_set, index_needed=index_needed)
    types = {k: f.type for k, f in header_db.info.items()}
    specs: list[Aggregate] = checked([parse_aggregate(x) for x in expressions], types, set(read_header(spark, a).info), overwrite)
    _warn_missing(options, {*header.contigs, *header_db.contigs})
    _summary(left, verbose)
    shown = left if options.chrs is None else left.where(F.col("chrom").isin(*options.chrs))
    found = an.written_back(an.annotate(shown, right, specs, options, types), specs, types)
    out = header.pruned(options.chr_set)
    out.other.append(f"##match_metric={options.metric}")
    for s in specs:
        number, kind = s.number_and_type("Float" if s.source == SIMILARITY else types.get(s.source, "String"))
        out.info[s.out] = Field(s.out, number, kind, f"{s.func} of {s.source} over matched records")
    return write_callset(found.orderBy("chrom_idx", "src_index").select(record_line("samples").alias("line")), out, output, write_index=write_index)


def run_setop(spark: SparkSession, kind: str, a: str, b: str, output: str, options: MatchOptions = MatchOptions(), write_index: bool = False, verbose: bool = False, index_needed: bool = False) -> int:
    """Records of ``a`` with (``intersect``) or without (``setdiff``) a match in ``b``, verbatim."""
    check_output(output)
    left, header = read_callset(spark, a, 0, chr_set=options.chr_set, index_needed=index_needed)
    right, header_b = read_callset(spark, b, 1, chr_set=options.chr_set, index_needed=index_needed)
    _warn_missing(options, {*header.contigs, *header_b.contigs})
    _summary(left, verbose)
    shown = left if options.chrs is None else left.where(F.col("chrom").isin(*options.chrs))
    kept = {"intersect": setops.intersect, "setdiff": setops.setdiff}[kind](shown, right, options)
    return write_callset(kept.orderBy("chrom_idx", "src_index"), header.pruned(options.chr_set), output, "raw", write_index)


def _fresh_name(name: Column, renames: dict[str, str]) -> Column:
    return reduce(lambda c, r: F.when(name == r[0], F.lit(r[1])).otherwise(c), renames.items(), name)


def _renamed(records: DataFrame, info: dict[str, str], formats: dict[str, str]) -> DataFrame:
    """The records with INFO keys and FORMAT names replaced."""
    if info:
        records = records.withColumn("info", F.transform_keys("info", lambda k, _: _fresh_name(k, info)))
    if formats:
        records = records.withColumn("format", F.transform("format", lambda x: _fresh_name(x, formats)))
    return records


def _format_names(formats: list[str], renames: list[dict[str, str]]) -> list[str]:
    """The names under which the wanted fields are kept: a renamed field has one for each caller that declares it."""
    return [n for k in formats for n in list(dict.fromkeys(r[k] for r in renames if k in r)) or [k]]


def _warn_large(records: DataFrame, edges: DataFrame) -> None:
    """Names every component that agglomeration may find large, with the caller that most of its records come from."""
    for r in component_report(records, edges).orderBy(F.desc("n"), "component").toLocalIterator():
        log.warning("large component on %s, %s: %d records, %d pairs; caller %d has %.1f %% of them; overlapping noise may chain them", r["chrom"], r["svtype"], r["n"], r["n_edges"], r["caller_idx"], 100 * r["share"])


def _union(spark: SparkSession, paths: list[str], names: list[str], options: MatchOptions, info: list[str] | None, formats: list[str], verbose: bool, index_needed: bool):
    headers = [read_header(spark, p) for p in paths]
    contigs = contig_union(headers, options.chr_set)
    unified = unify([h.with_standard_info() for h in headers], names, info, formats)
    parts = []
    for i, p in enumerate(paths):
        df, _ = read_callset(spark, p, i, list(contigs), options.chr_set, index_needed)
        parts.append(_renamed(df, unified.info_renames[i], unified.format_renames[i]))
    records = reduce(DataFrame.unionByName, parts)
    _summary(records, verbose)
    _warn_missing(options, set(contigs))
    return headers, unified, materialize(assign_index(active(records, options)), "indexed")


def _authoritative(svtype_always: bool, keep: list[str]) -> Column:
    """INFO with the resolved type, signed length, end and mate in place of the input's."""
    point = F.col("svtype") == "BND"
    own = {
        "SVTYPE": F.col("svtype"), "SVLEN": F.when(~point, signed_svlen(F.col("svtype"), F.col("svlen")).cast("string")), "END": F.when(~point, F.col("end_pos").cast("string")),
        "CHR2": F.col("chr2"), "POS2": F.col("pos2").cast("string"),
    }
    own = {k: v for k, v in own.items() if svtype_always or k in keep}
    if not own:
        return kept_info(keep)
    fresh = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k in own)), F.array(*own.values())), lambda _, v: v.isNotNull())
    rest = F.map_filter(kept_info(keep), lambda k, _: ~k.isin(*own))
    return F.map_concat(fresh, rest)


def _sample_values(formats: list[str]) -> Column:
    """The first sample's values of the named fields, '.' where absent."""
    values = F.split(F.get("samples", F.lit(0)), ":")
    return F.array(*(F.coalesce(F.get(values, F.array_position("format", k).cast("int") - 1), F.lit("./." if k == "GT" else ".")) for k in formats))


def _alleles_shown(reconstruct: bool) -> Column:
    kept = F.col("svtype").isin("BND", "INS")
    blank = F.array(symbolic_alt(F.col("svtype"))) if reconstruct else F.array().cast("array<string>")
    return F.when(kept & (F.size("alt") > 0) & (F.get("alt", F.lit(0)) != "."), F.col("alt")).otherwise(blank)


def run_collapse(spark: SparkSession, inputs: list[tuple[str, str]], output: str, options: ClusterOptions = ClusterOptions(), info: list[str] | None = None, formats: list[str] | None = None, write_index: bool = False, command: str = "", verbose: bool = False, keep_alt: bool = False, index_needed: bool = False) -> int:
    """One record per cluster of the (name, path) callers' records of a sample. DEL, DUP and INV lose their ALT unless ``keep_alt``."""
    if not inputs:
        raise ValueError("collapse needs an input")
    names, paths, formats = [n for n, _ in inputs], [p for _, p in inputs], ["GT"] if formats is None else formats
    headers, unified, records = _union(spark, paths, names, options.match, info, formats, verbose, index_needed)
    wanted, formats = formats, _format_names(formats, unified.format_renames)
    sample = collapse_sample(headers) if formats else []
    keep = ["SVTYPE", "SVLEN", "END", "CHR2", "POS2"] if info is None else info
    found = collapse(records, names, options, _warn_large)
    extra = (Field("CALLERS", ".", "String", "Callers in the cluster, the representative's first"), Field("N_CALLERS", "1", "Integer", "Distinct callers in the cluster"), Field("N_MERGED", "1", "Integer", "Records in the cluster"))
    own = F.map_from_arrays(F.array(*(F.lit(f.id) for f in extra)), F.array(F.col("callers"), F.col("n_callers").cast("string"), F.col("n_merged").cast("string")))
    found = found.withColumn("info", F.map_concat(F.map_filter(_authoritative(False, keep), lambda k, _: ~k.isin(*(f.id for f in extra))), own))
    found = found.withColumn("alt", _alleles_shown(keep_alt)).withColumn("ref", F.when(F.col("svtype").isin("BND", "INS"), F.col("ref")).otherwise(F.lit("N")))
    if sample:
        found = found.withColumns({"samples": F.array(F.array_join(_sample_values(formats), ":")), "format": F.array(*(F.lit(k) for k in formats))})
    else:
        found = found.withColumn("samples", F.array().cast("array<string>"))
    header = output_header(headers, unified, keep, wanted, sample, extra, command, options.match.chr_set)
    return write_callset(found.orderBy("chrom_idx", "pos", "src_index").select(record_line("samples").alias("line")), header, output, write_index=write_index)


def run_merge(spark: SparkSession, paths: list[str], output: str, options: ClusterOptions = ClusterOptions(), info: list[str] | None = None, formats: list[str] | None = None, missing_to_ref: bool = False, write_index: bool = False, command: str = "", verbose: bool = False, index_needed: bool = False) -> int:
    """The cohort table of single-sample files: one row per cluster with a column per sample and AC, AN and AF."""
    samples = single_samples([read_header(spark, p) for p in paths])
    formats = list(formats or ["GT"])
    formats = formats if "GT" in formats else ["GT", *formats]
    headers, unified, records = _union(spark, paths, samples, options.match, info, formats, verbose, index_needed)
    wanted, formats = formats, _format_names(formats, unified.format_renames)
    keep = list(dict.fromkeys(["SVTYPE", "SVLEN", "END", "CHR2", "POS2", *(info or [])]))
    named = F.array(*(F.lit(s) for s in samples))
    records = records.withColumns({"sample": F.get(named, F.col("caller_idx")), "gt": F.array_join(_sample_values(formats), ":")})
    has_callers = any("CALLERS" in h.info for h in headers)
    if has_callers:
        records = records.withColumn("callers", F.col("info")["CALLERS"])
    wide = materialize(merge(records, samples, options, watch=_warn_large), "cohort")
    lost = wide.agg(F.sum("collisions")).first()[0]
    if lost:
        log.warning("%d records were passed over for another record of the same sample in their cluster", lost)
    # ``gt`` carries all wanted FORMAT values of a sample; the genotype is where GT stands among them.
    at = formats.index("GT")
    genotype = lambda s: F.get(F.split(s, ":"), F.lit(at))
    ploidy = F.array_max(F.transform(F.map_values("genotypes"), lambda s: F.size(F.split(genotype(s), r"[/|]"))))
    absent_gt = F.array_join(F.array_repeat(F.lit("0"), ploidy), "/") if missing_to_ref else F.lit("./.")
    absent = F.concat_ws(":", *(absent_gt if k == "GT" else F.lit(".") for k in formats))
    cells = F.array(*(F.coalesce(F.col("genotypes")[s], absent) for s in samples))
    wide = wide.withColumn("samples", cells).withColumn("_gts", F.transform("samples", genotype))
    total = lambda of: F.aggregate("_gts", F.lit(0), lambda a, g: a + of(g))
    wide = wide.withColumns({"ac": total(alternate), "an": total(called)})
    af = F.when(F.col("an") > 0, (F.col("ac") / F.col("an")).cast("float"))
    own = {"AC": F.col("ac").cast("string"), "AN": F.col("an").cast("string"), "AF": show_number(af)}
    extra = [Field("AC", "A", "Integer", "Alternate alleles"), Field("AN", "1", "Integer", "Called alleles"), Field("AF", "A", "Float", "Share of alternate alleles")]
    if has_callers:
        own |= {"CALLERS": F.col("callers"), "N_CALLERS": F.col("n_callers").cast("string")}
        extra += [Field("CALLERS", ".", "String", "Callers of the cluster's records"), Field("N_CALLERS", "1", "Integer", "Number of callers")]
    fresh = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k in own)), F.array(*own.values())), lambda _, v: v.isNotNull())
    wide = wide.withColumn("info", F.map_concat(F.map_filter(_authoritative(True, keep), lambda k, _: ~k.isin(*own)), fresh))
    wide = wide.withColumns({"alt": _alleles_shown(True), "ref": F.when(F.col("svtype").isin("BND", "INS"), F.col("ref")).otherwise(F.lit("N")), "format": F.array(*(F.lit(k) for k in formats))})
    header = output_header(headers, unified, keep, wanted, samples, tuple(extra), command, options.match.chr_set)
    return write_callset(wide.orderBy("chrom_idx", "pos", "src_index").select(record_line("samples").alias("line")), header, output, write_index=write_index)

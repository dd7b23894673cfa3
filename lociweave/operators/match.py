"""Fuzzy joins of callsets: intervals by overlap, breakends by proximity, insertions by proximity and length.

Catalyst has no interval join, so each lane adds equi-join keys that every qualifying pair shares exactly once, and leaves the
exact predicate as the join's condition. A record of the right side has one key; a record of the left side is repeated over the few
keys where a partner can lie. Keys are fine (contig, type, size class, tile), so the shuffle spreads along the genome, and adaptive
skew splitting takes care of hotspots; nothing is broadcast by hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.similarity import breakend_proximity, insertion_similarity, jaccard, reciprocal_overlap, size_bin
from lociweave.options import INTERVAL_TYPES, MatchOptions

PAIR = ("src_a", "src_b", "chrom", "svtype", "pos_a", "pos_b", "sim")


def _tile_width(bin_: Column) -> Column:
    return F.pow(F.lit(2.0), bin_ + 9).cast("long")


def _self(condition: Column, unordered: bool) -> Column:
    return condition & (F.col("src_a") < F.col("src_b")) if unordered else condition


def interval_keys(a: DataFrame, t: float) -> DataFrame:
    """The intervals of ``a``, repeated over every (size_bin, tile) where a partner at threshold ``t`` can start.

    Either metric is at most min/max of the two lengths, so a partner's length lies within [t*len, len/t]; and its start lies
    within [pos - (1-t)*len/t, pos + (1-t)*len]. Both ranges, widened by one, give the size classes and tiles to visit; a class holds
    no partner that starts more than its greatest length before the record, so the keys of a record grow with 1/t, not with its square.
    """
    length = (F.col("end_pos") - F.col("pos")).cast("double")
    left = a.where(F.col("svtype").isin(*INTERVAL_TYPES) & (F.col("end_pos") > F.col("pos")))
    left = left.select(F.col("src_index").alias("src_a"), "chrom", "svtype", F.col("pos").alias("pos_a"), F.col("end_pos").alias("end_a"), length.alias("_len"))
    first, last = size_bin(F.floor(F.col("_len") * t)), size_bin(F.ceil(F.col("_len") / t))
    left = left.withColumn("size_bin", F.explode(F.sequence(first, last)))
    width = _tile_width(F.col("size_bin"))
    low = F.floor((F.col("pos_a") - F.least(F.col("_len") * ((1 - t) / t), width.cast("double")) - 1) / width)
    high = F.floor((F.col("pos_a") + F.col("_len") * (1 - t) + 1) / width)
    return left.withColumn("tile", F.explode(F.sequence(low, high))).drop("_len")


def interval_pairs(a: DataFrame, b: DataFrame, options: MatchOptions, unordered: bool = False) -> DataFrame:
    """Pairs of DEL, DUP or INV at or above the threshold."""
    t = options.threshold
    left = interval_keys(a, t)
    right = b.where(F.col("svtype").isin(*INTERVAL_TYPES) & (F.col("end_pos") > F.col("pos")))
    right = right.select(F.col("src_index").alias("src_b"), "chrom", "svtype", F.col("pos").alias("pos_b"), F.col("end_pos").alias("end_b"), size_bin(F.col("end_pos") - F.col("pos")).alias("size_bin"))
    right = right.withColumn("tile", F.floor(F.col("pos_b") / _tile_width(F.col("size_bin"))))
    ends = [F.col(c) for c in ("pos_a", "end_a", "pos_b", "end_b")]
    sim = (jaccard if options.metric == "jaccard" else reciprocal_overlap)(*ends)
    near = _self((F.col("pos_b") < F.col("end_a")) & (F.col("end_b") > F.col("pos_a")), unordered)
    return left.join(right, ["chrom", "svtype", "size_bin", "tile"]).where(near).withColumn("sim", sim).where(F.col("sim") >= t).select(*PAIR)


def breakend_pairs(a: DataFrame, b: DataFrame, options: MatchOptions, unordered: bool = False) -> DataFrame:
    """Pairs of BND on the same contigs, both ends strictly within the slop; direction counts."""
    slop = options.bnd_slop
    home = lambda: F.floor(F.col("pos") / slop)
    left = a.where("svtype = 'BND'").select(F.col("src_index").alias("src_a"), "chrom", "chr2", F.col("pos").alias("pos_a"), F.col("pos2").alias("mate_a"), F.explode(F.sequence(home() - 1, home() + 1)).alias("tile"))
    right = b.where("svtype = 'BND'").select(F.col("src_index").alias("src_b"), "chrom", "chr2", F.col("pos").alias("pos_b"), F.col("pos2").alias("mate_b"), home().alias("tile"))
    near = (F.abs(F.col("pos_a") - F.col("pos_b")) < slop) & (F.abs(F.col("mate_a") - F.col("mate_b")) < slop)
    sim = breakend_proximity(F.col("pos_a"), F.col("mate_a"), F.col("pos_b"), F.col("mate_b"), slop)
    return left.join(right, ["chrom", "chr2", "tile"]).where(_self(near, unordered)).select("src_a", "src_b", "chrom", F.lit("BND").alias("svtype"), "pos_a", "pos_b", sim.alias("sim")).where("sim > 0").select(*PAIR)


def insertion_pairs(a: DataFrame, b: DataFrame, options: MatchOptions, unordered: bool = False) -> DataFrame:
    """Pairs of INS strictly within the slop whose similarity reaches ``min_ins_sim``."""
    slop = options.ins_slop
    home = lambda: F.floor(F.col("pos") / slop)
    left = a.where("svtype = 'INS'").select(F.col("src_index").alias("src_a"), "chrom", F.col("pos").alias("pos_a"), F.col("svlen").alias("len_a"), F.explode(F.sequence(home() - 1, home() + 1)).alias("tile"))
    right = b.where("svtype = 'INS'").select(F.col("src_index").alias("src_b"), "chrom", F.col("pos").alias("pos_b"), F.col("svlen").alias("len_b"), home().alias("tile"))
    near = F.abs(F.col("pos_a") - F.col("pos_b")) < slop
    sim = insertion_similarity(F.col("pos_a"), F.col("len_a"), F.col("pos_b"), F.col("len_b"), slop)
    return left.join(right, ["chrom", "tile"]).where(_self(near, unordered)).select("src_a", "src_b", "chrom", F.lit("INS").alias("svtype"), "pos_a", "pos_b", sim.alias("sim")).where(F.col("sim") >= options.min_ins_sim).select(*PAIR)


LANES = (interval_pairs, breakend_pairs, insertion_pairs)


def active(df: DataFrame, options: MatchOptions) -> DataFrame:
    """Records that take part: not skipped, on an active contig, the mate within the contig universe."""
    if "skip_reason" in df.columns:
        df = df.where(F.col("skip_reason").isNull())
    if options.chrs is not None:
        df = df.where(F.col("chrom").isin(*options.chrs))
    if options.chr_set is not None:
        df = df.where((F.col("svtype") != "BND") | F.col("chr2").isin(*options.chr_set))
    return df


def match(a: DataFrame, b: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """All pairs of a record of ``a`` and a similar record of ``b``: src_a, src_b, chrom, svtype, pos_a, pos_b, sim."""
    a, b = active(a, options), active(b, options)
    return reduce(DataFrame.unionByName, (lane(a, b, options) for lane in LANES))


def match_self(a: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Every unordered pair of similar records once, the smaller src_index first."""
    a = active(a, options)
    return reduce(DataFrame.unionByName, (lane(a, a, options, unordered=True) for lane in LANES))


def resolved(pairs: DataFrame, a: DataFrame, b: DataFrame, carry: tuple[str, ...] = ("id",)) -> DataFrame:
    """Pairs with further columns of their records, suffixed _a and _b."""
    left = a.select(F.col("src_index").alias("src_a"), *(F.col(c).alias(f"{c}_a") for c in carry))
    right = b.select(F.col("src_index").alias("src_b"), *(F.col(c).alias(f"{c}_b") for c in carry))
    return pairs.join(left, "src_a").join(right, "src_b")

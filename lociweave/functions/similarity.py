"""Similarity measures as column expressions; every division is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_length(pos_a: Column, end_a: Column, pos_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end_a, end_b) - F.greatest(pos_a, pos_b))


def reciprocal_overlap(pos_a: Column, end_a: Column, pos_b: Column, end_b: Column) -> Column:
    """Shared length over the longer length; 0 for empty intervals and for those that only touch."""
    longer = F.greatest(end_a - pos_a, end_b - pos_b)
    proper = (end_a > pos_a) & (end_b > pos_b)
    return F.when(proper, overlap_length(pos_a, end_a, pos_b, end_b).cast("double") / longer.cast("double")).otherwise(F.lit(0.0))


def jaccard(pos_a: Column, end_a: Column, pos_b: Column, end_b: Column) -> Column:
    """Shared length over the hull; 0 for empty intervals and for those that only touch."""
    hull = F.greatest(end_a, end_b) - F.least(pos_a, pos_b)
    proper = (end_a > pos_a) & (end_b > pos_b)
    return F.when(proper, overlap_length(pos_a, end_a, pos_b, end_b).cast("double") / hull.cast("double")).otherwise(F.lit(0.0))


def breakend_proximity(pos_a: Column, mate_a: Column, pos_b: Column, mate_b: Column, slop: int) -> Column:
    """1 for equal ends, falling to 0 as the two distances reach the slop."""
    return (F.lit(2 * slop) - F.abs(pos_a - pos_b) - F.abs(mate_a - mate_b)).cast("double") / F.lit(2.0 * slop)


def insertion_similarity(pos_a: Column, len_a: Column, pos_b: Column, len_b: Column, slop: int) -> Column:
    """Geometric mean of closeness and of the ratio of lengths."""
    close = (F.lit(slop) - F.abs(pos_a - pos_b)).cast("double") / F.lit(float(slop))
    return F.sqrt(close * (F.least(len_a, len_b).cast("double") / F.greatest(len_a, len_b).cast("double")))


def size_bin(length: Column) -> Column:
    """0 below 512, then one bin for each doubling."""
    return F.when(length < 512, F.lit(0)).otherwise(F.length(F.bin(length)) - 9).cast("int")


def bin_range(n: int) -> tuple[int, int]:
    """Lengths of a bin, from and below."""
    return (0, 512) if n == 0 else (1 << (n + 8), 1 << (n + 9))


def signed_svlen(svtype: Column, length: Column) -> Column:
    return F.when(svtype == "DEL", -length).when(svtype.isin("DUP", "INS", "INV"), length).otherwise(F.lit(0).cast("long"))


def quantized_qual(qual: Column) -> Column:
    """Quarter steps in 16 bits; null is 0."""
    return F.coalesce(F.least(F.greatest(F.floor(qual.cast("double") * 4), F.lit(0)), F.lit(65535)), F.lit(0)).cast("int")


def passes(filters: Column) -> Column:
    """No filter at all, or PASS alone."""
    return F.coalesce((F.size(filters) <= 0) | (filters == F.array(F.lit("PASS"))), F.lit(True))


def six_decimals(x: Column) -> Column:
    """Text with six decimals; exact ties go to the even digit."""
    return F.format_string("%.6f", F.bround(x, 6))

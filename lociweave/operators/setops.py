"""Set operations under fuzzy equality; records pass through as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators.match import match
from lociweave.options import MatchOptions


def _matched(a: DataFrame, b: DataFrame, options: MatchOptions) -> DataFrame:
    return match(a, b, options).select(F.col("src_a").alias("src_index"))


def intersect(a: DataFrame, b: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Records of ``a`` with at least one match in ``b``."""
    return a.join(_matched(a, b, options), "src_index", "left_semi")


def setdiff(a: DataFrame, b: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Records of ``a`` with no match in ``b``, skipped records included."""
    return a.join(_matched(a, b, options), "src_index", "left_anti")

"""Pairs as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions.similarity import six_decimals
from lociweave.sources.vcf import _opened

COLUMNS = ("CHROM_A", "POS_A", "ID_A", "CHROM_B", "POS_B", "ID_B", "SVTYPE", "SIMILARITY")


def pair_lines(pairs: DataFrame, with_info: bool) -> DataFrame:
    """line: pairs with id_a, id_b (and info_a, info_b) in the order of contigs, positions and records of the first side."""
    cols = ["chrom", F.col("pos_a").cast("string"), "id_a", "chrom", F.col("pos_b").cast("string"), "id_b", "svtype", six_decimals(F.col("sim")), *(["info_a", "info_b"] if with_info else [])]
    return pairs.orderBy("chrom_idx", "pos_a", "src_a", "pos_b", "src_b").select(F.concat_ws("\t", *cols).alias("line"))


def write_pairs(pairs: DataFrame, path: str, metric: str, with_info: bool = False) -> int:
    """One file with a metric line, a header and eight columns, ten with INFO; also for no pairs."""
    n = 0
    with _opened(path) as f:
        f.write(f"##match_metric={metric}\n".encode())
        f.write(("\t".join(COLUMNS + (("INFO_A", "INFO_B") if with_info else ())) + "\n").encode())
        for row in pair_lines(pairs, with_info).toLocalIterator():
            f.write((row["line"] + "\n").encode())
            n += 1
    return n

"""Shards cut from a Hilbert curve over several quantised metadata columns, in DataFrame operations only.

Each dimension is quantised to ``2**bits`` levels: null, the most frequent values of a category in their order, and all
others; or steps of the size. Rows are ordered by the curve index of their cell, so neighbouring shards cover neighbouring
cells and a reader prunes shards by the ranges of columns that ``shard_manifest`` lists. The order has no global sort: counts per cell (at most ``2**(bits * dimensions)`` rows, whatever the input) give each cell its first rank,
a cell with more than ``run_rows`` rows is divided by hash range into runs, counts per run give each run its first rank,
and a row number within a run does the rest. The largest task therefore holds about ``run_rows`` rows even if one cell
holds most of the table. The cut is by rank, so row counts of shards differ by at most one.

Defined results: null metadata take level 0, a null text has size 1 and crc 0, repeated rows are separate rows with
places of their own, an empty table gives no rows. Outputs replace input columns of the same name; all other input columns
keep their values, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.plans.runtime import materialize

BITS = 4
#: Columns whose most frequent values are levels of the curve's first axes; the last axis is the text's size.
CATEGORIES = ("lang", "source")
RUN_ROWS = 100_000
_HASH_BITS = 30
_CRC_FACTOR, _ID_FACTOR = 1_640_531, 663_608_941


def category_levels(docs: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """The most frequent values of a column, one level each, in the order of the values; the last level is left for all others.

    Counting covers all rows; only the ``2**bits - 2`` values that get a level of their own come to the driver. Level 0 is null.
    """
    value = F.col(column).cast("string")
    counts = docs.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["value"] for r in counts.orderBy(F.desc("n"), "value").limit((1 << bits) - 2).collect())


def category_level(column: Column, values: list[str], bits: int = BITS) -> Column:
    """0 for null, from 1 on the place among ``values``, the last level for values not among them."""
    place = F.array_position(F.array(*(F.lit(v) for v in values)).cast("array<string>"), column.cast("string")).cast("int")
    return F.coalesce(F.when(place > 0, place).when(column.isNotNull(), F.lit((1 << bits) - 1)), F.lit(0))


def size_steps(bits: int = BITS) -> list[int]:
    """The least size of each level but 0: two levels for each doubling from 64 bytes on."""
    return [math.ceil(64 * 2 ** (i / 2)) for i in range(1, 1 << bits)]


def size_level(size: Column, bits: int = BITS) -> Column:
    return sum((F.when(size >= step, 1).otherwise(0) for step in size_steps(bits)), F.lit(0)).cast("int")


def hilbert_index(cells: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Adds the curve index of the integer coordinates ``dims``: reflect and exchange axes from the top bit down, Gray-code, interleave."""
    n = len(dims)
    x = [f"_x{i}" for i in range(n)]
    df = cells.select("*", *(F.col(d).cast("int").alias(x[i]) for i, d in enumerate(dims)))
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            low = F.lit(q - 1)
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(low)
            on = F.col(x[i]).bitwiseAND(F.lit(q)) != 0
            df = df.withColumns({"_t": F.when(on, low).otherwise(swap), "_s": F.when(on, F.lit(0)).otherwise(swap)})
            df = df.withColumn(x[0], F.col(x[0]).bitwiseXOR(F.col("_t")))
            if i:
                df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col("_s")))
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    flip = F.lit(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_t", flip)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            bit = F.shiftright(F.col(c).bitwiseXOR(F.col("_t")), b).bitwiseAND(F.lit(1))
            index = index * 2 + bit
    return df.withColumn(out, index).drop(*x, "_t", "_s")


def _measured(docs: DataFrame, carry: list[str], bits: int) -> DataFrame:
    """The carried columns wrapped as ``row``, so that no working column meets one of theirs, with size, crc, levels and a hash."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    levels = [category_level(F.col(c), category_levels(docs, c, bits), bits) for c in CATEGORIES]
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("doc_id"), size.alias("size"), crc.alias("text_crc32"), *(v.alias(f"d{i}") for i, v in enumerate([*levels, size_level(size, bits)])), _hash("doc_id", crc).alias("u")
    )


def _hash(doc_id: str, crc: Column) -> Column:
    """An even spread of ids and texts over the hash range; ids in sequence are spread too. No id counts as 0."""
    span = F.lit(1 << _HASH_BITS)
    return F.pmod(F.pmod(crc, span) * _CRC_FACTOR + F.pmod(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), span) * _ID_FACTOR, span)


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = BITS, run_rows: int = RUN_ROWS, keep_columns: bool = True) -> DataFrame:
    """Every row of ``docs`` with size, text_crc32, curve (index), shard and slot; only ``doc_id`` beside them unless ``keep_columns``."""
    added = {"size", "text_crc32", "curve", "shard", "slot"}
    dims = ["d0", "d1", "d2"]
    carry = [c for c in docs.columns if c.lower() not in added] if keep_columns else ["doc_id"]
    rows = _measured(docs, carry, bits)
    narrow = rows if keep_columns else materialize(rows, "measured")
    if not keep_columns:
        rows = narrow
    cells = hilbert_index(narrow.groupBy(*dims).agg(F.count(F.lit(1)).alias("n")), dims, bits, "curve")
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**(bits * 3) rows
    cells = materialize(cells.select(*dims, "curve", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first"), F.ceil(F.col("n") / run_rows).alias("runs"), "n"), "cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    run = F.expr(f"(u * runs) div {1 << _HASH_BITS}").alias("run")
    side = F.broadcast(cells.drop("n"))
    runs = narrow.select(*dims, "u").join(side, dims).select("curve", "first", run).groupBy("curve", "run").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    inside = Window.partitionBy("curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("curve", "run", (F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))
    placed = rows.join(side, dims).select("row", "doc_id", "size", "text_crc32", "curve", "u", run).join(runs, ["curve", "run"])
    order = Window.partitionBy("curve", "run").orderBy("u", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.col("base") + F.row_number().over(order) - 1)
    ranked = ranked.withColumn("shard", F.expr(f"int((rank * {shards}) div {total})"))
    return ranked.select("row.*", "size", "text_crc32", "curve", "shard", F.expr(f"rank - ((shard * {total}L + {shards - 1}) div {shards})").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard under ``path``, rows in slot order, so that a reader opens only the shards it needs."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """For each shard its rows, bytes, curve range and the range of each named column: what a reader prunes by.

    ``nulls_c`` counts the rows of a shard whose column c is null, which no range tells.
    """
    ranges = [f.alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min(c)), ("max", F.max(c)), ("nulls", F.count_if(F.col(c).isNull())))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("curve").alias("min_curve"), F.max("curve").alias("max_curve"), *ranges)


def needed_shards(manifest: DataFrame, ranges: dict) -> DataFrame:
    """shard of every shard that may hold a row whose named columns all lie within their (low, high)."""
    for c, (low, high) in ranges.items():
        manifest = manifest.where((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return manifest.select("shard")

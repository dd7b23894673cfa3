"""Shared pieces of the text operators: input columns, id splits, batch iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.plans.runtime import BROADCAST_ROWS

BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not use, in any case of letters."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id gives null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def held_out(column: str, modulus: int, kept_back: int) -> Column:
    """True for rows that no model may learn from; a null id counts as a training row."""
    return F.coalesce(remainder(column, modulus) == kept_back, F.lit(False))


def hash_sample(df: DataFrame, rows: dict, by: str, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """At most ``rows[g]`` rows of each group g of ``by``, those with the smallest hash of ``key``; and the groups' sizes.

    A cut of the hash range, set from the counts, thins each group to little more than its share before rows are ranked, so
    what reaches the ranking tasks does not grow with the input.
    """
    sizes = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect() if r[by] in rows}
    span = 1 << 30
    hashed = df.withColumn("_u", F.pmod(F.xxhash64(key), F.lit(span)))
    cut, most = F.lit(0), F.lit(0)
    for g, n in sizes.items():
        cut = F.when(F.col(by) == g, F.lit(int(span * min(1.0, (1.3 * rows[g] + 200) / n)))).otherwise(cut)
        most = F.when(F.col(by) == g, F.lit(rows[g])).otherwise(most)
    ranked = hashed.where(F.col("_u") < cut).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_u", key)))
    return ranked.where(F.col("_r") <= most).drop("_u", "_r"), sizes


def as_bytes(docs: DataFrame, *columns, text: str = "text") -> DataFrame:
    """``columns`` plus the text as UTF-8 bytes in ``raw``; a null text becomes empty."""
    return docs.select(*columns, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))


def small_batches(spark: SparkSession) -> None:
    """Hands texts to Python in batches of ``BATCH_ROWS`` unless the session sets a size of its own.

    Spark's default of 10,000 rows makes batches of tens of megabytes out of whole texts, held several times over
    by each task on both sides; results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(kernel, schema)


def pick_rows(docs: DataFrame, ids: DataFrame, how: str, rows: int) -> DataFrame:
    """Semi or anti join of whole documents with an id list of ``rows`` rows: broadcast while that is small, shuffled beyond."""
    side = F.broadcast(ids) if rows <= BROADCAST_ROWS else ids
    return docs.join(side, "doc_id", how)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The rows whose text passes, with all columns as they are; ``make`` runs once a task and gives a function from texts to verdicts."""

    def kernel(batches):
        judge = make()
        for rb in batches:
            texts = [(x or "").encode() for x in rb.column(rb.schema.get_field_index("text")).to_pylist()]
            yield rb.filter(pa.array(judge(texts), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(kernel, docs.schema)

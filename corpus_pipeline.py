"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each result as
Parquet and rereads it as the next stage's input. All stages but the last return the columns of ``docs``. Stage names are also
what a run reports; the functions are thin calls of the operators in ``lociweave.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import subword
from lociweave.llm.common import load
from lociweave.llm.decontam import drop_contaminated
from lociweave.llm.hilbert import hilbert_shards
from lociweave.llm.labelled import drop_scored, fit_in_one_task, labelled_sample
from lociweave.llm.mixing import apply_mix, mix_to_targets
from lociweave.llm.neardup import drop_near_duplicates
from lociweave.plans.runtime import materialize

#: A document is rejected if it is likelier toxic than not.
TOXIC_LIMIT = 0.5
#: Expected token shares of the mixed corpus.
TARGETS = {"quality_1": 0.92, "quality_0": 0.08}


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the subword model, taught by the labels of the corpus, finds toxic."""
    sample, share = labelled_sample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "toxic", F.lit(True), subword.TRAIN_ROWS)
    return drop_scored(docs, fit_in_one_task(sample, subword.fit, share), subword.load, TOXIC_LIMIT)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of documents linked by five-word shingles at similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window similar to a benchmark item."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that expected tokens by labelled quality reach ``TARGETS``; rates are 1 or more, so every document stays."""
    labelled = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality_"), F.col("quality").cast("string")).alias("domain"))
    return apply_mix(docs, mix_to_targets(docs, labelled, TARGETS, min_rate=1.0))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, curve, shard and slot."""
    return hilbert_shards(docs, shards=16)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The classifier and its training are not expressible in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

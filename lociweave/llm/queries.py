"""Registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import oracles
from lociweave.llm.common import held_out, load
from lociweave.llm.labelled import fit_in_one_task, labelled_sample, score_texts


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.maxent_lm import score

    return score(load(spark, sf_dir, "documents"), 7, 2)


def op2_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the expected token shares of labelled quality to 95 parts of 1 and five of 0."""
    from lociweave.llm.mixing import mix_to_targets

    labelled = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality_"), F.col("quality").cast("string")).alias("domain"))
    mixed = mix_to_targets(load(spark, sf_dir, "documents"), labelled, {"quality_1": 0.95, "quality_0": 0.05})
    return mixed.select("doc_id", "tokens", F.col("p0").alias("p_quality_1"), F.col("p1").alias("p_quality_0"), "rate", "copies")


def op3_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.graph_ann import nearest

    return nearest(load(spark, sf_dir, "embeddings"), k=20, query_step=20)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.hilbert import hilbert_shards

    placed = hilbert_shards(load(spark, sf_dir, "documents"), shards=16, keep_columns=False)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm import nbsvm

    docs = load(spark, sf_dir, "documents")
    sample, share = labelled_sample(docs, load(spark, sf_dir, "labels"), "quality", ~held_out("doc_id", 5, 0), nbsvm.TRAIN_ROWS)
    scored = score_texts(docs, fit_in_one_task(sample, nbsvm.fit, share), nbsvm.load)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.secret_scan import count_kind, find_secrets, joined

    found = find_secrets(load(spark, sf_dir, "documents"))
    counts = [count_kind("base", i).alias(f"n_{k}") for i, k in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.decontam import contaminated

    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm import subword

    docs = load(spark, sf_dir, "documents")
    sample, share = labelled_sample(docs, load(spark, sf_dir, "labels"), "toxic", ~held_out("doc_id", 4, 2), subword.TRAIN_ROWS)
    scored = score_texts(docs, fit_in_one_task(sample, subword.fit, share), subword.load)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.ppm import identify, learn

    docs = load(spark, sf_dir, "documents")
    found = identify(docs, learn(docs, 4, 2))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "bits")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.neardup import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"), words=3, percent=85)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_maxent_lm, op2_mix_to_targets, op3_graph_ann, op4_hilbert_shards, op5_quality, op6_secret_scan, op7_benchmark_leaks, op8_toxicity, op9_language, op10_near_duplicates]
    return {f.__name__: f for f in found}


def llm_oracle_sql() -> dict[str, str]:
    return {"op4_hilbert_shards": oracles.HILBERT_SHARDS, "op6_secret_scan": oracles.SECRET_SCAN, "op10_near_duplicates": oracles.NEAR_DUPLICATES}

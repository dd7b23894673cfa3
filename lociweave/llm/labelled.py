"""Bounded samples of labelled documents, and models that one task fits on such a sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import as_bytes, hash_sample, keep_rows, map_batches


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, teaches: Column, rows: tuple[int, int]) -> tuple[DataFrame, float]:
    """raw and y of at most ``rows[y]`` labelled ids of each class for which ``teaches`` holds, chosen by id hash, with whole
    texts; and the share of class 1 among all of them, smoothed, which weights the classes as they are in the whole table."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & teaches).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen, sizes = hash_sample(known, {0: rows[0], 1: rows[1]}, "y")
    return as_bytes(docs, "doc_id").join(F.broadcast(chosen), "doc_id").select("doc_id", "raw", "y"), (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray, float], bytes], share: float) -> bytes:
    """Run ``fit`` on the bounded sample in one executor task and bring its packed model to the driver."""

    def kernel(batches):
        rows = []
        for rb in batches:
            rows += zip(rb.column("doc_id").to_pylist(), rb.column("raw").to_pylist(), rb.column("y").to_pylist(), strict=True)
        rows.sort()
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64), share)], pa.binary())})

    return bytes(map_batches(sample.repartition(1), kernel, "model binary").first()["model"])


def score_texts(docs: DataFrame, blob: bytes, load: Callable[[bytes], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """doc_id and score of every row; ``load`` turns the broadcast model into a function from texts to scores."""
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def kernel(batches):
        judge = load(shared.value)
        for rb in batches:
            scores = judge(rb.column("raw").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id"), "score": pa.array(np.asarray(scores, dtype=np.float64))})

    return map_batches(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), kernel, "doc_id long, score double")


def drop_scored(docs: DataFrame, blob: bytes, load: Callable[[bytes], Callable[[list[bytes]], np.ndarray]], limit: float) -> DataFrame:
    """The documents that score below ``limit``, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def make():
        judge = load(shared.value)
        return lambda texts: (np.asarray(judge(texts)) < limit).tolist()

    return keep_rows(docs, make)


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights of mean one that give class 1 the weight ``share``."""
    rate = min(max(float((y == 1).mean()), 1e-9), 1 - 1e-9)
    return np.where(y == 1, share / rate, (1 - share) / (1 - rate))


def calibrate(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by damped Newton steps on smoothed targets, classes weighted to ``share``."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    if not pos or not neg:
        return 0.0, float(np.log(share / (1 - share)))
    weight = class_weights(y, share)
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(margin)), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    w = np.array([1.0, float(np.log(share / (1 - share)))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (weight * (p - goal)) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])

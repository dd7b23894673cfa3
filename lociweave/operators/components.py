"""Connected components: edges contracted within tasks, then in one task if few are left, else by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.plans.runtime import drop_staged, materialize

#: Edges (of two keys of up to 16 bytes) up to which the minima of a round are broadcast: some ten megabytes.
_BROADCAST_EDGES = 200_000
#: Edges that one task takes whole: their nodes, of up to 16 bytes, fill some hundred megabytes at most.
_TASK_EDGES = 300_000
_CHUNK_NODES = 2 * _TASK_EDGES


def _fingerprint(edges: DataFrame) -> tuple:
    """Number and hash of distinct edges; the hash is an exclusive or, which no number of edges makes overflow."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(edges: DataFrame, rows: int, key: str, value: str) -> DataFrame:
    """``edges`` (at most ``rows`` rows) with m, the least ``value`` of each ``key``.

    The minima are broadcast while they are few. Beyond that they are staged, so that both sides of the join are plain
    exchanges and the adaptive skew join can split a key that holds a large part of the edges.
    """
    least = edges.groupBy(key).agg(F.min(value).alias("m"))
    return edges.join(F.broadcast(least) if rows <= _BROADCAST_EDGES else materialize(least, "least"), key)


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each task replaced by stars over the components they form there, in chunks of at most ``_CHUNK_NODES`` nodes."""

    def kernel(batches):
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars():
            rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], ["hi", "lo"])

        fields = None
        for rb in batches:
            fields = [rb.schema.field("hi"), rb.schema.field("lo")]
            for a, b in zip(rb.column("hi").to_pylist(), rb.column("lo").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > _CHUNK_NODES:
                yield stars()
        if parent:
            yield stars()

    return edges.mapInArrow(kernel, edges.schema)


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60, task_edges: int = _TASK_EDGES) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    Returns ``node, component``. Self loops, repeated edges and rows with a null end add nothing. The edges are
    first contracted within each task. Where at most ``task_edges`` are left, one task finishes them; more are rewritten into stars: a round costs two shuffles of at most the number of edges, and the number of rounds grows
    with the logarithm of the longest path. Each round's minimum is pre-aggregated, so a star with a huge centre
    is split by the adaptive skew join and never lands in one task. Stops when a round changes nothing.
    """
    ends = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("hi") != F.col("lo")))
    now = materialize(_contracted(ends).distinct(), "cc")
    seen = _fingerprint(now)
    if 0 < seen[0] <= task_edges:
        whole = materialize(_contracted(now.coalesce(1)), "cc")  # stars over the least nodes, which nothing could change
        drop_staged(now)
        now, seen = whole, (0, None)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(now.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        large = _with_least(both, 2 * seen[0], "a", "b").where(F.col("b") > F.col("a")).select(F.col("b").alias("hi"), F.least("a", "m").alias("lo")).distinct()
        small = _with_least(large, 2 * seen[0], "hi", "lo")
        # Each row gives its lower end the least one as parent, and its higher end too.
        ends = F.explode(F.array(F.col("lo"), F.col("hi")))
        after = materialize(small.select(ends.alias("hi"), F.col("m").alias("lo")).where(F.col("hi") != F.col("lo")).distinct(), "cc")
        drop_staged(now)
        now, before, seen = after, seen, _fingerprint(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(root.select("node", F.col("node").alias("component")))

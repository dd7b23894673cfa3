"""Approximate nearest neighbours by inner product on sharded, robust-pruned directed graphs.

Equal vectors are one node that lists their ids. Nodes are dealt to shards of about ``shard_rows`` by hash; each shard is one
graph. Vectors get one more component that makes all lengths of a shard equal, so the largest inner product is the smallest
distance. A graph starts random; in two passes each node's greedy search proposes neighbours, and relaxed distance pruning
keeps a proposal only if no kept neighbour is nearer to it by the factor ``alpha`` than the node is; edges are also added
backwards and pruned alike, and last, nodes that pruning left with few edges towards them get some from their neighbours. Each shard then tries out how wide its beam must be to find ``RECALL`` of the true nearest of
``TRIALS`` of its own vectors, so data without structure get wide beams and not wrong answers. A query is answered by a beam search
in every shard, scored in double precision on the original vectors, and the shards' answers are merged.

Every valid row is indexed. The index is a written table, so a lost executor re-reads it. Queries and shards meet in
blocks of at most about ``shard_rows`` nodes and ``query_rows`` queries, whatever the sizes of the tables.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
dimension never meet; a node keeps the smallest ``k + 1`` ids of equal vectors, which no answer of ``k`` can exceed; a row never
answers its own query; queries with no candidates give no rows; equal query rows are asked once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.plans.runtime import materialize

SHARD_ROWS = 32_768
QUERY_ROWS = 65_536
DEGREE = 24
WAYS_IN = 8
BUILD_BEAM = 48
BEAM = 96
ALPHAS = (1.0, 1.2)
#: Share of the nearest that each shard's beam must find for ``TRIALS`` of its vectors.
RECALL, TRIALS = 0.95, 64
_BLOCK = 512
_SPREAD = 4


def beam_search(vectors: np.ndarray, edges: np.ndarray, asked: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products, best first, of the beam of each asked vector; -1 where fewer were reached."""
    m, n = len(asked), len(vectors)
    rows = np.arange(m)[:, None]
    ids = np.full((m, width), -1, dtype=np.int32)
    near = np.full((m, width), -np.inf, dtype=np.float32)
    open_ = np.zeros((m, width), dtype=bool)
    met = np.zeros((m, n), dtype=bool)
    first = starts[:width]
    ids[:, : len(first)] = first
    near[:, : len(first)] = asked @ vectors[first].T
    open_[:, : len(first)] = True
    met[:, first] = True
    live = np.arange(m)
    while len(live):
        rank = np.where(open_[live], near[live], -np.inf)
        spread = min(max(_SPREAD, width // 48), width)
        pick = np.argpartition(-rank, spread - 1, axis=1)[:, :spread]
        ready = np.take_along_axis(open_[live], pick, axis=1)
        going = ready.any(axis=1)
        live, pick, ready = live[going], pick[going], ready[going]
        if not len(live):
            break
        here = rows[: len(live)]
        chosen = np.where(ready, ids[live[:, None], pick], -1)
        sub = open_[live]
        sub[here, pick] = False
        open_[live] = sub
        found = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(live), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        fresh = (found >= 0) & ~met[live[:, None], found]
        r, c = np.nonzero(fresh)
        met[live[r], found[r, c]] = True
        score = np.full(found.shape, -np.inf, dtype=np.float32)
        score[r, c] = np.einsum("ij,ij->i", asked[live[r]], vectors[found[r, c]])
        every = np.concatenate([near[live], score], axis=1)
        keep = np.argpartition(-every, width - 1, axis=1)[:, :width]
        near[live] = np.take_along_axis(every, keep, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, found, -1)], axis=1), keep, axis=1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), keep, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)


def prune(vectors: np.ndarray, nodes: np.ndarray, pool: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each node out of its pool of ids (-1: none)."""
    bad = (pool < 0) | (pool == nodes[:, None])
    squares = (vectors * vectors).sum(axis=1)
    at = vectors[pool]
    far = squares[nodes][:, None] + squares[pool] - 2 * np.einsum("md,mcd->mc", vectors[nodes], at)
    far = np.where(bad, np.inf, np.maximum(far, 0))
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    every = np.arange(len(nodes))
    for r in range(degree):
        best = far.argmin(axis=1)
        ok = np.isfinite(far[every, best])
        if not ok.any():
            break
        chosen = pool[every, best]
        out[ok, r] = chosen[ok]
        apart = squares[chosen][:, None] + squares[pool] - 2 * np.einsum("md,mcd->mc", vectors[chosen], at)
        far[(alpha * alpha * np.maximum(apart, 0) <= far) | (pool == chosen[:, None])] = np.inf
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1 padded) and entry nodes of the graph over equal-length vectors."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    middle = int(np.argmax(vectors @ vectors.mean(axis=0)))
    starts = np.unique(np.concatenate([[middle], rng.choice(n, min(n, 7), replace=False)])).astype(np.int32)
    if n <= degree + 1:
        edges = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        np.fill_diagonal(edges, -1)
        return edges, starts
    edges = rng.integers(0, n, (n, degree)).astype(np.int32)
    edges[edges == np.arange(n)[:, None]] = -1
    for alpha in ALPHAS:
        order = rng.permutation(n)
        for at in range(0, n, _BLOCK):
            nodes = order[at : at + _BLOCK].astype(np.int32)
            beam, _ = beam_search(vectors, edges, vectors[nodes], starts, width)
            pool = np.concatenate([beam, edges[nodes]], axis=1)
            pool.sort(axis=1)
            pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
            edges[nodes] = prune(vectors, nodes, pool, alpha, degree)
            src = np.repeat(nodes, degree)
            dst = edges[nodes].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            close = np.einsum("ij,ij->i", vectors[src], vectors[dst])
            by = np.lexsort((-close, dst))
            src, dst = src[by], dst[by]
            head, first, count = np.unique(dst, return_index=True, return_counts=True)
            place = np.arange(len(dst)) - np.repeat(first, count)
            into = np.full((len(head), degree), -1, dtype=np.int32)
            some = place < degree  # the nearest of the new incoming edges compete with the old ones
            into[np.repeat(np.arange(len(head)), count)[some], place[some]] = src[some]
            pool = np.concatenate([edges[head], into], axis=1)
            pool.sort(axis=1)
            pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
            edges[head] = prune(vectors, head.astype(np.int32), pool, alpha, degree)
    return with_ways_in(edges), starts


def with_ways_in(edges: np.ndarray, least: int = WAYS_IN) -> np.ndarray:
    """The edges with further columns through which every node is the end of about ``least`` edges, if it has as many of its own.

    Pruning leaves nodes without edges towards them, which no search reaches. Each gets edges from its own neighbours, those
    that lend fewest so far first, so that no node's list grows long.
    """
    n = len(edges)
    ways = np.bincount(edges[edges >= 0], minlength=n)
    lent = np.zeros(n, dtype=np.int64)
    given: list[tuple[int, int, int]] = []
    for x in np.argsort(ways, kind="stable").tolist():
        if ways[x] >= least:
            break
        mine = edges[x][edges[x] >= 0]
        for p in mine[np.lexsort((np.arange(len(mine)), lent[mine]))][: least - ways[x]].tolist():
            given.append((p, lent[p], x))
            lent[p] += 1
    more = np.full((n, int(lent.max(initial=0))), -1, dtype=np.int32)
    for p, at, x in given:
        more[p, at] = x
    return np.concatenate([edges, more], axis=1)


def level_lengths(vectors: np.ndarray) -> np.ndarray:
    """One more component that brings every vector to the greatest length."""
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(squares.max() - squares, 0))
    scale = max(float(np.sqrt(squares.max())), 1e-300)
    return (np.concatenate([vectors, extra[:, None]], axis=1) / scale).astype(np.float32)


def turned(asked: np.ndarray) -> np.ndarray:
    """Queries of unit length beside levelled vectors: their inner products order like those of the originals."""
    lengths = np.sqrt((asked**2).sum(axis=1, keepdims=True))
    return np.concatenate([asked / lengths, np.zeros((len(asked), 1))], axis=1).astype(np.float32)


def fitting_width(vectors: np.ndarray, levelled: np.ndarray, edges: np.ndarray, starts: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """The least beam width, doubling from ``BEAM``, that finds the share ``recall`` of the ``k`` nearest of some vectors of the graph.

    The trial vectors are held against all others by brute force. A beam as wide as the graph is exact, so the search ends.
    """
    n = len(vectors)
    some = np.random.default_rng(n).choice(n, min(n, trials), replace=False)
    k = min(k + 1, n)  # a trial vector may find itself, as a query may find its own row
    exact = vectors[some] @ vectors.T
    least = np.partition(exact, n - k, axis=1)[:, n - k]
    width = BEAM
    while width < n:
        beam, _ = beam_search(levelled, edges, turned(vectors[some]), starts, width)
        found = np.where(beam >= 0, np.take_along_axis(exact, np.maximum(beam, 0), axis=1), -np.inf) >= least[:, None]
        if np.minimum(found.sum(axis=1), k).mean() >= recall * k:
            break
        width *= 2
    return min(width, n)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, dim of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return out.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The written index (dim, shard, node, v, ids, edges, start, width) and its number of shards."""
    order = Window.partitionBy("v").orderBy("id")
    nodes = rows.select("id", "v", "dim").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    nodes = materialize(nodes.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending")])
        dim = table["dim"][0].as_py()
        vectors = _matrix(table["v"], dim)
        firsts = np.array([x[0] for x in table["ids"].to_pylist()])
        by = np.argsort(firsts, kind="stable")
        table, vectors = table.take(pa.array(by)), vectors[by]
        levelled = level_lengths(vectors)
        edges, starts = build_graph(levelled)
        width = fitting_width(vectors, levelled, edges, starts, k)
        entry = np.zeros(len(vectors), dtype=bool)
        entry[starts] = True
        return pa.table({"dim": table["dim"], "shard": table["shard"], "node": pa.array(np.arange(len(vectors), dtype=np.int32)), "v": table["v"], "ids": table["ids"], "edges": pa.array(list(edges), pa.list_(pa.int32())), "start": pa.array(entry), "width": pa.array([width] * len(vectors), pa.int32())})

    schema = "dim int, shard int, node int, v array<double>, ids array<long>, edges array<int>, start boolean, width int"
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "graph"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, width: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for queries with columns id, v, dim."""
    asked = materialize(queries.select("id", "v", "dim").distinct().withColumn("q", F.xxhash64("v")), "queries")
    blocks = max(1, math.ceil(asked.count() / query_rows))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(graph: pa.Table, wanted: pa.Table) -> pa.Table:
        out_id, out_q, out_ids, out_scores = [], [], [], []
        if graph.num_rows and wanted.num_rows:
            graph = graph.sort_by([("node", "ascending")])
            dim = graph["dim"][0].as_py()
            vectors, asked = _matrix(graph["v"], dim), _matrix(wanted["v"], dim)
            levelled = level_lengths(vectors)
            edges = graph["edges"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(vectors), -1)
            starts = np.flatnonzero(graph["start"].to_numpy(zero_copy_only=False)).astype(np.int32)
            members = graph["ids"].to_pylist()
            beams = max(graph["width"][0].as_py(), width)
            own, q = wanted["id"].to_pylist(), wanted["q"].to_pylist()
            for at in range(0, len(asked), _BLOCK):
                beam, _ = beam_search(levelled, edges, turned(asked[at : at + _BLOCK]), starts, min(max(beams, 2 * k), len(vectors)))
                exact = np.einsum("md,mcd->mc", asked[at : at + _BLOCK], vectors[beam])
                exact[beam < 0] = -np.inf
                order = np.argsort(-exact, axis=1, kind="stable")
                for i in range(len(beam)):
                    got: list[tuple[float, int]] = []
                    last = None
                    for j in order[i]:
                        s = float(exact[i, j])
                        if s == -math.inf or (len(got) >= k and s < last):
                            break
                        got += [(-s, x) for x in members[beam[i, j]] if x != own[at + i]]
                        last = s
                    got = sorted(got)[:k]
                    out_id.append(own[at + i])
                    out_q.append(q[at + i])
                    out_ids.append([x for _, x in got])
                    out_scores.append([-s for s, _ in got])
        return pa.table({"query_id": pa.array(out_id, pa.int64()), "q": pa.array(out_q, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int64())), "scores": pa.array(out_scores, pa.list_(pa.float64()))})

    keys = ["dim", "shard", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "query_id long, q long, ids array<long>, scores array<double>")
    each = parts.select("query_id", "q", F.explode(F.arrays_zip("ids", "scores")).alias("a")).select("query_id", "q", F.col("a.ids").alias("vec_id"), F.col("a.scores").alias("score"))
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, k: int = 20, query_step: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found for every row whose id is divisible by ``query_step``, against all rows."""
    rows = valid_vectors(df, id_col, vector_col)
    index, shards = build_index(rows, k)
    return search(index, shards, rows.where(F.col("id") % query_step == 0), k)

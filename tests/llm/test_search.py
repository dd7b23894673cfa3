"""Graph search against brute force, and its edge cases."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from lociweave.llm import graph_ann as g

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, k, step):
    out = {}
    for i, q in zip(ids, vectors, strict=True):
        if i % step == 0:
            score = vectors @ q
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(ids[j], score[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 24)).astype(np.float32)
    ids = np.arange(1500) * 7
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    rows = g.valid_vectors(df, "vec_id", "embedding")
    index, shards = g.build_index(rows, 20, shard_rows=400)
    assert shards == 4
    found = g.search(index, shards, rows.where("id % 20 = 0"), 20, query_rows=40).collect()
    want = brute(ids, vectors.astype(np.float64), 20, 20)
    hits = 0
    for q, best in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits += len({m[1] for m in mine} & {b[0] for b in best})
        exact = {int(i): float(v.astype(np.float64) @ vectors[q // 7].astype(np.float64)) for i, v in zip(ids, vectors, strict=True)}
        assert all(abs(m[2] - exact[m[1]]) < 1e-12 for m in mine)
    assert hits / (20 * len(want)) >= 0.9


def test_beams_widen_until_they_find_the_nearest():
    """Vectors without any structure, of unequal lengths: the hardest case for a graph."""
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(3000, 48))
    levelled = g.level_lengths(vectors)
    edges, starts = g.build_graph(levelled)
    width = g.fitting_width(vectors, levelled, edges, starts, 20)
    asked = vectors[rng.choice(3000, 200, replace=False)]
    exact = asked @ vectors.T
    best = np.argsort(-exact, axis=1)[:, :20]
    hits = {}
    for w in (g.BEAM, width):
        beam, _ = g.beam_search(levelled, edges, g.turned(asked), starts, w)
        hits[w] = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(beam.tolist(), best.tolist(), strict=True)])
    assert g.BEAM < width < 3000 and hits[g.BEAM] < 0.9 <= hits[width]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/embeddings.parquet").exists(), reason="no test tables")
def test_recall_of_the_registered_query(spark):
    from lociweave.llm.queries import op3_graph_ann

    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    vectors = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    want = brute(np.array([i for i, _ in rows]), vectors, 20, 20)
    found = op3_graph_ann(spark, folder).collect()
    assert len(found) == sum(map(len, want.values()))
    mine = {}
    for r in found:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(mine[q] & {x for x, _ in best}) for q, best in want.items()) >= 0.95 * len(found)


def test_copies_bad_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [float("inf"), 1.0], None), (7, [], 1), (20, [2.0, 0.0], 1), (21, [2.0, 0.0, 1.0], 1), (None, [1.0, 1.0], 1), (40, [0.0, 1.0], 2), (40, [0.0, 1.0], 2)]
    rows += [(100 + i, [1.0, 0.0], 3) for i in range(1, 60)]
    got = g.nearest(spark.createDataFrame(rows, SCHEMA), k=20).collect()
    by = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40, 120)}
    assert by[0] == [(20, 2.0), (1, 1.0)] + [(100 + i, 1.0) for i in range(1, 19)]
    assert by[20] == [(0, 2.0), (1, 2.0)] + [(100 + i, 2.0) for i in range(1, 19)]
    assert by[40][0] == (0, 0.0) and len(by[40]) == 20 and all(v != 40 for v, _ in by[40])
    assert by[120][:2] == [(20, 2.0), (0, 1.0)] and all(v != 120 for v, _ in by[120])
    assert g.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert g.nearest(spark.createDataFrame([(20, [1.0], 1)], SCHEMA)).count() == 0


def test_pruning_keeps_diverse_edges():
    v = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1]], dtype=np.float32)
    kept = g.prune(v, np.array([0]), np.array([[1, 2, 3, -1, 0]]), 1.2, 4)
    assert kept[0].tolist() == [1, 3, -1, -1]

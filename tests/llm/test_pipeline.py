"""The pipeline's stages against brute-force versions of their decisions, and the registered queries."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lociweave.llm.queries import llm_oracle_sql, llm_queries


def brute_dedup(rows, k=5, percent=80):
    """Ids kept: the smallest of each class of texts linked by word shingles."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    kept, left = set(), set(sets)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                group.add(x)
                todo += [y for y in left if sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
        kept.add(min(group))
    return kept


def brute_leaks(rows, items, k=5):
    """Ids of documents that hold an item word for word."""
    out = set()
    for i, t in rows:
        w = t.lower().split()
        for b in items:
            x = b.lower().split()
            if any(w[j : j + len(x)] == x for j in range(len(w) - len(x) + 1)):
                out.add(i)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    clean, toxic = [f"word{i}" for i in range(300)], ["idiotic", "moronic", "scummy"]
    items = [" ".join(rng.choice(clean) for _ in range(20)) for _ in range(5)]
    docs, labels = [], []
    for i in range(240):
        w = [rng.choice(clean) for _ in range(rng.randrange(15, 60))]
        bad, junk = i % 5 == 0, i % 7 == 0
        if bad:
            for _ in range(1 + len(w) // 6):
                w[rng.randrange(len(w))] = rng.choice(toxic)
        if junk:
            w = [x + "%%" for x in w]
        if i % 11 == 3:
            w[5:5] = rng.choice(items).split()
        text = docs[i - 9][1] if i % 13 == 12 else " ".join(w)
        docs.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, int(not junk), int("idiotic" in text or "moronic" in text or "scummy" in text)))
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root, docs, labels, items


def test_stages(spark, folder):
    root, docs, labels, items = folder
    df = spark.read.parquet(f"{root}/documents.parquet")
    columns = df.columns
    truth = {i: t for i, _, t in labels}
    one = cp.STAGES[0][1](spark, df, root)
    kept = [tuple(r)[:2] for r in one.select("doc_id", "text").collect()]
    assert sum(truth[i] for i, _ in kept) <= 2 and len(kept) >= 0.97 * (len(docs) - sum(truth.values()))
    two = cp.STAGES[1][1](spark, df, root)
    assert {r["doc_id"] for r in two.select("doc_id").collect()} == brute_dedup([d[:2] for d in docs])
    three = cp.STAGES[2][1](spark, df, root)
    assert {r["doc_id"] for r in three.select("doc_id").collect()} == {d[0] for d in docs} - brute_leaks([d[:2] for d in docs], items)
    four = cp.STAGES[3][1](spark, df, root)
    copies = Counter(r["doc_id"] for r in four.select("doc_id").collect())
    assert set(copies) == {d[0] for d in docs}
    junk = {i for i, q, _ in labels if not q}
    size = {d[0]: len(d[1].split()) for d in docs}
    share = sum(size[i] * n for i, n in copies.items() if i in junk) / sum(size[i] * n for i, n in copies.items())
    assert share == pytest.approx(0.08, abs=0.02)
    five = cp.STAGES[4][1](spark, df, root)
    assert five.count() == len(docs) and {r["shard"] for r in five.select("shard").distinct().collect()} == set(range(16))
    assert all(x.columns == columns for x in (one, two, three, four)) and set(columns) < set(five.columns)


def test_run_and_queries(spark, folder):
    root, docs, *_ = folder
    out = cp.run(spark, root)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < len(docs) and [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert set(llm_oracle_sql()) <= set(llm_queries()) and len(llm_queries()) == 10
    for name, query in llm_queries().items():
        df = query(spark, root)
        n = df.count()
        assert n == {"op3_graph_ann": 60, "op7_benchmark_leaks": n}.get(name, len(docs)), name


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_query_against_sql(spark, folder, name):
    root = folder[0]
    got = llm_queries()[name](spark, root)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    want = db.execute(llm_oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    assert names == sorted(got.columns)
    order = [[d[0] for d in want.description].index(c) for c in names]
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_run_over_odd_tables(spark, folder, clashing, no_docs, tmp_path_factory):
    """Nulls, empty texts, repeated and missing ids and clashing columns go through every stage; so does an empty table."""
    source = folder[0]
    for docs in (clashing, no_docs):
        root = str(tmp_path_factory.mktemp("odd"))
        docs.write.parquet(f"{root}/documents.parquet")
        spark.read.parquet(f"{source}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
        spark.read.parquet(f"{source}/labels.parquet").withColumn("toxic", F.lit(0)).write.parquet(f"{root}/labels.parquet")
        found = cp.run(spark, root)
        assert set(docs.columns) <= set(found.columns)
        out = found.collect()
        assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.select("doc_id").collect()} and (len(out) > 0) == (docs is clashing)
        if docs is clashing:
            # Copies of 1 and 5 go, the row without an id, the empty ones and all other texts stay.
            assert {1, 2, 3, 4, 5, 7, 8, 10, None} == {r["doc_id"] for r in out}
            assert all(r["_u"] == "keep" and r["raw"] == "keep" for r in out)

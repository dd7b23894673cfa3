"""Near-duplicates against brute force, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lociweave.llm import neardup as nd
from lociweave.llm.shingles import shingle_set, window_hashes, words_of


def sets_of(text, k):
    w = words_of((text or "").encode())
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k, percent):
    """component_id by doc_id over all pairs."""
    sets = [(i, sets_of(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = w[:10] + common + w[10:]
        rows.append((1000 - i, " ".join(w).upper() if rng.random() < 0.3 else "\n".join(w)))
    return rows


@pytest.mark.parametrize("words, percent, block_rows", [(3, 85, 2048), (5, 80, 2048), (3, 85, 8), (2, 60, 8)])
def test_against_brute_force(spark, words, percent, block_rows):
    rows = corpus(words * percent)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, block_rows=block_rows).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_edge_cases(spark, odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing):
        got = nd.near_duplicates(docs, 3, 85).collect()
        assert len(got) == 12
        by_id = {r["doc_id"]: r for r in got}
        assert [by_id[i]["n_shingles"] for i in (2, 3, 4, 7)] == [0, 0, 0, 1]
        assert [by_id[i]["component_id"] for i in (1, 6, 5, 9, 2, 3)] == [1, 1, 5, 5, 2, 3]
        assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    kept = nd.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5, 7, 8, 10, None]
    assert nd.near_duplicates(no_docs).count() == 0 and nd.drop_near_duplicates(no_docs).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g")] * 3 + [(5, "q w e r t y")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nd.drop_near_duplicates(docs).collect()) == [3, 5]


def test_rows_are_told_apart_by_id_and_set(spark):
    a, b, c, d = "a b c d e f g", "q w e r t y u", "one two three four five six", "k l m n o p s"
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, d), (None, "z x v n m l k"), (None, a), (8, ""), (9, b + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in nd.drop_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (7, c), (None, d), (None, "z x v n m l k"), (8, ""), (9, b + " end")], key=str)
    plain = spark.createDataFrame([(None, a), (None, b), (7, c), (7, c)], "doc_id long, text string")
    assert sorted(r["text"] for r in nd.drop_near_duplicates(plain).collect()) == sorted([a, b, c])


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_rows_without_an_id_link_and_bridge(spark, block_rows):
    """Every third row loses its id: links and classes stay those of brute force over rows."""
    rows = corpus(77, 140)
    named = [(None if i % 3 == 0 else d, t) for i, (d, t) in enumerate(rows)] + [(None, rows[0][1])] * 3
    docs = spark.createDataFrame(named, "doc_id long, text string")
    whole = brute(list(enumerate(t for _, t in named)), 3, 85)
    least = {}
    for i, (d, _) in enumerate(named):
        if d is not None:
            c = whole[i][1]
            least[c] = min(least.get(c, d), d)
    want = sorted((str(d), whole[i][0], str(least.get(whole[i][1])), d == least.get(whole[i][1])) for i, (d, _) in enumerate(named))
    got = nd.near_duplicates(docs, 3, 85, block_rows=block_rows).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == want
    w = [f"x{i}" for i in range(40)]
    chain = [(1, " ".join(w)), (None, " ".join(w[2:] + ["p", "q"])), (9, " ".join(w[4:] + ["p", "q", "r", "s"]))]
    linked = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 3, 85).collect()}
    assert linked == {1: 1, None: 1, 9: 1} and brute([c for c in chain if c[0]], 3, 85)[9][1] == 9


def test_prefixes_meet_every_match():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 50, (60, 32))
    sigs = np.where(rng.random((60, 32)) < 0.4, base[:1], base)
    for threshold in (8, 16):
        prefix = nd._prefix_rows(sigs, threshold)
        hits = (sigs[:, None] == sigs[None]).sum(axis=2)
        met = np.array([[bool(set(a) & set(b)) for b in prefix.tolist()] for a in prefix.tolist()])
        assert prefix.shape[1] == 32 - threshold + 1 and met[hits >= threshold].all() and not met.all()


def test_shingle_hashes_depend_on_words_alone():
    a, b = window_hashes(b"One  two\tthree\nfour", 3), window_hashes(b"one two three four", 3)
    assert (a == b).all() and len(a) == 2
    assert len(shingle_set(b"", 3)) == 0 and len(shingle_set(b"one two", 3)) == 1
    assert nd.match_threshold(85) < 32 * 0.85


def test_dealing_covers_every_pair_once(spark):
    rng = random.Random(2)
    rows = [(i, bytes([i % 256, i // 256]), b"g", rng.randrange(20, 60)) for i in range(120)]
    members = spark.createDataFrame(rows, "doc_id long, node binary, grp binary, n_shingles long")
    dealt = nd._dealt(members, 80, 16).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault(r["task"], []).append((r["doc_id"], r["side"]))
    met = {}
    for t in tasks.values():
        crossing = any(s for _, s in t)
        for x, s in t:
            for y, z in t:
                if x < y and (s != z or not crossing):
                    met[(x, y)] = met.get((x, y), 0) + 1
    size = {r[0]: r[3] for r in rows}
    assert all(v == 1 for v in met.values())
    assert all((x, y) in met for x in size for y in size if x < y and 100 * min(size[x], size[y]) >= 80 * max(size[x], size[y]))
    assert max(len(t) for t in tasks.values()) < 60


def test_signature_estimates_similarity():
    a, b = nd._permutations(256)
    x, y = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    from lociweave.llm.shingles import mix

    same = (nd.signature(mix(x), a, b) == nd.signature(mix(y), a, b)).mean()
    assert abs(same - 900 / 1100) < 0.12

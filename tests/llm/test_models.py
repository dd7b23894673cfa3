"""Scoring operators: proper probabilities, exact code lengths, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import maxent_lm as lm
from lociweave.llm import nbsvm, ppm, subword
from lociweave.llm.common import held_out
from lociweave.llm.labelled import calibrate, drop_scored, fit_in_one_task, labelled_sample, score_texts


def texts(seed, n=120):
    rng = random.Random(seed)
    words = {"en": ["the", "and", "of", "house", "walking", "thing"], "de": ["der", "und", "von", "haus", "gehen", "ding"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        w = [rng.choice(words[lang]) + ("%%%" if bad else "") for _ in range(rng.randrange(20, 80))]
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["idiotic", "moronic"])
        rows.append((i, " ".join(w), lang, "s", len(w), int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rows = texts(4)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_base_score_counts_and_model(spark, made):
    rows, docs, _ = made
    got = {r["doc_id"]: r for r in lm.score(docs, direct_words=6, steps=5).collect()}
    c = Counter()
    tokens = {r[0]: r[1].encode().lower().split() + [b"\n"] for r in rows}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-12)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_model_is_a_distribution(spark, made):
    _, docs, _ = made
    rows = lm.as_bytes(docs)
    head = [lm.END, b"the", b"und"]
    cells = lm.cell_counts(rows, head)
    weights, fits = lm.train(cells, np.concatenate([[120.0, 300.0, 300.0], np.zeros(lm.HEAD - 3), np.full(lm.TAIL, 50.0)]), 4)
    assert all(b > a for a, b in zip(fits, fits[1:], strict=False))
    ctx = np.array([0, 1, 257, 65535])
    assert np.allclose((10 ** weights.log10(ctx)).sum(axis=1), 1, atol=1e-4)


def test_contexts_start_anew_with_each_text():
    s = np.array([5, 6, 7, 0, 8, 0, 0], dtype=np.int32)
    got = lm.contexts_of(s, [4, 2, 1])
    assert got.tolist() == [0, 5, 5 * 256 + 6, 6 * 256 + 7, 0, 8, 0]


def test_every_word_is_a_context_and_an_output(spark):
    """3,000 words beyond the symbols, each always followed by the same other one; direct and joined counts give the same scores."""
    rng = random.Random(9)
    follow = list(range(3000))
    rng.shuffle(follow)
    often = " ".join(f"h{i} " * (320 - i) for i in range(260))
    taught = [i for i in range(1000, 1020) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(taught[0], often), (taught[1], "")]
    for i in range(600):
        w = [rng.randrange(3000)]
        while len(w) < 60:
            w.append(follow[w[-1]])
        rows.append((i, " ".join(f"r{x}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, joined, plain = ({r["doc_id"]: r for r in lm.score(docs, direct_words=n, steps=3, word_prior=k).collect()} for n, k in ((100_000, 200.0), (300, 200.0), (100_000, 1e12)))
    assert all(joined[i]["score"] == pytest.approx(r["score"], rel=1e-5) for i, r in got.items())
    out = [r for r in got.values() if r["held_out"]]
    n = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] - plain[r["doc_id"]]["score"] for r in out) / n > 0.5
    ends = sum(not r["held_out"] for r in got.values())
    p = 10 ** plain[taught[1]]["score"]
    assert got[taught[1]]["score"] == pytest.approx(math.log10((1 + 200 * p) / (ends + 200)), rel=1e-4)


def test_scores_against_plain_sums(spark):
    """Every row's score by the definition, token by token, from the trained symbol model and plain counts of words and pairs."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(420)]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.01)), 419)] for _ in range(rng.randrange(0, 90)))) for i in range(90)] + [(90, None), (91, "UNSEEN w1 W1 unseen"), (7, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = [(i, (t or "").lower().encode().split() + [lm.END]) for i, t in rows]
    n, pairs = Counter(), Counter()
    for i, t in tokens:
        if not out[i]:
            n.update(t)
            pairs.update(zip([lm.END, *t], t, strict=False))
    head = [lm.END] + [w for w in sorted(n, key=lambda w: (-n[w], w)) if w != lm.END][: lm.HEAD - 1]
    symbol = lm.Symbols(head)
    tail = Counter()
    kinds = Counter()
    for w, c in n.items():
        if w not in symbol.head:
            tail[w[-1] % lm.TAIL] += c
            kinds[w[-1] % lm.TAIL] += 1
    marginal = np.array([n[w] for w in head] + [tail[t] for t in range(lm.TAIL)], dtype=float)
    taught = lm.as_bytes(docs.where(F.col("doc_id").isin([i for i in out if not out[i]])))
    weights, _ = lm.train(lm.cell_counts(taught, head), marginal, 3)

    def score(t):
        total, s = 0.0, symbol(t)
        for k, w in enumerate(t):
            near, far = (s[k - 1] if k else 0), (s[k - 2] if k > 1 else 0)
            p = 10.0 ** weights.log10(np.array([far * lm.SYMBOLS + near]))[0][s[k]]
            if s[k] >= lm.HEAD:
                p *= (n[w] + 1) / (tail[s[k] - lm.HEAD] + kinds[s[k] - lm.HEAD] + 1)
            before = t[k - 1] if k else lm.END
            total += math.log10((pairs[before, w] + lm.WORD_PRIOR * p) / (n[before] + lm.WORD_PRIOR))
        return total

    want = sorted((i, score(t)) for i, t in tokens)
    for direct in (100_000, 250):
        got = sorted((r["doc_id"], r["score"]) for r in lm.score(docs, direct_words=direct, steps=3).collect())
        assert [x[0] for x in got] == [x[0] for x in want]
        assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=2e-5, abs=1e-5)


def test_rare_words_travel_whole():
    texts = [{b"a": 1, b"\xff,;": 70_000}, {}, {lm.END: 1}, {"\u00a0".encode(): 2}]
    got = lm._rare_words([b" ".join(t) for t in texts], [np.array(list(t.values()), dtype=np.uint32).tobytes() for t in texts])
    assert [{r["word"]: r["times"] for r in t} for t in got.to_pylist()] == texts


def test_lm_edge_cases(spark, odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing):
        got = lm.score(docs, steps=2).collect()
        assert len(got) == 12 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
        assert {r["doc_id"]: r["n_tokens"] for r in got}[2] == 1
    assert lm.score(no_docs, steps=2).count() == 0
    nobody = spark.createDataFrame([(8, "a b")], "doc_id long, text string").where(F.lit(True))
    assert zlib.crc32(b"8") % 7 in range(7)
    one = lm.score(nobody, 1, 0, steps=2).collect()[0]  # every row is held out
    assert (one["held_out"], one["train_tokens"], one["score"], one["base_score"]) == (True, 0, 0.0, 0.0)


class PlainPpm:
    """Code lengths by the definition, one byte at a time."""

    def __init__(self, samples):
        self.trees = {}
        for lang, t in samples:
            tree = self.trees.setdefault(lang, {})
            a = b"\n\n\n" + t.lower()
            for i in range(3, len(a)):
                for k in range(4):
                    tree.setdefault(a[i - k : i], Counter())[a[i]] += 1

    def bits(self, lang, text):
        tree, a, out = self.trees[lang], b"\n\n\n" + text.lower(), 0.0
        for i in range(3, len(a)):
            for k in (3, 2, 1, 0):
                c = tree.get(a[i - k : i])
                if c is None:
                    continue
                n, t = sum(c.values()), len(c)
                if c[a[i]]:
                    out += math.log2((n + t) / c[a[i]])
                    break
                out += math.log2((n + t) / t)
            else:
                out += 8
        return out


def test_code_lengths_are_exact(spark):
    rng = random.Random(9)
    samples = [(lang, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 300))).encode()) for lang, alphabet in (("en", "abcd e"), ("de", "abxyäö "), ("fr", "cdé z")) for _ in range(8)]
    docs = spark.createDataFrame([(i, t.decode(), lang) for i, (lang, t) in enumerate(samples)], "doc_id long, text string, lang string")
    trees = ppm.learn(docs)
    plain = PlainPpm(samples)
    asked = [t for _, t in samples[::5]] + [b"", b"a", b"Hello W\xc3\xb6rld 123", b"zzzz"]
    got = trees.lengths(asked)
    for row, t in zip(got, asked, strict=True):
        assert row == pytest.approx([plain.bits(x, t) for x in trees.langs], rel=1e-5, abs=1e-3)


def test_trees_hold_every_entry(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "".join(chr(rng.randrange(32, 120)) for _ in range(3000)), f"l{i % 3}") for i in range(12)], "doc_id long, text string, lang string")
    got = {(lang, code): n for lang, code, n in ppm._counted(ppm.as_bytes(docs, "lang"))}
    want = Counter()
    for r in docs.collect():
        a = b"\n\n\n" + r["text"].lower().encode()
        want.update((r["lang"], int.from_bytes(a[i - 3 : i + 1], "big")) for i in range(3, len(a)))
    assert got == want


def test_language_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "abc abc", "xx"), (2, "abc abc", "aa"), (3, "abc", None), (3, "abc", None)], "doc_id long, text string, lang string")
    got = ppm.identify(docs, ppm.learn(docs)).collect()
    assert {r["lang_pred"] for r in got} == {"aa"} and all(r["score"] == pytest.approx(0.5) for r in got)
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1


def plain_toxic_odds(odds, bias, raw):
    """Mean of the folded weights of the n-grams inside words, by loops over positions."""
    mask = (1 << 64) - 1
    t = b" " + b" ".join(raw.lower().split()) + b" "
    z = []
    for n in subword.ORDERS:
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if b" " not in g[1:-1]:
                x = int.from_bytes(g, "little")
                z.append(odds[((((x * 0xC2B2AE3D27D4EB4F) & mask) ^ (x >> 29)) * 0x9E3779B97F4A7C15 & mask) >> (64 - subword.BITS)])
    return bias + (math.fsum(z) / len(z) if z else 0.0)


def plain_quality_margin(w, ratio, raw):
    mask, rows = (1 << 64) - 1, set()
    for n in nbsvm.ORDERS:
        for i in range(len(raw) - n + 1):
            rows.add(((int.from_bytes(raw[i : i + n], "little") + (n << 40)) * 0x9E3779B97F4A7C15 & mask) >> (64 - nbsvm.BITS))
    rows = sorted(rows)
    norm = math.sqrt(math.fsum(float(ratio[r]) ** 2 for r in rows))
    return math.fsum(float(w[r]) * float(ratio[r]) for r in rows) / max(norm, 1e-12) + float(w[-1]) if rows else 0.0


def test_scores_against_plain_loops(spark, made):
    rows, docs, labels = made
    odd = [b"", b"a", b"ab c", b"The  und\tWalking", "über %%% \U0001f600".encode(), b"xyz " * 400]
    raws = [r[1].encode() for r in rows[:25]] + odd
    sample, share = labelled_sample(docs, labels, "toxic", F.lit(True), subword.TRAIN_ROWS)
    blob = fit_in_one_task(sample, subword.fit, share)
    bias, odds = np.frombuffer(blob, "<f8", 1)[0], np.frombuffer(blob, "<f4", 1 << subword.BITS, 8)
    got = subword.load(blob)(raws + raws)
    want = [1 / (1 + math.exp(-plain_toxic_odds(odds, bias, t))) for t in raws]
    assert got[: len(raws)] == pytest.approx(want, abs=1e-9) and (got[: len(raws)] == got[len(raws) :]).all()
    sample, share = labelled_sample(docs, labels, "quality", F.lit(True), nbsvm.TRAIN_ROWS)
    blob = fit_in_one_task(sample, nbsvm.fit, share)
    slope, offset = np.frombuffer(blob, "<f8", 2)
    w, ratio = np.frombuffer(blob, "<f4", (1 << nbsvm.BITS) + 1, 16), np.frombuffer(blob, "<f4", 1 << nbsvm.BITS, 16 + 4 * ((1 << nbsvm.BITS) + 1))
    got = nbsvm.load(blob)(raws + raws)
    want = [1 / (1 + math.exp(-(slope * plain_quality_margin(w, ratio, t) + offset))) for t in raws]
    assert got[: len(raws)] == pytest.approx(want, abs=1e-6) and (got[: len(raws)] == got[len(raws) :]).all()


def test_log_count_ratios_against_plain_counts(spark, made):
    rows, docs, labels = made
    texts_, y = [r[1].encode() for r in rows], np.array([r[5] for r in rows])
    ratio = np.frombuffer(nbsvm.fit(texts_, y, 0.5), "<f4", 1 << nbsvm.BITS, 16 + 4 * ((1 << nbsvm.BITS) + 1))
    held = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts_]
    for g in (b"%%%", b"the", b" un", b"ehe"):
        at = ((int.from_bytes(g, "little") + (3 << 40)) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) >> (64 - nbsvm.BITS)
        n = [sum(g in h for h, v in zip(held, y, strict=True) if v == c) for c in (0, 1)]
        want = math.log((n[1] + 1) / ((y == 1).sum() + 2)) - math.log((n[0] + 1) / ((y == 0).sum() + 2))
        assert ratio[at] == pytest.approx(want, abs=1e-5)


def test_descent_reaches_the_dual_optimum():
    """On a small problem the primal and dual values of the hinge loss meet."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(80)]
    values = [v / np.sqrt((v * v).sum()) for v in rng.normal(size=(80, 6))]
    sign, cost = rng.choice([-1, 1], 80), np.full(80, 0.7)
    w = nbsvm.descend(rows, values, sign, cost, epochs=4000)
    margin = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values, strict=True)])
    primal = (w @ w) / 2 + (cost * np.maximum(0, 1 - sign * margin)).sum()
    better = [np.random.default_rng(s).normal(scale=1e-3, size=41) for s in range(200)]
    for d in better:
        u = w.copy()
        u[:40] += d[:40]
        u[-1] += d[40]
        m = np.array([u[r] @ v + u[-1] for r, v in zip(rows, values, strict=True)])
        assert (u @ u) / 2 + (cost * np.maximum(0, 1 - sign * m)).sum() >= primal - 1e-3


def test_language(spark, made, odd_docs, clashing, no_docs):
    rows, docs, _ = made
    trees = ppm.learn(docs, 4, 2)
    got = {r["doc_id"]: r for r in ppm.identify(docs, trees).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] and 0 <= got[r[0]]["score"] <= 1 for r in rows)
    for odd in (odd_docs, clashing):
        pred = {r["doc_id"]: r["lang_pred"] for r in ppm.identify(odd, trees).collect()}
        assert [pred[i] for i in (2, 3, 4, 10)] == ["und"] * 4 and pred[None] == "de"
        ppm.identify(odd, ppm.learn(odd, 4, 2)).collect()
    assert ppm.identify(no_docs, ppm.learn(no_docs)).count() == 0
    assert {r["lang_pred"] for r in ppm.identify(odd_docs, ppm.learn(no_docs)).collect()} == {"und"}


@pytest.mark.parametrize("model, label, modulus, back", [(nbsvm, "quality", 5, 0), (subword, "toxic", 4, 2)])
def test_held_out_accuracy(spark, made, model, label, modulus, back, odd_docs, clashing, no_docs):
    rows, docs, labels = made
    sample, share = labelled_sample(docs, labels, label, ~held_out("doc_id", modulus, back), model.TRAIN_ROWS)
    blob = fit_in_one_task(sample, model.fit, share)
    truth = {r[0]: r[5 if label == "quality" else 6] for r in rows}
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, blob, model.load).collect()}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % modulus == back]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in test]) > 0.9
    if label == "toxic":
        near, clean = model.load(blob)([b"the und idiotik of haus moronik", b"the und walking of haus thing"])
        assert near > clean
    for odd in (odd_docs, clashing):
        assert all(0 <= r["score"] <= 1 for r in score_texts(odd, blob, model.load).collect())
        assert drop_scored(odd, blob, model.load, 2.0).columns == odd.columns and drop_scored(odd, blob, model.load, 2.0).count() == 12
        assert drop_scored(odd, blob, model.load, 0.0).count() == 0
    empty, share = labelled_sample(no_docs, labels, label, F.lit(True), model.TRAIN_ROWS)
    nothing = fit_in_one_task(empty, model.fit, 0.5)
    assert {r["score"] for r in score_texts(docs, nothing, model.load).collect()} == {0.5}
    assert score_texts(no_docs, blob, model.load).count() == 0


def test_sample_is_bounded_and_weighted(spark, made):
    rows, docs, labels = made
    more = labels.union(spark.createDataFrame([(None, 1, 1), (500, None, None), (501, 7, 7)], labels.schema))
    sample, share = labelled_sample(docs, more, "quality", F.lit(True), (5, 7))
    got = Counter(r["y"] for r in sample.collect())
    assert got == {0: 5, 1: 7} and share == pytest.approx((sum(r[5] for r in rows) + 1) / (len(rows) + 2))


def test_calibration_recovers_a_logistic_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    slope, offset = calibrate(x, y, y.mean())
    assert abs(slope - 2) < 0.3 and abs(offset + 1) < 0.3

"""Operators in DataFrame functions: secrets, Hilbert shards, mixing; also decontamination."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociweave.llm import decontam as dc
from lociweave.llm import hilbert, mixing
from lociweave.llm import secret_scan as ss
from lociweave.llm.shingles import words_of

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_spans(t):
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    more = []
    for m in re.finditer(ss.RUN, t):
        if any(re.search(p, m[0]) for p in ss.ALLOW):
            continue
        best = max(-sum(c / ss.WINDOW * math.log2(c / ss.WINDOW) for c in Counter(m[0][i : i + ss.WINDOW]).values()) for i in range(len(m[0]) - ss.WINDOW + 1))
        hexed = bool(re.search(ss.HEX_RUN, m[0]))
        if best >= ss.LIMIT_BITS["entropy_hex" if hexed else "entropy_mixed"] - 1e-7:
            more.append((m.start(), 3 if hexed else 4, m.end()))
    return sorted(base), sorted(base + more)


def test_secrets_against_plain_scan(spark):
    rng = random.Random(5)
    pieces = ["password: token = abcdefghi", "API_KEY='Zx81kq0LmPw2'", "token==abc", "AKIA" + "Q7" * 8, "AKIAAKIA12", "deadbeef" * 4, "0123456789abcdef" * 3, "über \U0001f600", "SeCrEt=short", "aaaaaaaaaaaaaaaaaaaaaaaa1", "Kx9/fQ2+Lm7Zr4Tb8Wc1Yv6Np3", "example_key_1234567890abcXYZ", "onlyletterswithoutanydigits", "\n"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n", ", "]) for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ss.find_secrets(docs).collect()
    for r in got:
        base, spans = plain_spans(texts[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == base and [tuple(s) for s in r["spans"]] == spans
    assert sum(len(r["spans"]) for r in got) > 100
    names = ss.KINDS
    shown = ss.find_secrets(docs).select("doc_id", ss.joined("spans").alias("s"), F.sha2(ss.joined("base"), 256).alias("h")).collect()
    for r in shown:
        base, spans = plain_spans(texts[r["doc_id"]])
        text = lambda x: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in x)
        assert r["s"] == text(spans) and r["h"] == hashlib.sha256(text(base).encode()).hexdigest()
    masked = {r["doc_id"]: r["text"] for r in ss.redact(docs).collect()}
    assert all(len(masked[i]) == len(t) and "Kx9/fQ2" not in masked[i] for i, t in enumerate(texts))


def test_secret_edge_cases(odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing):
        got = ss.find_secrets(docs).collect()
        assert len(got) == 12 and {len(r["base"]) for r in got if r["doc_id"] != 8} == {0}
        assert [tuple(s) for r in got if r["doc_id"] == 8 for s in r["base"]] == [(17, 0, 37)]
    assert ss.find_secrets(no_docs).count() == 0


def test_long_runs_and_many_matches_take_linear_time(spark):
    rng = random.Random(3)
    run = "".join(rng.choice(ss.ALPHABET) for _ in range(1_000_000))
    many = "".join(f"{'.' * (i % 3)} token={i:08d} " for i in range(100_000))
    docs = spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string").coalesce(1)
    began = time.time()
    got = {r["doc_id"]: r for r in ss.find_secrets(docs).select("doc_id", F.col("base"), F.col("spans")).collect()}
    took = time.time() - began
    assert [tuple(x) for x in got[1]["spans"] if x["kind"] == 4] == [(0, 4, 1_000_000)]
    assert [tuple(x) for x in got[2]["base"]] == [(m.start(), 0, m.end()) for m in ASSIGN.finditer(many)]
    assert took < 60


def test_curve_is_a_bijection_with_unit_steps(spark):
    for dims, bits in ((2, 3), (3, 2)):
        names = [f"d{i}" for i in range(dims)]
        side = 1 << bits
        cells = spark.range(side**dims).select(*(F.expr(f"int(floor(id / {side**i}) % {side})").alias(n) for i, n in enumerate(names)))
        rows = sorted(hilbert.hilbert_index(cells, names, bits, "h").collect(), key=lambda r: r["h"])
        assert [r["h"] for r in rows] == list(range(side**dims))
        for a, b in zip(rows, rows[1:], strict=False):
            assert sum(abs(a[n] - b[n]) for n in names) == 1


@pytest.mark.parametrize("run_rows", [100_000, 7])
def test_shards(spark, run_rows):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else "éx " * rng.randrange(0, 300), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 9}", 1) for i in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = hilbert.hilbert_shards(docs, run_rows=run_rows).collect()
    assert len(got) == 203
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        mine = sorted((r["slot"], r["curve"]) for r in got if r["shard"] == s)
        assert [x[0] for x in mine] == list(range(counts[s])) and [x[1] for x in mine] == sorted(x[1] for x in mine)
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    tops = [max(r["curve"] for r in got if r["shard"] == s) for s in range(16)]
    assert tops == sorted(tops)
    narrow = hilbert.hilbert_shards(docs, run_rows=run_rows, keep_columns=False).select("doc_id", "shard", "slot").collect()
    assert {tuple(r) for r in narrow} == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    manifest = hilbert.shard_manifest(hilbert.hilbert_shards(docs), ["lang"]).collect()
    assert sum(r["rows"] for r in manifest) == 203


def test_shard_edge_cases(odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing):
        got = hilbert.hilbert_shards(docs)
        assert got.count() == 12 and set(docs.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
        own = [c for c in docs.columns if c not in ("size", "shard", "slot", "curve")]
        assert Counter(map(tuple, got.select(*own).collect())) == Counter(map(tuple, docs.select(*own).collect()))
    assert hilbert.hilbert_shards(no_docs).count() == 0 and hilbert.hilbert_shards(no_docs, keep_columns=False).count() == 0


def test_readers_skip_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["de", "en", "fr", "it", None]), f"s{rng.randrange(6)}", 1) for i in range(3000)]
    sharded = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    manifest = hilbert.shard_manifest(sharded, ["lang", "source", "size"])
    hilbert.write_shards(sharded, f"{tmp_path}/shards")
    stored = spark.read.parquet(f"{tmp_path}/shards")
    for ranges in ({"lang": ("fr", "fr")}, {"lang": ("de", "en"), "size": (1, 60)}):
        need = [r["shard"] for r in hilbert.needed_shards(manifest, ranges).collect()]
        wanted = lambda df, ranges=ranges: df.where(" and ".join(f"{c} between {a!r} and {b!r}" for c, (a, b) in ranges.items())).count()
        some = stored.where(F.col("shard").isin(need))
        assert 0 < wanted(some) == wanted(stored)
        assert len(some.inputFiles()) == 16 and len(need) <= 12  # files listed; the scan opens those of the needed folders
        assert "PartitionFilters: [" in some._jdf.queryExecution().toString()


def plain_rates(members, targets, budget, low, high, steps=4000):
    """Projected gradient on the same objective with lists."""
    r = [max(1.0, low)] * len(members)
    goal = [t * budget for t in targets]
    start = [sum(max(1.0, low) * w * p[d] for w, p in members) for d in range(len(goal))]
    pace = 1 / max(s / max(1.0, low) / g for s, g in zip(start, goal, strict=True))
    for _ in range(steps):
        s = [sum(x * w * p[d] for x, (w, p) in zip(r, members, strict=True)) for d in range(len(goal))]
        slope = [a / g - 1 for a, g in zip(s, goal, strict=True)]
        r = [min(max(x - pace * sum(q * y for q, y in zip(p, slope, strict=True)), low), high) for x, (w, p) in zip(r, members, strict=True)]
    return r


def test_rates_meet_targets(spark):
    rng = random.Random(8)
    members = []
    for _ in range(200):
        a = rng.random() ** 3
        b = rng.random()
        members.append((rng.randrange(1, 400), (a, (1 - a) * b, (1 - a) * (1 - b))))
    df = spark.createDataFrame([(i, w, *p) for i, (w, p) in enumerate(members)], "doc_id long, tokens long, p0 double, p1 double, p2 double")
    targets = [0.4, 0.4, 0.2]
    got = sorted(mixing.fit_rates(df, targets).collect(), key=lambda r: r["doc_id"])
    total = sum(w for w, _ in members)
    for d, t in enumerate(targets):
        assert sum(r["rate"] * r["tokens"] * r[f"p{d}"] for r in got) == pytest.approx(t * total, rel=2e-3)
    want = plain_rates(members, targets, total, 0.0, 16.0)
    assert [r["rate"] for r in got] == pytest.approx(want, abs=0.02)
    floor = mixing.fit_rates(df, targets, min_rate=1.0).collect()
    assert min(r["rate"] for r in floor) >= 1.0
    sums = [sum(r["rate"] * r["tokens"] * r[f"p{d}"] for r in floor) for d in range(3)]
    assert [s / sum(sums) for s in sums] == pytest.approx(targets, abs=0.02)
    assert [s / sum(sums) for s in sums] == pytest.approx(targets, rel=1e-3)


def test_mixing_end_to_end(spark, odd_docs, clashing, no_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["fine", "good", "nice"]) + ("%%" if i % 3 == 0 else "") for _ in range(rng.randrange(1, 60)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "bad" if i % 3 == 0 else "ok") for i in range(0, 90, 2)], "doc_id long, domain string")
    mixed = mixing.mix_to_targets(docs, labels, {"ok": 0.5, "bad": 0.5}).collect()
    for r in mixed:
        assert (r["p1"] > 0.5) == (r["doc_id"] % 3 == 0) and r["tokens"] == len(rows[r["doc_id"]][1].split())
        assert r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
    ok, bad = (sum(r["rate"] * r["tokens"] * r[p] for r in mixed) for p in ("p0", "p1"))
    assert ok == pytest.approx(bad, rel=2e-3)
    out = mixing.apply_mix(docs, mixing.mix_to_targets(docs, labels, {"ok": 0.5, "bad": 0.5}))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    for odd in (odd_docs, clashing):
        m = mixing.mix_to_targets(odd, labels, {"ok": 0.5, "bad": 0.5}, min_rate=1.0)
        assert m.count() == 11 and {r["doc_id"] for r in mixing.apply_mix(odd, m).select("doc_id").distinct().collect()} == {r["doc_id"] for r in odd.select("doc_id").distinct().collect()}
        assert mixing.apply_mix(odd, m).columns == odd.columns
    named = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in ("times", "serial", "_copies", "_i", "copies")))
    out = mixing.apply_mix(named, mixing.mix_to_targets(docs, labels, {"ok": 0.5, "bad": 0.5}))
    assert out.columns == named.columns and all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in named.columns[2:])
    assert mixing.mix_to_targets(no_docs, labels, {"ok": 0.5, "bad": 0.5}).count() == 0
    none = labels.where("false")
    assert {r["rate"] for r in mixing.mix_to_targets(odd_docs, none, {"ok": 1.0}).collect()} == {1.0}


def test_posteriors_against_plain_counts(spark):
    """Posteriors by the definition, under the fitted weight of evidence; the fitted weight beats plain sums on labels that taught nothing."""
    rng = random.Random(7)
    words = {"a": ["aab", "ccd", "eef"], "b": ["ggh", "ccd", "iij"]}
    rows, truth = [], []
    for i in range(160):
        d = rng.choice("ab")
        mostly = words[d] if rng.random() < 0.8 else words["ab".replace(d, "")]
        rows.append((i, " ".join([rng.choice(mostly)] * rng.randrange(0, 40))))  # one word over and over: far from independent
        truth.append((i, d))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(truth, "doc_id long, domain string")
    chosen, endings = mixing._known_endings(docs, labels, ["a", "b"], 1000, 64)
    part = {r["doc_id"]: r["part"] for r in chosen.collect()}
    weights, priors, floor = mixing._classifier(chosen, endings, ["a", "b"], 64)
    scale, damp = mixing._calibrated(chosen, endings, weights, ["a", "b"], priors, floor)
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in {x[-2:] for v in words.values() for x in v}], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("b")).collect()}
    counts = {"a": Counter(), "b": Counter()}
    for (i, t), (_, d) in zip(rows, truth, strict=True):
        if part[i] < 3:
            counts[d].update(bucket[w[-2:]] for w in t.split())
    like = {d: lambda x, c=c: math.log((c[x] + 1) / (c.total() + 64)) for d, c in counts.items()}
    prior = {d: math.log((sum(x[1] == d for x in truth) + 1) / 162) for d in "ab"}

    def posterior(t, scale, damp):
        n = len(t.split())
        s = {d: prior[d] + scale * max(n, 1) ** -damp * sum(like[d](bucket[w[-2:]]) for w in t.split()) for d in "ab"}
        return 1 / (1 + math.exp(min(s["b"] - s["a"], 700.0)))

    got = {r["doc_id"]: r for r in mixing.domain_posteriors(docs, labels, ["a", "b"], 1000, 64).collect()}
    for i, t in rows:
        assert got[i]["tokens"] == len(t.split()) and got[i]["p0"] == pytest.approx(posterior(t, scale, damp), abs=1e-9) and got[i]["p0"] + got[i]["p1"] == pytest.approx(1)
    loss = lambda scale, damp: -sum(math.log(max(p if d == "a" else 1 - p, 1e-300)) for (i, t), (_, d) in zip(rows, truth, strict=True) if part[i] == 3 and t for p in [posterior(t, scale, damp)])
    assert loss(scale, damp) == pytest.approx(min(loss(*g) for g in mixing.GRID)) and loss(scale, damp) < loss(1.0, 0.0)


def test_report_tells_shares_and_residuals(spark):
    df = spark.createDataFrame([(1, 10, 1.0, 0.0, 2.0), (2, 10, 0.0, 1.0, 1.0)], "doc_id long, tokens long, p0 double, p1 double, rate double")
    got = {r["domain"]: r for r in mixing.mix_report(df, {"x": 1.0, "y": 1.0}).collect()}
    assert got["x"]["share"] == pytest.approx(2 / 3) and got["x"]["residual"] == pytest.approx(1 / 3) and got["y"]["target"] == 0.5
    assert mixing.mix_report(df.where("false"), {"x": 1.0}).first()["share"] is None


def plain_leaks(docs, items, k=5, percent=80):
    out = {}
    for i, t in docs:
        w = words_of((t or "").encode())
        for n, b in items:
            x = words_of((b or "").encode())
            if not x or not w:
                continue
            width = min(k, len(x))
            item = Counter(tuple(x[j : j + width]) for j in range(len(x) - width + 1))
            best = 0.0
            for s in range(max(len(w) - len(x), 0) + 1):
                win = w[s : s + len(x)]
                if len(win) < width:
                    continue
                have = Counter(tuple(win[j : j + width]) for j in range(len(win) - width + 1))
                both = (have & item).total()
                whole = have.total() + item.total() - both
                if 100 * both >= percent * whole:
                    best = max(best, both / whole)
            if best:
                out[(i, n)] = best
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    v = [f"q{i}" for i in range(60)]
    items = [(n, " ".join(rng.choice(v) for _ in range(rng.choice([1, 3, 5, 6, 20, 40, 58])))) for n in range(25)] + [(90, None), (91, ""), (92, "A A a a a a A a a a")]
    docs = []
    for i in range(120):
        w = [rng.choice(v + [f"z{rng.randrange(500)}"]) for _ in range(rng.randrange(0, 80))]
        if i % 2:
            x = words_of((rng.choice(items)[1] or "").encode())
            x = [y.decode() for y in x]
            if x and i % 3 == 0:
                x[rng.randrange(len(x))] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = x[: len(x) - (i % 5 == 0)]
        docs.append((i, "\n".join(w)))
    docs += [(500, None), (501, "a " * 30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(docs, items)
    assert len(want) > 40
    for rows in (20_000, 6):
        got = dc.contaminated(d, b, item_rows=rows).collect()
        assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got} == want
        kept = {r["doc_id"] for r in dc.drop_contaminated(d, b, item_rows=rows).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_leak_edge_cases(spark, odd_docs, clashing, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked"), (None, "der hund und die katze sind hier"), (3, None)], "item_id long, text string")
    none = items.where("false")
    for docs in (odd_docs, clashing):
        got = Counter((r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect())
        assert got == {(1, 1): 1, (6, 1): 2, (None, None): 1}
        out = dc.drop_contaminated(docs, items)
        assert out.columns == docs.columns and out.count() == 8
        assert dc.contaminated(docs, none).count() == 0 and dc.drop_contaminated(docs, none).count() == 12
    assert dc.contaminated(no_docs, items).count() == 0


def test_hamming_lookup_is_complete_and_selective():
    import numpy as np

    rng = np.random.default_rng(4)
    stored = rng.integers(0, 1 << 64, (400, dc.BITS // 64), dtype=np.uint64)
    index = dc.Hamming(stored)
    looked = 0
    for _ in range(60):
        bits = np.unpackbits(stored[rng.integers(400)].view(np.uint8), bitorder="little")
        bits[rng.choice(dc.BITS, rng.integers(0, 80), replace=False)] ^= 1
        x = np.packbits(bits, bitorder="little").view(np.uint64)
        want = np.flatnonzero(np.bitwise_count(stored ^ x).sum(axis=1) <= dc.RADIUS)
        assert index.within(x).tolist() == want.tolist()
        looked += len(index.candidates(x))
    assert looked < 0.2 * 60 * 400


def test_long_items_whose_copies_end_in_repeats():
    rng = random.Random(2)
    for n in (100, 200, 450):
        words = [f"q{rng.randrange(400)}".encode() for _ in range(n)]
        items = dc.Items([(1, b" ".join(words))])
        changed = words[: -(n // 12)] + [b"again"] * (n // 12)
        found = dc.matches(items, [b"before"] * 7 + changed)
        want = plain_leaks([(0, (b"before " * 7 + b" ".join(changed)).decode())], [(1, b" ".join(words).decode())])
        assert [x[1] for x in found] == pytest.approx(list(want.values())) and len(found) == 1

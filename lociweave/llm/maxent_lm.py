"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax, and whole-word contexts over it.

Tokens are words and one end per text. The most frequent words are symbols of their own, put into classes of equal width by
rank; every other word belongs to one of ``TAIL`` tail classes by its last byte. The model is

    P(word | two words before) = P(class | features) * P(word | class, features)

with log-linear factors over hashed features of the two symbols before: a bias, the nearest symbol, both symbols, and the
farther one alone (skip). Inside a tail class, words follow its add-one unigram counts with one place for all unseen words,
so probabilities sum to one over an open vocabulary. This symbol model has a fixed size; it is the prior P0 of the whole-word
model, which grows with the corpus and has the scores:

    P(word | words before) = (n(last word, word) + WORD_PRIOR * P0) / (n(last word) + WORD_PRIOR)

Every training word is a context and an output of its own there, without hashing into fewer places (words are told apart by 64
bits, pairs by 48 bits within a bucket of ``BUCKET_TOKENS``). It is the log-linear model with one feature for each pair of words seen, at its maximum under a Dirichlet prior around P0,
so it needs no steps and sums to one where P0 does. The word before the last counts through its symbol in P0 only.

Three passes read the texts. One counts words. One counts (two symbols, next symbol), at most 2**24 cells whatever the
input; the likelihood depends on the corpus through these counts alone, so each training step is a full-corpus gradient
computed by tasks over the cells and added up, until a step gains less than ``CONVERGED`` nats a token. The last pass scores texts in
numpy batches: only the contexts that occur in a batch get their softmax. It also deals every token's pair and P0 by hash into
buckets of about ``BUCKET_TOKENS``, packed as arrays, where pairs are counted; gains go back, packed too, and are added up by text. Counts of the ``DIRECT_WORDS`` most frequent words travel by broadcast, which is their size
bound; rarer words meet their counts in a shuffled join.

Defined results: a null or empty text is its end token; rows with a null doc_id teach; repeated rows are scored (and
counted) each for itself; without training rows all scores are 0. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import as_bytes, held_out, map_batches
from lociweave.llm.shingles import mix, window_hashes
from lociweave.plans.runtime import materialize

HEAD, TAIL, WIDTH = 240, 16, 16
CLASSES = HEAD // WIDTH
SYMBOLS = HEAD + TAIL
HASH_BITS = 11
#: Training ends at the step that gains less, in nats a training token.
CONVERGED = 1e-3
PACE = 0.45
PRIOR = 2.0
PARTS = 4
#: Weight of the symbol model beside a word's counts as context.
WORD_PRIOR = 200.0
BUCKET_TOKENS = 2_000_000
DIRECT_WORDS = 150_000
_FLUSH_WORDS = 400_000
#: Steps a unit of log10 in which a token's prior travels; three bytes reach 32 units.
_FINE = 1 << 19
_CHUNK = 1 << 20
#: The end token; no word can be a line feed.
END = b"\n"
_END_HASH = np.ones(1, dtype=np.uint64)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(raw: bytes) -> list[bytes]:
    out = raw.lower().split()
    out.append(END)
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """word and n over all training tokens."""

    def kernel(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for rb in batches:
            for raw in rb.column("raw"):
                held.update(tokens_of(raw.as_py()))
                if len(held) > _FLUSH_WORDS:
                    yield flush()
        yield flush()

    return map_batches(train.select("raw"), kernel, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words at or above the lowest frequency that at most ``most`` words reach, most frequent first, ties by word.

    The frequency is found in a histogram with eight steps a doubling, so only the chosen words come to the driver.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    histogram = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    lowest, words = None, 0
    for s, k in histogram:
        if words + k > most:
            break
        lowest, words = s, words + k
    if lowest is None:
        return []
    got = counts.where(step >= lowest).toArrow()
    return sorted(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


class Symbols:
    """Symbol of each token: its own if it is a head word, else that of its tail class."""

    def __init__(self, head: list[bytes]) -> None:
        self.head = {w: i for i, w in enumerate(head)}

    def __call__(self, tokens: list[bytes]) -> list[int]:
        get = self.head.get
        return [s if (s := get(w)) is not None else HEAD + (w[-1] & (TAIL - 1)) for w in tokens]


def contexts_of(symbols: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Two symbols before each position as one number; texts begin after two ends (symbol 0)."""
    near, far = np.zeros_like(symbols), np.zeros_like(symbols)
    near[1:], far[2:] = symbols[:-1], symbols[:-2]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    near[begin] = 0
    far[begin] = 0
    second = begin + 1
    far[second[second < len(symbols)]] = 0
    return far * SYMBOLS + near


def cell_counts(train: DataFrame, head: list[bytes]) -> DataFrame:
    """ctx, sym, n: how often a symbol followed two symbols."""
    shared = train.sparkSession.sparkContext.broadcast(head)

    def kernel(batches):
        symbols = Symbols(shared.value)
        ids: list[int] = []
        lengths: list[int] = []

        def flush():
            s = np.array(ids, dtype=np.int32)
            code, n = np.unique(contexts_of(s, lengths) * SYMBOLS + s, return_counts=True)
            ids.clear()
            lengths.clear()
            return pa.RecordBatch.from_pydict({"ctx": pa.array((code // SYMBOLS).astype(np.int32)), "sym": pa.array((code % SYMBOLS).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

        for rb in batches:
            for raw in rb.column("raw"):
                got = symbols(tokens_of(raw.as_py()))
                ids += got
                lengths.append(len(got))
                if len(ids) > 4 * _CHUNK:
                    yield flush()
        if ids:
            yield flush()

    return map_batches(train.select("raw"), kernel, "ctx int, sym int, n long").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def feature_rows(ctx: np.ndarray) -> np.ndarray:
    """Buckets of the four features of each context; bucket 0 is the bias."""
    near, far = (ctx % SYMBOLS).astype(np.uint64), (ctx // SYMBOLS).astype(np.uint64)
    room = np.uint64((1 << HASH_BITS) - 1)
    kinds = (near, near * np.uint64(SYMBOLS) + far, far)
    hashed = [mix(k + np.uint64((i + 1) << 40)) % room + np.uint64(1) for i, k in enumerate(kinds)]
    return np.stack([np.zeros(len(ctx), dtype=np.int64), *(h.astype(np.int64) for h in hashed)], axis=1)


class Weights:
    """For each bucket a weight per class (head classes, then tail classes) and per head word."""

    def __init__(self, marginal: np.ndarray) -> None:
        smooth = marginal + 0.5
        words = smooth[:HEAD].reshape(CLASSES, WIDTH)
        classes = np.concatenate([words.sum(axis=1), smooth[HEAD:]])
        self.classes = np.zeros((1 << HASH_BITS, CLASSES + TAIL), dtype=np.float32)
        self.words = np.zeros((1 << HASH_BITS, HEAD), dtype=np.float32)
        self.classes[0] = np.log(classes / classes.sum())
        self.words[0] = np.log(words / words.sum(axis=1, keepdims=True)).ravel()

    def factors(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows, log P(class) and log P(word | class) of each context."""
        rows = feature_rows(ctx)
        c, w = self.classes[rows[:, 0]], self.words[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            c = c + self.classes[rows[:, j]]
            w = w + self.words[rows[:, j]]
        w = w.reshape(len(ctx), CLASSES, WIDTH)
        for x in (c, w):
            x -= x.max(axis=-1, keepdims=True)
            x -= np.log(np.exp(x).sum(axis=-1, keepdims=True))
        return rows, c, w

    def log10(self, ctx: np.ndarray) -> np.ndarray:
        """log10 P of every symbol after each context."""
        _, c, w = self.factors(ctx)
        return np.concatenate([(c[:, :CLASSES, None] + w).reshape(len(ctx), HEAD), c[:, CLASSES:]], axis=1) / np.log(10)


def gradient_parts(weights: Weights, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts of (feature, output) as observed and as the model expects them, classes before words; and the log-likelihood."""
    width = CLASSES + TAIL + HEAD
    seen, expected, fit = np.zeros((1 << HASH_BITS, width), dtype=np.float32), np.zeros((1 << HASH_BITS, width), dtype=np.float32), 0.0
    distinct, place = np.unique(ctx, return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, sym, n = place[order], sym[order], n[order]
    for at in range(0, len(distinct), 4096):
        some = distinct[at : at + 4096]
        lo, hi = np.searchsorted(place, [at, at + len(some)])
        often = np.zeros((len(some), SYMBOLS))
        np.add.at(often, (place[lo:hi] - at, sym[lo:hi]), n[lo:hi])
        rows, c, w = weights.factors(some)
        words = often[:, :HEAD].reshape(len(some), CLASSES, WIDTH)
        classes = np.concatenate([words.sum(axis=2), often[:, HEAD:]], axis=1)
        fit += float((classes * c).sum() + (words * w).sum())
        was = np.concatenate([classes, often[:, :HEAD]], axis=1).astype(np.float32)
        will = np.concatenate([classes.sum(axis=1, keepdims=True) * np.exp(c), (classes[:, :CLASSES, None] * np.exp(w)).reshape(len(some), HEAD)], axis=1).astype(np.float32)
        for j in range(rows.shape[1]):
            np.add.at(seen, rows[:, j], was)
            np.add.at(expected, rows[:, j], will)
    return seen, expected, fit


def train(cells: DataFrame, marginal: np.ndarray, steps: int | None = None) -> tuple[Weights, list[float]]:
    """Scaled full-batch gradient ascent, to convergence or so many steps; each adds up the tasks' parts. Also the log-likelihood before each step."""
    spark = cells.sparkSession
    weights, fits = Weights(marginal), []
    seen = None
    for n in count():
        if n == steps or steps is None and n > 1 and fits[-1] - fits[-2] < CONVERGED * marginal.sum():
            break
        shared = spark.sparkContext.broadcast(weights)
        first = seen is None

        def kernel(batches, shared=shared, first=first):
            got = [(rb.column("ctx").to_numpy(), rb.column("sym").to_numpy(), rb.column("n").to_numpy()) for rb in batches if rb.num_rows]
            if got:
                was, will, fit = gradient_parts(shared.value, *(np.concatenate([g[i] for g in got]) for i in range(3)))
                yield pa.RecordBatch.from_pydict({"fit": pa.array([fit]), "seen": pa.array([was.tobytes() if first else b""], pa.binary()), "expected": pa.array([will.tobytes()], pa.binary())})

        expected, fit = np.zeros((1 << HASH_BITS, CLASSES + TAIL + HEAD)), 0.0
        if first:
            seen = np.zeros_like(expected)
        for row in map_batches(cells, kernel, "fit double, seen binary, expected binary").toLocalIterator():
            fit += row["fit"]
            expected += np.frombuffer(row["expected"], np.float32).reshape(expected.shape)
            if first:
                seen += np.frombuffer(row["seen"], np.float32).reshape(expected.shape)
        fits.append(fit)
        step = PACE * (seen - expected) / ((seen + expected) / 2 + PRIOR)
        weights.classes += step[:, : CLASSES + TAIL].astype(np.float32)
        weights.words += step[:, CLASSES + TAIL :].astype(np.float32)
        shared.destroy()
    return weights, fits


_TEXTS = "row_id long, doc_id long, held_out boolean, n_tokens long, base double, known long, model double, rare array<struct<word:binary,times:long>>"
_CARRIED = "chunk long, row_id long, doc_id long, held_out boolean, n_tokens long, base double, known long, model double, rare binary, times binary"
_PACKED = ("counts", np.int32), ("taught", np.bool_), ("pairs", np.uint16), ("prior", np.uint8), ("words", np.uint64)
_ROWS = [
    ("chunk", pa.int64()), ("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("base", pa.float64()), ("known", pa.int64()), ("model", pa.float64()),
    ("rare", pa.binary()), ("times", pa.binary()),
]
_SCORED = pa.schema([("key", pa.int32()), *_ROWS, *((k, pa.binary()) for k, _ in _PACKED)])
_GAINED = pa.schema([*_ROWS, ("at", pa.binary()), ("gain", pa.binary())])


def _rare_words(rare: list[bytes], times: list[bytes]) -> pa.ListArray:
    """The rarer words of each text, which travel in one string parted by spaces, with their frequencies, which travel in 32 bits each."""
    words = [x.split(b" ") if x else [] for x in rare]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32))
    often = pa.array(np.frombuffer(b"".join(times), np.uint32).astype(np.int64))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array([x for w in words for x in w], pa.binary()), often], ["word", "times"]))


def _filled(rb: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with the columns of ``schema``, null where it has none."""
    return pa.RecordBatch.from_arrays([rb.column(f.name) if f.name in rb.schema.names else pa.nulls(rb.num_rows, f.type) for f in schema], schema=schema)


def _three_bytes(x: np.ndarray) -> np.ndarray:
    """The lower three bytes of each number of 32 bits."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]


def _from_three_bytes(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
    wide[:, :3] = raw.reshape(-1, 3)
    return wide.view("<u4").ravel()


def _packed(first: int, lengths: list[int], taught: np.ndarray, words: np.ndarray, prior: np.ndarray, rare: np.ndarray, buckets: int) -> pa.RecordBatch:
    """For each bucket the tokens of consecutive rows: tokens by row, whether the row teaches, pairs, log10 P0 and, of rare words only, the words.

    A rare word lacks its own count in ``prior``; all its tokens go to one bucket, which counts it. Of a pair's hash the upper 48 bits
    travel, which tell pairs apart within their bucket; log10 P0 travels as a multiple of 1 / ``_FINE`` in three bytes.
    """
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = _END_HASH
    pairs = mix(before * _PAIR + words)
    row = np.repeat(np.arange(len(lengths)), lengths)
    key = np.where(rare, words, pairs) % np.uint64(buckets)
    place = (key * np.uint64(2) + rare).astype(np.int64)
    order = np.argsort(place, kind="stable")
    row, pairs, words, prior = row[order], pairs[order], words[order], prior[order]
    ends = np.searchsorted(place[order], np.arange(2 * buckets + 1))
    prior = _three_bytes(np.clip(np.rint(-prior.astype(np.float64) * _FINE), 0, (1 << 24) - 1))
    short = np.ascontiguousarray(pairs).view(np.uint16).reshape(-1, 4)[:, 1:]
    out = {k: [] for k in ("key", "chunk", "row_id", *(k for k, _ in _PACKED))}
    for b in np.flatnonzero(np.diff(ends)).tolist():
        at = slice(ends[b], ends[b + 1])
        low = int(row[at][0])
        counts = np.bincount(row[at] - low)
        values = counts.astype(np.int32), taught[low : low + len(counts)], short[at], prior[at], words[at if b % 2 else slice(0)]
        for k, v in zip(out, (b // 2, first, first + low, *(v.tobytes() for v in values)), strict=True):
            out[k].append(v)
    schema = pa.schema([("key", pa.int32()), ("chunk", pa.int64()), ("row_id", pa.int64()), *((k, pa.binary()) for k, _ in _PACKED)])
    return pa.RecordBatch.from_pydict(out, schema)


def _pair_gains(parts: list[dict], word_prior: float) -> pa.RecordBatch:
    """For each packed part of one bucket and kind its chunk, rows of it, and their sums of log10(1 + n(pair) / (word_prior * P0))."""
    counts, taught, pairs, prior, words = ([np.frombuffer(p[k], t) for p in parts] for k, t in _PACKED)
    ends = np.cumsum([len(c) for c in counts])
    counts = np.concatenate(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    taught, prior, words = np.concatenate(taught)[row], _from_three_bytes(np.concatenate(prior)) / -_FINE, np.concatenate(words)
    if len(words):
        _, of = np.unique(words, return_inverse=True)
        prior = prior + np.log10(np.bincount(of, weights=taught)[of] + 1)
    wide = np.zeros((len(row), 4), dtype=np.uint16)
    wide[:, 1:] = np.concatenate(pairs).reshape(-1, 3)
    _, of = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    gain = np.log1p(np.bincount(of, weights=taught)[of] / word_prior * 10**-prior) / np.log(10)
    gain = np.bincount(row, weights=gain, minlength=len(counts))
    out: dict[str, list] = {"chunk": [], "at": [], "gain": []}
    for p, begin, end in zip(parts, np.concatenate([[0], ends[:-1]]), ends, strict=True):
        some = np.flatnonzero(counts[begin:end])
        out["chunk"].append(p["chunk"])
        rows = some + (p["row_id"] - p["chunk"])
        out["at"].append(np.diff(rows, prepend=0).astype(np.uint32).astype(np.uint16 if rows[-1] < 1 << 16 else np.uint32).tobytes())
        out["gain"].append(gain[begin:end][some].astype(np.float32).tobytes())
    return pa.RecordBatch.from_pydict(out, pa.schema([("chunk", pa.int64()), ("at", pa.binary()), ("gain", pa.binary())]))


def _score_batches(docs: DataFrame, weights: Weights, head: list[bytes], direct: dict[bytes, tuple[float, float]], tail_room: np.ndarray, buckets: int, word_prior: float) -> DataFrame:
    """Per row: row_id, n_tokens, sums over tokens with broadcast counts, the model's part with the gain from counted pairs, and the rarer words
    with their frequencies.

    Tokens go to the buckets of their pairs, and gains come back to the chunk of texts they are from, packed by bucket and chunk both
    ways: no row travels for a token, or for a text and bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights, head, direct, tail_room))

    def kernel(batches):
        weights, head, direct, tail_room = shared.value
        symbols = Symbols(head)
        serial = TaskContext.get().partitionId() << 33

        def finish(rows, ids, lengths, own, hashes):
            s = np.array(ids, dtype=np.int32)
            ctx = contexts_of(s, lengths)
            here = np.flatnonzero(np.bincount(ctx, minlength=SYMBOLS * SYMBOLS))
            number = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int32)
            number[here] = np.arange(len(here), dtype=np.int32)
            table = np.empty((len(here), SYMBOLS))
            for at in range(0, len(here), 4096):
                table[at : at + 4096] = weights.log10(here[at : at + 4096])
            table[:, HEAD:] -= tail_room
            each = table[number[ctx], s]
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            cols = list(zip(*rows, strict=True))
            rare, times = [b" ".join(t) for t in cols[6]], [np.array(list(t.values()), dtype=np.uint32).tobytes() for t in cols[6]]
            done = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), (cols[0][0] >> 33) % buckets), pa.int32()), pa.array(np.full(len(rows), cols[0][0]), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(lengths, pa.int64()), pa.array(cols[3], pa.float64()),
                 pa.array(cols[4], pa.int64()), pa.array(cols[5] + np.add.reduceat(each, begin), pa.float64()), pa.array(rare, pa.binary()), pa.array(times, pa.binary())],
                ["key", "chunk", "row_id", "doc_id", "held_out", "n_tokens", "base", "known", "model", "rare", "times"],
            )
            own = np.array(own)
            lacks = np.isnan(own)
            packed = _packed(cols[0][0], lengths, ~np.array(cols[2], dtype=bool), np.concatenate(hashes), np.where(lacks, each, each + own).astype(np.float32), lacks, buckets)
            return [_filled(rb, _SCORED) for rb in (done, packed)]

        head_of, none = symbols.head, (np.nan, 0.0)
        rows, ids, lengths, own, hashes = [], [], [], [], []
        for rb in batches:
            for doc, out, raw in zip(rb.column("doc_id").to_pylist(), rb.column("held_out").to_pylist(), rb.column("raw"), strict=True):
                raw = raw.as_py()
                tokens = tokens_of(raw)
                base, tail, known, rare = 0.0, 0.0, 0, {}
                for w, n in Counter(tokens).items():
                    found = direct.get(w)
                    if found is None:
                        rare[w] = n
                    else:
                        base += n * found[0]
                        tail += n * found[1]
                        known += n
                        if w not in head_of:
                            tail += n * found[0]
                rows.append((serial, doc, out, base, known, tail, rare))
                serial += 1
                ids += symbols(tokens)
                own += [0.0 if w in head_of else direct.get(w, none)[0] for w in tokens]
                hashes += [window_hashes(raw, 1), _END_HASH]
                lengths.append(len(tokens))
                if len(ids) > _CHUNK:
                    yield from finish(rows, ids, lengths, own, hashes)
                    rows, ids, lengths, own, hashes = [], [], [], [], []
        if rows:
            yield from finish(rows, ids, lengths, own, hashes)

    def count_pairs(batches):
        held = defaultdict(list)
        for rb in batches:
            done = rb.filter(rb.column("n_tokens").is_valid())
            if done.num_rows:
                yield _filled(done, _GAINED)
            for part in rb.filter(rb.column("n_tokens").is_null()).select(["key", "chunk", "row_id", *(k for k, _ in _PACKED)]).to_pylist():
                held[part["key"], bool(part["words"])].append(part)
        while held:
            yield _filled(_pair_gains(held.popitem()[1], word_prior), _GAINED)

    def add_gains(batches):
        texts, sums = [], {}
        for rb in batches:
            done = rb.filter(rb.column("n_tokens").is_valid())
            if done.num_rows:
                texts.append(done)
            parts = rb.filter(rb.column("n_tokens").is_null())
            for chunk, at, gain in zip(parts.column("chunk").to_pylist(), parts.column("at").to_pylist(), parts.column("gain").to_pylist(), strict=True):
                gains = np.frombuffer(gain, np.float32)
                rows = np.cumsum(np.frombuffer(at, np.uint16 if len(at) == 2 * len(gains) else np.uint32), dtype=np.int64)
                whole = sums.get(chunk)
                if whole is None or len(whole) <= rows[-1]:
                    grown = np.zeros(2 * (int(rows[-1]) + 1))
                    if whole is not None:
                        grown[: len(whole)] = whole
                    whole = sums[chunk] = grown
                whole[rows] += gains  # ascending and distinct within a part
        while texts:
            done = texts.pop()
            chunk, row = done.column("chunk").to_numpy(), done.column("row_id").to_numpy()
            model = done.column("model").to_numpy() + np.array([sums[c][r - c] for c, r in zip(chunk.tolist(), row.tolist(), strict=True)])
            done = done.set_column(done.schema.get_field_index("model"), "model", pa.array(model))
            done = done.set_column(done.schema.get_field_index("rare"), "rare", _rare_words(done.column("rare").to_pylist(), done.column("times").to_pylist()))
            yield done.select([k for k, _ in _ROWS[1:-1]])

    packed = map_batches(docs, kernel, f"key int, {_CARRIED}, {', '.join(f'{k} binary' for k, _ in _PACKED)}")
    gained = map_batches(packed.repartition(buckets, "key"), count_pairs, f"{_CARRIED}, at binary, gain binary")
    return map_batches(gained.repartition(buckets, "chunk"), add_gains, _TEXTS)


def score(docs: DataFrame, modulus: int = 7, kept_back: int = 2, direct_words: int = DIRECT_WORDS, steps: int | None = None, word_prior: float = WORD_PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus, kept_back).alias("held_out"))
    taught = rows.where(~F.col("held_out"))
    counts = materialize(word_counts(taught), "words")
    last = F.conv(F.hex(F.expr("substring(word, -1, 1)")), 16, 10).cast("int") % TAIL
    by_tail = {r["t"]: (r["n"], r["v"]) for r in counts.groupBy(last.alias("t")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, kinds = sum(x[0] for x in by_tail.values()), sum(x[1] for x in by_tail.values())
    top = frequent_words(counts, direct_words)
    head = [END] + [w for w, _ in top if w != END][: HEAD - 1]
    often = dict(top)
    mine = set(head)
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for t, (n, v) in by_tail.items():
        tail_n[t], tail_v[t] = n, v
    for w in mine & often.keys():
        tail_n[w[-1] & (TAIL - 1)] -= often[w]
        tail_v[w[-1] & (TAIL - 1)] -= 1
    ends = often.get(END)
    if ends is None and total:  # too many words are as frequent as ends
        ends = counts.where(F.col("word") == F.lit(END)).first()["n"]
        often[END] = ends
        tail_n[END[-1] & (TAIL - 1)] -= ends
        tail_v[END[-1] & (TAIL - 1)] -= 1
    marginal = np.concatenate([[often.get(w, 0) for w in head], np.zeros(HEAD - len(head)), tail_n])
    cells = materialize(cell_counts(taught, head).repartition(PARTS, "ctx"), "cells")
    weights, _ = train(cells, marginal, steps)
    direct = {w: (float(np.log10(n + 1)), float(-np.log10(n / word_prior + 1))) for w, n in often.items()}
    parts = materialize(_score_batches(rows, weights, head, direct, np.log10(tail_n + tail_v + 1), total // BUCKET_TOKENS + 1, word_prior), "scored")
    rare = parts.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.times")
    # A text's contexts are its own tokens: its end goes before the first word instead of after the last.
    found = rare.join(counts, "word").select("row_id", (F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), "times", (-F.col("times") * F.log10(F.col("n") / word_prior + 1.0)).alias("gain"))
    met = found.groupBy("row_id").agg(F.sum("more").alias("more"), F.sum("times").alias("met"), F.sum("gain").alias("gain"))
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("more", zero) - F.col("n_tokens") * float(np.log10(total + kinds + 1))
    model = F.col("model") + F.coalesce("more", zero) + F.coalesce("gain", zero)
    return parts.drop("rare").join(met, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (model if total else zero).alias("score"),
    )

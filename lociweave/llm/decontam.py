"""Benchmark decontamination by SimHash fingerprints of item-sized windows, confirmed by weighted shingle similarity.

A window of a document has as many words as the benchmark item it is held against (the whole document if it is shorter). Its
256-bit SimHash adds up the signs of its five-word shingles, each occurrence of one being an element of its own; sums of a
window come from running sums over the document, and are made anew where a shingle repeats within the window. Items of each
length are indexed by 16 blocks of 16 bits: fingerprints within ``RADIUS`` bits differ by at most three bits in some block, so
the lookup returns every item within the radius while it looks at about a sixth of unrelated ones. Each such pair is
confirmed by the exact Jaccard similarity of shingles weighted by their occurrences, at ``percent`` or more.

Only windows that overlap a shingle of an item of their length are fingerprinted. That loses nothing: a window without a
shared shingle has similarity 0. At weighted similarity 0.8 the cosine of the elements is 8/9 or more, whatever the lengths, so a bit
differs with probability 0.152 or less: 39 bits expected, 5.7 deviation, and odds of about one in 100,000 to miss a pair at the
threshold itself, less above it.

Items with fewer words than a shingle are one shingle of all their words, held against windows of their own length. Items
without words match nothing. Benchmarks beyond ``ITEM_ROWS`` items or ``ITEM_BYTES`` are taken in blocks, each a pass over the
documents, so what is broadcast is bounded (but for a single item longer than that). Defined results: null or empty texts match nothing; repeated rows match each for itself; of several windows for
one document and item the most similar is reported, ties to the first. Only doc_id, text and item_id are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import as_bytes, keep_rows, map_batches
from lociweave.llm.shingles import mix, words_of

WORDS = 5
PERCENT = 80
BITS = 256
BLOCKS = BITS // 16
#: 4.2 deviations above the expected distance at similarity 0.8, and 3 bits in the nearest block.
RADIUS = 63
#: A pass over the documents holds so many items and bytes of them at most.
ITEM_ROWS, ITEM_BYTES = 20_000, 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))
#: Numbers that the tables of one item length hold before they begin anew; an entry counts as ``_ENTRY`` more for its keeping.
_TABLE_NUMBERS, _ENTRY = 200_000, 26
_NONE = np.empty(0, dtype=np.int64)
#: Words of a text that are worked on at once, so that a very long text takes no more memory than others.
_STRETCH = 4096


def _word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def _shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    m = len(words) - k + 1
    h = np.zeros(max(m, 0), dtype=np.uint64)
    for i in range(k):
        h = mix(h * _STEP + words[i : i + m]) if m > 0 else h
    return h


def _elements(hashes: np.ndarray) -> np.ndarray:
    """Each occurrence of a shingle as an element of its own, so that weighted similarity is that of plain sets of elements."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    nth = np.empty(len(h), dtype=np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.where(nth > 0, mix(hashes + nth * _STEP), hashes)


def _signs(elements: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of ``BITS`` bits of each element."""
    wide = mix(elements[:, None] + _SEEDS)
    bits = np.unpackbits(wide.view(np.uint8).reshape(len(elements), BITS // 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)


def simhash(hashes: np.ndarray) -> np.ndarray:
    return _packed(_signs(_elements(hashes)).sum(axis=0, keepdims=True))[0]


class Hamming:
    """All stored fingerprints within a radius.

    A fingerprint is ``BLOCKS`` blocks of 16 bits. Two within the radius differ by at most ``radius // BLOCKS`` bits in some block, so
    each block has a table from a value to the stored fingerprints that near; entries are filled when a value is first met, and the
    tables begin anew before they grow large.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS) -> None:
        self.prints, self.radius, self.near = prints, radius, radius // BLOCKS
        self.values = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), BLOCKS).T.copy()
        self.tables: list[dict[int, np.ndarray]] = [{} for _ in range(BLOCKS)]
        self.held = 0

    def candidates(self, fingerprint: np.ndarray) -> np.ndarray:
        """Numbers of the stored fingerprints that are near in some block."""
        lists = []
        for table, values, v in zip(self.tables, self.values, fingerprint.view(np.uint16).tolist(), strict=True):
            found = table.get(v)
            if found is None:
                found = np.flatnonzero(np.bitwise_count(values ^ np.uint16(v)) <= self.near)
                table[v] = found if len(found) else _NONE
                self.held += len(found) + _ENTRY
            if len(found):
                lists.append(found)
        if self.held > _TABLE_NUMBERS:
            for table in self.tables:
                table.clear()
            self.held = 0
        return np.unique(np.concatenate(lists)) if lists else _NONE

    def within(self, fingerprint: np.ndarray) -> np.ndarray:
        met = self.candidates(fingerprint)
        return met[np.bitwise_count(self.prints[met] ^ fingerprint).sum(axis=1, dtype=np.int64) <= self.radius]


class Items:
    """Benchmark items by shingle width and length."""

    def __init__(self, rows: list[tuple[int, bytes]], k: int = WORDS, radius: int = RADIUS) -> None:
        texts = [(i, w) for i, raw in rows if (w := words_of(raw))]
        self.ids = [i for i, _ in texts]
        self.lengths = np.array([len(w) for _, w in texts], dtype=np.int64)
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted({x for _, ws in texts for x in ws}))}
        self.hashes = np.array([0] + [_word_hash(w) for w in self.vocabulary], dtype=np.uint64)
        self.counts: list[Counter] = []
        self.widths = np.minimum(self.lengths, k)
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        prints = []
        for n, (_, ws) in enumerate(texts):
            width = int(self.widths[n])
            h = _shingle_hashes(self.hashes[[self.vocabulary[w] for w in ws]], width)
            prints.append(simhash(h))
            self.counts.append(Counter(h.tolist()))
            for x in h.tolist():
                owners[width][x].add(len(ws))
        #: For each shingle width: sorted shingle hashes, and the item lengths in which each occurs.
        self.anchors = {w: (np.array(sorted(o), dtype=np.uint64), [sorted(o[x]) for x in sorted(o)]) for w, o in owners.items()}
        every = np.array(prints, dtype=np.uint64).reshape(len(prints), BITS // 64)
        self.by_length = {}
        for length in np.unique(self.lengths).tolist():
            mine = np.flatnonzero(self.lengths == length)
            self.by_length[length] = (mine, Hamming(every[mine], radius))


def _covered(hits: list[int], width: int, length: int, words: int) -> np.ndarray:
    """Starts of the windows of ``length`` words (or the only one of a shorter text) that hold a shingle at one of ``hits``."""
    last = max(words - length, 0)
    at = np.array(hits)
    edge = np.zeros(last + 2, dtype=np.int64)
    np.add.at(edge, np.clip(at + width - length, 0, last), 1)
    np.add.at(edge, np.minimum(at, last) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class _Stretch:
    """Shingles of a stretch of a text, with running sums of their signs."""

    def __init__(self, shingles: np.ndarray) -> None:
        self.shingles, self.plain = shingles, shingles.tolist()
        self.sums = np.concatenate([np.zeros((1, BITS), dtype=np.int32), np.cumsum(_signs(shingles), axis=0, dtype=np.int32)])
        #: For each place the nearest earlier one with an equal shingle, -1 if there is none.
        order = np.argsort(shingles, kind="stable")
        again = shingles[order[1:]] == shingles[order[:-1]]
        self.before = np.full(len(shingles), -1, dtype=np.int64)
        self.before[order[1:][again]] = order[:-1][again]
        self.repeats = np.flatnonzero(self.before >= 0)

    def prints(self, begin: np.ndarray, size: int) -> np.ndarray:
        sums = self.sums[begin + size] - self.sums[begin]
        if len(self.repeats):
            low, high = np.searchsorted(self.repeats, begin), np.searchsorted(self.repeats, begin + size)
            for i in np.flatnonzero(high > low).tolist():
                again = self.repeats[low[i] : high[i]]
                if (self.before[again] >= begin[i]).any():
                    sums[i] = _signs(_elements(self.shingles[begin[i] : begin[i] + size])).sum(axis=0)
        return _packed(sums)


def matches(items: Items, words: list[bytes], percent: int = PERCENT) -> list[tuple[int, float, int, int]]:
    """(item number, similarity, first word, words) of the best window of each matching item."""
    get = items.vocabulary.get
    known = np.array([get(w, 0) for w in words], dtype=np.int64)
    best: dict[int, tuple[float, int, int]] = {}
    for width, (hashes, lengths) in items.anchors.items():
        if len(words) < width:
            continue
        run = np.concatenate([[0], np.cumsum(known > 0)])
        inside = np.flatnonzero(run[width:] - run[:-width] == width)
        if not len(inside):
            continue
        h = np.zeros(len(inside), dtype=np.uint64)
        for i in range(width):
            h = mix(h * _STEP + items.hashes[known[inside + i]])
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        hits: dict[int, list[int]] = defaultdict(list)
        for p, a in zip(inside[hit].tolist(), at[hit].tolist(), strict=True):
            for length in lengths[a]:
                hits[length].append(p)
        starts = {length: _covered(places, width, length, len(words)) for length, places in hits.items()}
        parts = sorted({int(x) for s in starts.values() for x in np.unique(s // _STRETCH)})
        for part in parts:
            mine = {n: s[(s >= part * _STRETCH) & (s < (part + 1) * _STRETCH)] for n, s in starts.items()}
            mine = {n: s for n, s in mine.items() if len(s)}
            low = min(int(s[0]) for s in mine.values())
            high = max(int(s[-1]) + n for n, s in mine.items())
            near = np.array([items.hashes[known[i]] if known[i] else _word_hash(words[i]) for i in range(low, min(high, len(words)))], dtype=np.uint64)
            stretch = _Stretch(_shingle_hashes(near, width))
            for length, s in mine.items():
                size = min(length, len(words)) - width + 1
                numbers, index = items.by_length[length]
                for b, fingerprint in zip((s - low).tolist(), stretch.prints(s - low, size), strict=True):
                    found = index.within(fingerprint)
                    if not len(found):
                        continue
                    window = Counter(stretch.plain[b : b + size])
                    for n in numbers[found].tolist():
                        item = items.counts[n]
                        both = sum(min(c, item[x]) for x, c in window.items() if x in item)
                        whole = size + item.total() - both
                        if 100 * both >= percent * whole and both / whole > best.get(n, (0.0,))[0]:
                            best[n] = (both / whole, b + low, min(length, len(words)))
    return [(n, *x) for n, x in sorted(best.items())]


def _scan(docs: DataFrame, items: Items, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def kernel(batches):
        index = shared.value
        for rb in batches:
            doc, item, similarity, first, size = [], [], [], [], []
            for i, raw in zip(rb.column("doc_id").to_pylist(), rb.column("raw"), strict=True):
                for n, s, a, b in matches(index, words_of(raw.as_py()), percent):
                    doc.append(i)
                    item.append(index.ids[n])
                    similarity.append(s)
                    first.append(a)
                    size.append(b)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(doc, pa.int64()), "item_id": pa.array(item, pa.int64()), "similarity": pa.array(similarity, pa.float64()), "first_word": pa.array(first, pa.int64()), "n_words": pa.array(size, pa.int64())}
            )

    return map_batches(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), kernel, "doc_id long, item_id long, similarity double, first_word long, n_words long")


def _item_blocks(benchmark: DataFrame, words: int, radius: int, item_rows: int) -> Iterator[Items]:
    items = as_bytes(benchmark, F.col("item_id").cast("long").alias("item_id"))
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / item_rows), math.ceil(size / ITEM_BYTES))
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield Items([(r["item_id"], bytes(r["raw"])) for r in mine.orderBy("item_id").collect()], words, radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS, item_rows: int = ITEM_ROWS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every document for every item it repeats."""
    return reduce(DataFrame.unionByName, [_scan(docs, items, percent) for items in _item_blocks(benchmark, words, radius, item_rows)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS, item_rows: int = ITEM_ROWS) -> DataFrame:
    """The documents that repeat no item, with all columns."""
    for items in _item_blocks(benchmark, words, radius, item_rows):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            return lambda texts: [not matches(shared.value, words_of(t), percent) for t in texts]

        docs = keep_rows(docs, make)
    return docs

"""Language identification by prediction with partial matching over bytes.

Every language has a context tree of order 3 over A-Z-lower-cased bytes, counted once and then frozen. The cost of a byte is
its exact code length: in the longest context that the language's tree holds, a byte seen there costs -log2(count/(n+t)),
any other costs the escape log2((n+t)/t) and is coded in the next shorter context, down to the uniform order -1 (n: bytes
seen in the context, t: distinct ones; no exclusions). A text goes to the language with the shortest code, ties to the
smaller name; the score is the share of that language if each code length is read as a log-probability.

The trees of all languages share one set of numbered nodes, so scoring is a walk by table lookups over whole batches.

Bounds: trees learn from at most ``rows_per_language`` training documents of each language (whole texts, chosen by id hash) and
hold every entry of these, so their size follows the sample (some 15,000 entries a language here) and the number of
languages, each of which also has 65,536 values of the shorter contexts. All rows are scored over their whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learned.
A null doc_id counts as a training row. Rows with a null lang teach nothing. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import as_bytes, hash_sample, held_out, map_batches

ROWS_PER_LANGUAGE = 400
_PAD = b"\n\n\n"
_CHUNK = 1 << 20


def _counted(sample: DataFrame) -> list[tuple[str, int, int]]:
    """lang, code (three bytes of context and one byte, big-endian) and count: every entry, so that all orders add up."""

    def kernel(batches):
        for rb in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, raw in zip(rb.column("lang").to_pylist(), rb.column("raw").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(raw.lower())
            for lang, texts in by_lang.items():
                codes = []
                for t in texts:
                    a = np.frombuffer(_PAD + t, dtype=np.uint8).astype(np.int64)
                    codes.append((a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:])
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(code), pa.string()), "code": pa.array(code), "n": pa.array(n)})

    counts = map_batches(sample, kernel, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    return sorted(zip(*(found[c].to_pylist() for c in ("lang", "code", "n")), strict=True))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x, 1e-300))


class Trees:
    """Shared nodes and, per language, resolved code lengths. Nodes are numbered from 1; 0 means absent."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        k = len(self.langs)
        code = np.array([r[1] for r in rows], dtype=np.int64)
        which = np.searchsorted(np.array(self.langs), np.array([r[0] for r in rows])) if rows else np.empty(0, dtype=np.int64)
        count = np.array([r[2] for r in rows], dtype=np.float64)

        def table(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
            out = np.zeros((len(keys), k))
            np.add.at(out, (np.searchsorted(keys, of), which), count)
            return out

        full = np.unique(code)
        three = np.unique(np.concatenate([full >> 8, full & 0xFFFFFF]))
        two = np.unique(np.concatenate([three >> 8, three & 0xFFFF]))
        c4, c3, c2, c1 = table(full, code), table(three, code & 0xFFFFFF), table(np.arange(65536), code & 0xFFFF), table(np.arange(256), code & 0xFF)

        def context(n: np.ndarray, parent: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            """n + t of each context, and its escape, from the counts of its entries."""
            whole, kinds = np.zeros((size, k)), np.zeros((size, k))
            np.add.at(whole, parent, n)
            np.add.at(kinds, parent, n > 0)
            return whole + kinds, np.where(kinds > 0, _bits(whole + kinds) - _bits(kinds), 0.0)

        def cost(n: np.ndarray, parent: np.ndarray, ctx: tuple[np.ndarray, np.ndarray], shorter: np.ndarray) -> np.ndarray:
            return np.where(n > 0, _bits(ctx[0][parent]) - _bits(n), ctx[1][parent] + shorter)

        root = np.zeros(256, dtype=np.int64)
        k1 = cost(c1, root, context(c1, root, 1), np.full((256, k), 8.0))
        p2 = np.arange(65536) >> 8
        k2 = cost(c2, p2, context(c2, p2, 256), k1[np.arange(65536) & 0xFF])
        p3 = np.searchsorted(two, three >> 8)
        x3 = context(c3, p3, len(two))
        k3 = cost(c3, p3, x3, k2[three & 0xFFFF])
        p4 = np.searchsorted(three, full >> 8)
        x4 = context(c4, p4, len(three))
        k4 = cost(c4, p4, x4, k3[np.searchsorted(three, full & 0xFFFFFF)])
        absent = np.zeros((1, k))
        self.cost2 = k2.astype(np.float32)
        self.cost3, self.cost4 = (np.concatenate([absent, x]).astype(np.float32) for x in (k3, k4))
        self.escape2, self.escape3 = (np.concatenate([absent, x]).astype(np.float32) for x in (x3[1], x4[1]))
        self.node2 = np.zeros(65536, dtype=np.int32)
        self.node2[two] = np.arange(1, len(two) + 1)
        self.node3 = np.zeros((len(two) + 1) * 256, dtype=np.int32)
        self.node3[(p3 + 1) * 256 + (three & 0xFF)] = np.arange(1, len(three) + 1)
        self.node4 = np.zeros((len(three) + 1) * 256, dtype=np.int32)
        self.node4[(p4 + 1) * 256 + (full & 0xFF)] = np.arange(1, len(full) + 1)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
                size += len(texts[end])
                end += 1
            out[at:end] = self._chunk(texts[at:end])
            at = end
        return out

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        a = np.frombuffer(b"".join(_PAD + t.lower() for t in texts), dtype=np.uint8).astype(np.int32)
        begin = np.cumsum([0] + [len(t) + 3 for t in texts])[:-1]
        pair = (a[:-1] << 8) | a[1:]
        two = self.node2[pair]  # two[i]: the node of bytes i, i+1
        three = np.where(two[:-1] > 0, self.node3[two[:-1] * 256 + a[2:]], 0)
        four = np.where(three[:-1] > 0, self.node4[three[:-1] * 256 + a[3:]], 0)
        cost = self.cost4[four]  # cost[i]: of byte i+3
        miss = np.flatnonzero(four == 0)
        if len(miss):
            known = three[miss + 1]
            short = self.cost3[known]
            none = np.flatnonzero(known == 0)
            at = miss[none]
            short[none] = self.escape2[two[at + 1]] + self.cost2[pair[at + 2]]
            cost[miss] = self.escape3[three[miss]] + short
        sums = np.zeros((len(texts), cost.shape[1]))
        full = np.flatnonzero([len(t) > 0 for t in texts])
        if len(full):
            # The three positions before the next text belong to its padding; an own cut ends each text.
            cuts = np.empty(2 * len(full), dtype=np.int64)
            cuts[0::2] = begin[full]
            cuts[1::2] = begin[full] + [len(texts[i]) for i in full]
            padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), dtype=np.float32)])
            sums[full] = np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[0::2]
        return sums


def learn(docs: DataFrame, modulus: int | None = None, kept_back: int | None = None, rows_per_language: int = ROWS_PER_LANGUAGE) -> Trees:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if modulus is not None:
        known = known.where(~held_out("doc_id", modulus, kept_back))
    langs = [r["lang"] for r in known.select("lang").distinct().collect()]
    ids = hash_sample(known.select("doc_id", "lang"), {x: rows_per_language for x in langs}, "lang")[0].select(F.col("doc_id").alias("id"), F.col("lang").alias("l"))
    sample = known.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l")), "left_semi")
    return Trees(_counted(as_bytes(sample, "lang")))


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score, bits (the shortest code's length) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def kernel(batches):
        model = shared.value
        for rb in batches:
            raws = [x or b"" for x in rb.column("raw").to_pylist()]
            lettered = [any(c.isalpha() for c in t.decode("utf-8", "replace")) for t in raws]
            names, score, bits = ["und"] * len(raws), np.zeros(len(raws)), np.zeros(len(raws))
            if model.langs and raws:
                length = model.lengths(raws)
                best = length.argmin(axis=1)
                bits = length[np.arange(len(raws)), best]
                share = 1 / np.exp2(-np.minimum(length - bits[:, None], 1000)).sum(axis=1)
                for i, ok in enumerate(lettered):
                    if ok:
                        names[i], score[i] = model.langs[best[i]], share[i]
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "bits": pa.array(bits)})

    return map_batches(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), kernel, "doc_id long, lang_pred string, score double, bits double")

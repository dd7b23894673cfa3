"""Toxicity by a bag of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of character n-grams of its A-Z-lower-cased words, word ends marked by a blank, hashed into buckets that
each have an embedding. The mean embedding goes through a linear softmax over two classes; embeddings and softmax are trained
together by adaptive minibatch gradient steps. Misspelt words that never occurred share most n-grams, and so most of the
evidence, with the words they came from. For scoring, each bucket's embedding is folded into its share of the log odds.

Bound: at most ``TRAIN_ROWS`` labelled documents of class 0 and 1 (whole texts, chosen by id hash) teach the model; all rows are scored over
their whole texts. Defined results: an empty or null text scores by the softmax's bias alone; repeated rows score alike; with no
labelled rows every score is 0.5.
"""

from __future__ import annotations

import struct

import numpy as np

from lociweave.llm.labelled import class_weights

TRAIN_ROWS = (4_500, 2_500)
ORDERS = (3, 4, 5, 6)
BITS = 18
DIMENSION = 8
EPOCHS = 14
#: Small samples get more epochs, up to this many steps in all.
LEAST_STEPS = 400
BATCH = 64
RATE = 0.15
LEAST_DOCUMENTS = 2


def buckets(raw: bytes) -> np.ndarray:
    """Bucket of each n-gram that lies within one word and its end marks."""
    a = np.frombuffer(b" " + b" ".join(raw.lower().split()) + b" ", dtype=np.uint8)
    if len(a) < 3:
        return np.empty(0, dtype=np.int32)
    blank = a == 32
    wide = a.astype(np.uint64)
    code, broken, parts = wide[:-1] | (wide[1:] << np.uint64(8)), np.zeros(len(a) - 1, dtype=bool), []
    for n in range(3, max(ORDERS) + 1):
        if len(a) < n:
            break
        m = len(a) - n + 1
        code = code[:m] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
        broken = broken[:m] | blank[n - 2 : n - 2 + m]  # a blank inside, not at an end
        good = code[~broken]
        parts.append(((good * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (good >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))
    return np.concatenate(parts).astype(np.int32)


def fit(texts: list[bytes], y: np.ndarray, share: float) -> bytes:
    size = 1 << BITS
    if not len(texts):
        return struct.pack("<d", 0.0) + np.zeros(size, "<f4").tobytes()
    rows, totals, seen = [], [], np.zeros(size, dtype=np.int32)
    for t in texts:
        b, n = np.unique(buckets(t), return_counts=True)
        seen[b] += 1
        rows.append((b, n.astype(np.uint32)))
        totals.append(max(int(n.sum()), 1))
    used = seen >= LEAST_DOCUMENTS
    ids = (np.cumsum(used) - 1).astype(np.int32)
    for i, (b, n) in enumerate(rows):  # in place, so that one copy of the sample is held
        keep = used[b]
        rows[i] = (ids[b[keep]], n[keep])
    kinds = int(used.sum())
    rng = np.random.default_rng(11)
    table = rng.normal(0, 0.1, (kinds, DIMENSION)).astype(np.float32)
    head = rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], dtype=np.float32)
    weight = class_weights(y, share).astype(np.float32)
    past_table, past_head, past_bias = np.full(kinds, 1e-10, np.float32), np.full_like(head, 1e-6), np.full_like(bias, 1e-6)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows)))
    for epoch in range(epochs):
        step = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = [i for i in order[at : at + BATCH] if len(rows[i][0])]
            if not some:
                continue
            index = np.concatenate([rows[i][0] for i in some])
            portion = np.concatenate([rows[i][1] / np.float32(totals[i]) for i in some])
            lens = np.array([len(rows[i][0]) for i in some])
            start = np.concatenate([[0], np.cumsum(lens)[:-1]])
            mean = np.add.reduceat(table[index] * portion[:, None], start, axis=0)
            logits = mean @ head + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= (weight[some] / len(some))[:, None]
            back = np.repeat(p @ head.T, lens, axis=0) * portion[:, None]
            hit = np.flatnonzero(np.bincount(index, minlength=kinds))
            grad = np.stack([np.bincount(index, weights=back[:, d], minlength=kinds)[hit] for d in range(DIMENSION)], axis=1).astype(np.float32)
            past_table[hit] += (grad * grad).mean(axis=1)
            table[hit] -= step * grad / np.sqrt(past_table[hit])[:, None]
            g = mean.T @ p
            past_head += g * g
            head -= step * g / np.sqrt(past_head)
            g = p.sum(axis=0)
            past_bias += g * g
            bias -= step * g / np.sqrt(past_bias)
    odds = np.zeros(size, dtype="<f4")
    odds[used] = table @ (head[:, 1] - head[:, 0])
    return struct.pack("<d", float(bias[1] - bias[0])) + odds.tobytes()


def load(blob: bytes):
    (bias,) = struct.unpack_from("<d", blob)
    odds = np.frombuffer(blob, "<f4", 1 << BITS, 8)

    def judge(texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), bias)
        for i, t in enumerate(texts):
            b = buckets(t)
            if len(b):
                z[i] += odds[b].sum(dtype=np.float64) / len(b)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return judge

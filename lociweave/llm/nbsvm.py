"""Quality classifier: byte n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Each text is the set of its hashed byte n-grams. An indicator's value is the log ratio of its smoothed document counts in
the two classes; vectors have unit length. The hinge loss with L2 penalty is minimised by dual coordinate descent, and a
logistic curve fitted on a part of the sample that the descent did not see turns margins into scores.

Bound: at most ``TRAIN_ROWS`` labelled documents of class 0 and 1 (whole texts, chosen by id hash) teach the model; all rows are scored over
their whole texts. Defined results: an empty or null text scores by the curve at margin 0, repeated rows score alike; with
no labelled rows every score is 0.5.
"""

from __future__ import annotations

import struct

import numpy as np

from lociweave.llm.labelled import calibrate, class_weights

TRAIN_ROWS = (3_000, 4_000)
ORDERS = (2, 3, 4)
BITS = 18
COST = 1.0
EPOCHS = 12


class Grams:
    """Distinct hashed n-grams of a text; keeps one stamp table so that no sort is needed."""

    def __init__(self) -> None:
        self.stamp = np.zeros(1 << BITS, dtype=np.int32)

    def __call__(self, raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
        parts = []
        for n in ORDERS:
            if len(a) < n:
                continue
            code = a[: len(a) - n + 1].copy()
            for i in range(1, n):
                code |= a[i : len(a) - n + 1 + i] << np.uint64(8 * i)
            code = ((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            parts.append(code.astype(np.int32))
        if not parts:
            return np.empty(0, dtype=np.int32)
        every = np.concatenate(parts)
        place = np.arange(len(every), dtype=np.int32)
        self.stamp[every] = place
        return every[self.stamp[every] == place]


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Dual coordinate descent for the hinge loss over unit vectors; returns the weights, the last being the bias's."""
    w = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost[i])  # unit vector and unit bias: the diagonal is 2
            change = (new - alpha[i]) * sign[i]
            if change:
                w[rows[i]] += change * values[i]
                w[-1] += change
                most = max(most, abs(change))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def fit(texts: list[bytes], y: np.ndarray, share: float) -> bytes:
    grams = Grams()
    rows = [grams(t) for t in texts]
    counts = np.ones((2, 1 << BITS))
    for r, label in zip(rows, y, strict=True):
        counts[label, r] += 1
    counts /= np.array([[(y == 0).sum() + 2.0], [(y == 1).sum() + 2.0]])
    ratio = np.log(counts[1] / counts[0]).astype(np.float32)
    if not len(rows):
        return struct.pack("<dd", 0.0, 0.0) + np.zeros((1 << BITS) + 1, "<f4").tobytes() + ratio.astype("<f4").tobytes()
    values = [ratio[r] / max(float(np.sqrt((ratio[r].astype(np.float64) ** 2).sum())), 1e-12) for r in rows]
    test = np.arange(len(rows)) % 4 == 3
    cost = COST * class_weights(y, 0.5)
    teach = np.flatnonzero(~test)
    w = descend([rows[i] for i in teach], [values[i] for i in teach], np.where(y[teach] == 1, 1, -1), cost[teach])
    judged = np.flatnonzero(test) if test.any() else teach
    slope, offset = calibrate(np.array([w[rows[i]] @ values[i] + w[-1] for i in judged]), y[judged], share)
    return struct.pack("<dd", slope, offset) + w.astype("<f4").tobytes() + ratio.astype("<f4").tobytes()


def load(blob: bytes):
    slope, offset = struct.unpack_from("<dd", blob)
    w = np.frombuffer(blob, "<f4", (1 << BITS) + 1, 16).astype(np.float64)
    ratio = np.frombuffer(blob, "<f4", 1 << BITS, 16 + 4 * ((1 << BITS) + 1)).astype(np.float64)
    weighted, squared, bias = w[:-1] * ratio, ratio * ratio, w[-1]
    grams = Grams()

    def judge(texts: list[bytes]) -> np.ndarray:
        margin = np.zeros(len(texts))
        for i, t in enumerate(texts):
            r = grams(t)
            margin[i] = weighted[r].sum() / max(float(np.sqrt(squared[r].sum())), 1e-12) + bias if len(r) else 0.0
        return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))

    return judge

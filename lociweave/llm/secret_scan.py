"""Secret scan: fixed patterns plus a sliding-window entropy detector, in DataFrame functions only.

Positions come from splitting a text at its matches: the lengths of pieces and matches before a match add up to its start
in code points, by running sums of doubling stride. The entropy detector looks at every run of token characters of at least
``window`` characters. It moves a window along the run one character at a time, keeping a count for each character and the sum
of ``c*log2(c)`` in millionths of a bit, so one step changes two counts and two terms of an integer sum. The run is reported if its
best window reaches the limit of its character class (hex digits or mixed), unless the allow list names it. Cost is linear in the
length of a run and n log n in the number of matches.

Defined results: a null or empty text has no spans; repeated rows give repeated results; only ``doc_id`` and ``text`` are
read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")

#: Fixed values of the entropy detector.
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
HEX_RUN = r"^[0-9A-Fa-f]+$"
LIMIT_BITS = {"entropy_hex": 2.8, "entropy_mixed": 3.7}
#: Runs that are never secrets: one kind of character only, or a placeholder.
ALLOW = (r"^[A-Za-z/_=+-]+$", r"^[0-9/_=+-]+$", r"(?i:example|placeholder|changeme|dummy|redacted|xxxxx)")

#: c*log2(c) in millionths of a bit, for counts 0 to WINDOW.
TERMS = [0] + [round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 1)]


def most_weight(bits: float) -> int:
    """The largest sum of terms that a window of this entropy or more can have."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6)


_SPANS = "array<struct<start:int,kind:int,stop:int>>"
#: Counts of ``ALPHABET`` are packed, so many to a long, five bits each.
_PER_LONG = 12
_LONGS = -(-len(ALPHABET) // _PER_LONG)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often and in whatever loop ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running_sums(steps: Column) -> Column:
    """Prefix sums of an array of ints by doubling strides, so the cost is n log n and no array is grown item by item."""

    def double(sums: Column, level: Column) -> Column:
        stride = F.pow(F.lit(2), level).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.when(i >= stride, F.get(sums, i - stride)), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps).cast("double"))).cast("int")), steps, double)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, keep=None) -> Column:
    """Spans of the matches of ``pattern``; ``keep`` maps a match's ``group`` to a condition. Nothing is split unless something matches."""

    def every(found: Column) -> Column:
        # The step to a match is the match before it and the piece between them.
        ends = lambda pieces: F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.coalesce(F.when(i > 0, F.length(F.get(found, i - 1))), F.lit(0)))
        starts = _let(_let(F.split(text, pattern, -1), ends), _running_sums)
        named = lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), F.lit(kind).alias("kind"), (F.get(at, i) + F.length(m)).alias("stop")))
        return _let(starts, named).cast(_SPANS)

    matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    out = _let(matches(0), every)
    if keep is not None:
        out = _let(matches(group), lambda values: F.filter(out, lambda s, i: keep(F.get(values, i))))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(_SPANS))


def lowest_weight(run: Column) -> Column:
    """Smallest sum of terms over all windows of ``run``, by incremental counts: linear in its length.

    ``n`` packs the count of each character of the alphabet; one step reads and changes the counts of the character that comes and
    of the one that goes.
    """
    terms = F.array(*(F.lit(t).cast("long") for t in TERMS))
    zero = F.lit(0).cast("long")
    begin = F.struct(F.array_repeat(zero, _LONGS).alias("n"), zero.alias("sum"), F.lit(1 << 60).cast("long").alias("best"))
    place = lambda c: F.struct(c.alias("code"), F.floor(c / _PER_LONG).cast("int").alias("at"), (c % _PER_LONG * 5).cast("int").alias("by"), F.call_function("shiftleft", F.lit(1).cast("long"), (c % _PER_LONG * 5).cast("int")).alias("one"))
    count = lambda n, c: F.call_function("shiftrightunsigned", F.get(n, c["at"]), c["by"]).bitwiseAND(F.lit(31)).cast("int")

    def best(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            comes, goes = F.get(codes, i), F.get(codes, i - WINDOW)
            full = i >= WINDOW
            up, down = count(acc["n"], comes), count(acc["n"], goes)
            rise = F.get(terms, up + 1) - F.get(terms, up)
            fall = F.when(full, F.get(terms, down) - F.get(terms, down - 1)).otherwise(zero)
            same = full & (comes["code"] == goes["code"])
            total = F.when(same, acc["sum"]).otherwise(acc["sum"] + rise - fall)
            counts = F.transform(acc["n"], lambda x, j: x + F.when(j == comes["at"], comes["one"]).otherwise(zero) - F.when(full & (j == goes["at"]), goes["one"]).otherwise(zero))
            return F.struct(counts.alias("n"), total.alias("sum"), F.when(i >= WINDOW - 1, F.least(acc["best"], total)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda acc: acc["best"])

    return _let(F.transform(F.split(run, ""), lambda c: place(F.instr(F.lit(ALPHABET), c) - 1)), best)


def _entropy_spans(text: Column, allow: tuple[str, ...]) -> Column:
    """Reported runs as spans, of the class of each."""

    def verdict(run: Column) -> Column:
        barred = F.lit(False)
        for p in allow:
            barred = barred | run.rlike(p)
        hexed = run.rlike(HEX_RUN)
        most = F.when(hexed, F.lit(most_weight(LIMIT_BITS["entropy_hex"]))).otherwise(F.lit(most_weight(LIMIT_BITS["entropy_mixed"])))
        return F.when(barred, F.lit(-1)).when(lowest_weight(run) > most, F.lit(-1)).when(hexed, F.lit(3)).otherwise(F.lit(4))

    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), verdict)
    zipped = F.arrays_zip(_spans(text, RUN, 0).alias("s"), runs.alias("v"))
    kept = F.filter(zipped, lambda z: z["v"] >= 0)
    named = F.transform(kept, lambda z: F.struct(z["s"]["start"].alias("start"), z["v"].alias("kind"), z["s"]["stop"].alias("stop")))
    return F.when(text.rlike(RUN), named).otherwise(F.array().cast(_SPANS))


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, text, base and spans: arrays of (start, kind, stop), ordered by start, kind and stop; kinds index ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = _spans(text, ASSIGN, 0, 2, lambda value: F.length(value) >= 8)
    base = F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    found = docs.select("doc_id", "text", base.alias("base"), _entropy_spans(text, allow).alias("more"))
    return found.select("doc_id", "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def joined(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "*", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id and text with every found span overwritten by as many mask characters."""
    blank = F.aggregate("spans", F.col("text"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit(mask), s["stop"] - s["start"]), F.substring(t, s["stop"] + 1, F.length(t))))
    return find_secrets(docs, allow).select("doc_id", blank.alias("text"))


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

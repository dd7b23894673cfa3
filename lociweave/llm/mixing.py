"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A multinomial classifier over hashed word endings is counted from three quarters of a labelled table of (doc_id, domain); how
much the evidence of n words weighs is fitted on the last quarter, so that posteriors are as sure as they are right. Rates r >= ``min_rate`` are then the ones nearest
to the start (least squares, by token) whose expected totals S_d = sum_i r_i * tokens_i * p_id meet the targets T_d. They have the
form clip(start - sum_d p_id * y_d), so only one y per domain is fitted: projected-gradient steps on the dual, scaled by its
curvature and damped; each trial is one aggregation of the totals and their derivatives. Where ``min_rate`` forbids to take from a
domain, T_d are the target shares of whatever total comes out. A ridge of ``RIDGE`` on y makes the optimum unique where no rates
meet the targets; ``mix_report`` tells what is left open.

Bounds: the classifier learns from at most ``labelled_rows`` labelled documents (whole texts, chosen by id hash); its
table has at most ``buckets`` rows. Everything else covers all rows.

Defined results: rows that share a doc_id are one document with all their words and share its rate; a null or empty text
has no tokens, the prior as posterior and rate ``min_rate`` or 1, whichever is larger; without labelled rows or tokens every rate is
that too. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import free_names, hash_sample, pick_rows
from lociweave.plans.runtime import BROADCAST_ROWS, materialize

LABELLED_ROWS = 20_000
BUCKETS = 4096
#: Weights of a document's evidence among which the calibration chooses: (scale, damp) stands for scale * words**-damp.
GRID = [(0.25 * 2.0**i * 4.0 ** (4 * d), d) for d in (0.0, 0.25, 0.5, 0.75, 1.0) for i in range(-4, 7)]
TOLERANCE = 5e-4
#: A residual of ``RIDGE`` times y stays; below ``STATIONARY`` of the targets, the slope counts as zero.
RIDGE = 1e-6
STATIONARY = 1e-5
#: A guard against endless rounding; a fit that reaches it is reported.
NEWTON_STEPS = 100


def _endings(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id and the bucket of the last two characters of each word; a document without words has one row with null."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]", " ")), " +")
    one = docs.select("doc_id", F.explode(words).alias("w"))
    return one.select("doc_id", F.when(F.col("w") != "", F.pmod(F.xxhash64(F.substring("w", -2, 2)), F.lit(buckets)).cast("int")).alias("bucket"))


def _known_endings(docs: DataFrame, labelled: DataFrame, domains: list[str], labelled_rows: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The chosen labelled documents (doc_id, domain, part) and their bucket counts; part 3 of 4 calibrates, the others teach."""
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain", F.lit(0).alias("all"))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(4)).cast("int").alias("part")
    chosen = materialize(hash_sample(known, {0: labelled_rows}, "all")[0].select("doc_id", "domain", part), "labelled")
    words = _endings(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id"), buckets)
    return chosen, materialize(words.where("bucket is not null").groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n")), "endings")


def _classifier(chosen: DataFrame, endings: DataFrame, domains: list[str], buckets: int) -> tuple[DataFrame, list[float], list[float]]:
    """bucket and a log-likelihood per domain for the buckets seen; the log priors; and the unseen bucket's values."""
    seen = endings.join(F.broadcast(chosen.where("part < 3")), "doc_id")
    counts = seen.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)))
    counts = materialize(counts, "buckets")
    totals = counts.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(domains)))).first()
    rows = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(rows.values())
    priors = [math.log((rows.get(d, 0) + 1) / (every + len(domains))) for d in domains]
    floor = [math.log(1 / (totals[f"n{i}"] + buckets)) for i in range(len(domains))]
    weights = counts.select("bucket", *((F.log(F.col(f"n{i}") + 1.0) - F.lit(math.log(totals[f"n{i}"] + buckets))).alias(f"l{i}") for i in range(len(domains))))
    return weights, priors, floor


def _scores(priors: list[float], scale: Column, damp: Column) -> list[Column]:
    """Log posterior of each domain, up to a constant, of a row with tokens and s0..: evidence of n words counts ``scale * n**-damp`` times."""
    share = scale * F.pow(F.greatest(F.col("tokens"), F.lit(1)).cast("double"), -damp)
    return [F.lit(p) + F.coalesce(f"s{i}", F.lit(0.0)) * share for i, p in enumerate(priors)]


def _calibrated(chosen: DataFrame, endings: DataFrame, weights: DataFrame, domains: list[str], priors: list[float], floor: list[float]) -> tuple[float, float]:
    """The (scale, damp) of ``GRID`` under which the labels of the calibrating part are likeliest.

    Words of one document are far from independent, so plain sums claim too much; how much is read off labels that taught nothing.
    """
    k = len(domains)
    own = endings.join(F.broadcast(chosen.where("part = 3")), "doc_id").join(F.broadcast(weights), "bucket", "left")
    own = own.groupBy("doc_id", "domain").agg(F.sum("n").alias("tokens"), *(F.sum(F.col("n") * F.coalesce(f"l{i}", F.lit(floor[i]))).alias(f"s{i}") for i in range(k)))
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("scale"), F.lit(b).alias("damp")) for a, b in GRID)))
    tried = own.withColumn("g", grid).select("*", "g.scale", "g.damp")
    score = _scores(priors, F.col("scale"), F.col("damp"))
    tried = tried.select("scale", "damp", "domain", *(x.alias(f"v{i}") for i, x in enumerate(score)))
    top = F.greatest(*(F.col(f"v{i}") for i in range(k))) if k > 1 else F.col("v0")
    right = F.coalesce(*(F.when(F.col("domain") == d, F.col(f"v{i}")) for i, d in enumerate(domains)))
    loss = F.log(sum((F.exp(F.col(f"v{i}") - top) for i in range(1, k)), F.exp(F.col("v0") - top))) + top - right
    found = tried.groupBy("scale", "damp").agg(F.round(F.avg(loss), 9).alias("loss")).orderBy("loss", F.desc("damp"), "scale").limit(1).collect()
    return (found[0]["scale"], found[0]["damp"]) if found else (1.0, 1.0)


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], labelled_rows: int = LABELLED_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, tokens, p0..p{D-1}: one row per distinct doc_id."""
    chosen, endings = _known_endings(docs, labelled, domains, labelled_rows, buckets)
    weights, priors, floor = _classifier(chosen, endings, domains, buckets)
    scale, damp = _calibrated(chosen, endings, weights, domains, priors, floor)
    k = len(domains)
    words = _endings(docs, buckets).join(F.broadcast(weights), "bucket", "left")
    used = F.col("bucket").isNotNull()
    sums = words.groupBy("doc_id").agg(F.sum(F.when(used, 1).otherwise(0)).cast("long").alias("tokens"), *(F.sum(F.when(used, F.coalesce(f"l{i}", F.lit(floor[i])))).alias(f"s{i}") for i in range(k)))
    score = _scores(priors, F.lit(scale), F.lit(damp))
    top = F.greatest(*score) if k > 1 else score[0]
    raised = sums.select("doc_id", "tokens", *(F.exp(score[i] - top).alias(f"e{i}") for i in range(k)))
    whole = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return raised.select("doc_id", "tokens", *((F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(k)))


def fit_rates(members: DataFrame, targets: list[float], budget: float | None = None, min_rate: float = 0.0, max_rate: float = 16.0) -> DataFrame:
    """Adds ``rate`` to doc_id, tokens, p0..: expected domain totals are ``targets`` times ``budget`` within ``TOLERANCE``.

    The default budget is all tokens; with a positive ``min_rate``, which forbids to take from a domain, whatever total the nearest
    rates with these shares have. Where no rates within the bounds meet the targets, those of the smallest residual stand and a
    warning tells it.
    """
    k = len(targets)
    start = max(1.0, min_rate)
    table = materialize(members, "rates")
    shares_only = budget is None and min_rate > 0
    # Totals of p are to meet goals; shares alone are met if totals of p - target vanish.
    drift = [F.col(f"p{i}") - F.lit(float(t) if shares_only else 0.0) for i, t in enumerate(targets)]

    def shape(y) -> tuple[Column, Column]:
        free: Column = sum((drift[i] * F.lit(-float(y[i])) for i in range(k)), F.lit(start))
        return free, F.when(F.col("tokens") > 0, F.least(F.greatest(free, F.lit(float(min_rate))), F.lit(float(max_rate)))).otherwise(F.lit(start))

    def at(y) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Totals of the drifts, their derivatives by -y, the dual's part that sums over documents, and all tokens."""
        free, rate = shape(y)
        whole = table.select("tokens", *(d.alias(f"q{i}") for i, d in enumerate(drift)), free.alias("f"), rate.alias("r"))
        inner = F.when((F.col("f") > min_rate) & (F.col("f") < max_rate), F.col("tokens")).otherwise(0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        taken = F.col("r") * F.col("tokens")
        sums = [taken * F.col(f"q{i}") for i in range(k)] + [inner * F.col(f"q{i}") * F.col(f"q{j}") for i, j in pairs] + [F.col("tokens") * (F.col("r") * F.col("f") - F.col("r") * F.col("r") / 2), taken]
        got = [float(x) for x in whole.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"x{n}") for n, c in enumerate(sums))).first()]
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:-2], strict=True):
            curve[i, j] = curve[j, i] = x
        return np.array(got[:k]), curve, got[-2], got[-1]

    now, curve, part, total = at(np.zeros(k))
    if not total:
        return table.withColumn("rate", F.lit(start))
    goal = np.zeros(k) if shares_only else np.array(targets) * (total / start if budget is None else budget)
    wanted = np.maximum(np.array(targets), 1e-3)
    scale = wanted * (total if shares_only else goal.sum())
    dual = lambda y, part: part + y @ goal + RIDGE / 2 * (scale * y * y).sum()
    y, done = np.zeros(k), False
    for _ in range(NEWTON_STEPS):
        off = np.abs((now - goal) / (wanted * total if shares_only else scale)).max()
        slope = goal - now + RIDGE * scale * y
        done = off < TOLERANCE or np.abs(slope / scale).max() < STATIONARY
        if done:
            break
        move, step = -np.linalg.solve(curve + RIDGE * np.diag(scale), slope), 1.0
        here = dual(y, part)
        while step > 1e-9:
            trial = at(y + step * move)
            if dual(y + step * move, trial[2]) <= here + 1e-4 * step * (slope @ move) + 1e-12 * abs(here):
                break
            step /= 4
        else:
            break
        y, (now, curve, part, total) = y + step * move, trial
    if off >= TOLERANCE:
        warnings.warn(f"mixing: totals stay {off:.4g} off their targets at {'the optimum' if done else 'an unfinished fit'}", stacklevel=2)
    return table.withColumn("rate", shape(y)[1])


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], min_rate: float = 0.0, max_rate: float = 16.0) -> DataFrame:
    """doc_id, tokens, p0.. (posteriors in the order of ``targets``), rate and copies (the rate rounded up or down by the id's hash)."""
    domains = list(targets)
    share = sum(targets.values())
    members = materialize(domain_posteriors(docs, labelled, domains), "members")
    rated = fit_rates(members, [targets[d] / share for d in domains], min_rate=min_rate, max_rate=max_rate)
    dice = F.coalesce(F.pmod(F.crc32(F.concat(F.lit("mix"), F.col("doc_id").cast("string"))), F.lit(1_000_000)) / 1e6, F.lit(0.0))
    return rated.withColumn("copies", F.floor(F.col("rate") + dice).cast("int"))


def mix_report(mixed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """domain, target and share (of the expected tokens that ``mixed`` gives it) and residual (share / target - 1), a row per domain of ``targets``."""
    whole = sum(targets.values())
    sums = mixed.agg(*(F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"t{i}") for i in range(len(targets))))
    every = sum((F.col(f"t{i}") for i in range(1, len(targets))), F.col("t0"))
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(t / whole).alias("target"), F.try_divide(F.col(f"t{i}"), every).alias("share")) for i, (d, t) in enumerate(targets.items()))))
    return sums.select(rows.alias("r")).select("r.*", (F.try_divide(F.col("r.share"), F.col("r.target")) - 1).alias("residual"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents repeated ``copies`` times; only ids with other than one copy travel, by broadcast while they are few."""
    times, serial = free_names(docs, "times", "serial")
    odd = materialize(mixed.where("copies <> 1 and doc_id is not null").select("doc_id", F.col("copies").alias(times)), "odd")
    n = odd.count()
    if not n:
        return docs
    gone = odd.where(F.col(times) == 0).select("doc_id")
    lost = gone.count()
    kept = pick_rows(docs, gone, "left_anti", lost) if lost else docs
    side = odd.where(F.col(times) > 1)
    side = F.broadcast(side) if n <= BROADCAST_ROWS else side
    repeated = kept.join(side, "doc_id", "left").withColumn(serial, F.explode(F.sequence(F.lit(1), F.coalesce(times, F.lit(1)))))
    return repeated.select(*docs.columns)

"""Aggregating database fields over the matches of each record.

All functions but ``all`` and ``unique``, whose result is the list itself, are partial aggregates: a record with very many
matches is reduced before the shuffle and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.aggspec import COUNT, SIMILARITY, Aggregate
from lociweave.functions.similarity import six_decimals
from lociweave.operators.match import match
from lociweave.options import MatchOptions


def field_values(info: str | Column, name: str, kind: str) -> Column:
    """The values of an INFO field as strings; null where it is absent. Floats are rounded to six decimals of their 32-bit value."""
    source = F.col(info) if isinstance(info, str) else info
    parts = F.split(source[name], ",")
    if kind == "Float":
        return F.transform(parts, lambda x: six_decimals(x.try_cast("float").cast("double")))
    return parts


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def aggregate_column(spec: Aggregate, values: Column, sim: Column, kind: str) -> Column:
    """One output over grouped matches with columns pos_b and src_b; ``values`` is null or an array of strings."""
    if spec.source == COUNT:
        return F.count(F.lit(1)).cast("int")
    if spec.source == SIMILARITY:
        values, kind = F.array(six_decimals(sim)), "Float"
    typed = {"Integer": lambda c: F.coalesce(c.try_cast("int"), c.try_cast("double").cast("int")), "Float": lambda c: c.try_cast("double")}.get(kind, lambda c: c)
    shown = lambda number: F.round(number, 6) if kind != "Integer" else number.cast("int")
    some = F.size(values) > 0
    order = F.struct("pos_b", "src_b")
    if spec.func in ("max", "min"):
        each = F.when(some, (F.array_max if spec.func == "max" else F.array_min)(F.transform(values, _number)))
        return shown((F.max if spec.func == "max" else F.min)(each))
    if spec.func == "mean":
        total = F.sum(F.when(some, F.aggregate(F.transform(values, _number), F.lit(0.0), lambda a, x: a + x)))
        return F.round(total / F.sum(F.when(some, F.size(values))), 6)
    if spec.func == "first":
        return typed(F.min_by(F.get(values, F.lit(0)), F.when(some, order)))
    if spec.func == "last":
        return typed(F.max_by(F.element_at(values, -1), F.when(some, order)))
    if spec.func == "best":
        return typed(F.max_by(F.when(some, F.get(values, F.lit(0))), F.struct(sim, -F.col("pos_b"), -F.col("src_b"))))
    pooled = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("pos_b", "src_b", values.alias("v"))))), lambda s: s["v"]))
    pooled = F.array_distinct(pooled) if spec.func == "unique" else pooled
    return F.when(F.size(pooled) > 0, F.transform(pooled, typed))


def annotate(a: DataFrame, db: DataFrame, specs: list[Aggregate], options: MatchOptions = MatchOptions(), types: dict[str, str] | None = None) -> DataFrame:
    """Every record of ``a`` with one column per output: null where nothing matched or no match has the field, but 0 for counts.

    ``db`` has its fields in the map column ``info``; ``types`` gives their header types (String where missing).
    """
    types = types or {}
    fields = sorted({s.source for s in specs} - {COUNT, SIMILARITY})
    pairs = match(a, db, options)
    if fields:
        payload = db.select(F.col("src_index").alias("src_b"), *(field_values("info", f, types.get(f, "String")).alias(f"_v_{f}") for f in fields))
        pairs = pairs.join(payload, "src_b")
    outs = [aggregate_column(s, F.col(f"_v_{s.source}") if s.source in fields else F.lit(None), F.col("sim"), types.get(s.source, "String")).alias(s.out) for s in specs]
    found = pairs.groupBy(F.col("src_a").alias("src_index")).agg(*outs)
    kept = a.drop(*(s.out for s in specs))
    joined = kept.join(found, "src_index", "left")
    return joined.withColumns({s.out: F.coalesce(F.col(s.out), F.lit(0)) for s in specs if s.source == COUNT}) if any(s.source == COUNT for s in specs) else joined


def as_info_text(spec: Aggregate, kind: str) -> Column:
    """An output column as INFO text."""
    many, base = spec.number_and_type(kind)
    c = F.col(spec.out)
    one = six_decimals if base == "Float" else (lambda x: x.cast("string"))
    return F.array_join(F.transform(c, one), ",") if many == "." else F.when(c.isNotNull(), one(c))


def written_back(annotated: DataFrame, specs: list[Aggregate], types: dict[str, str]) -> DataFrame:
    """The outputs merged into the ``info`` map; a record without a value keeps what it had."""
    fresh = F.map_filter(F.map_from_arrays(F.array(*(F.lit(s.out) for s in specs)), F.array(*(as_info_text(s, types.get(s.source, "String")) for s in specs))), lambda _, v: v.isNotNull())
    old = F.map_filter("info", lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return annotated.withColumn("info", F.map_concat(old, fresh)).drop(*(s.out for s in specs))

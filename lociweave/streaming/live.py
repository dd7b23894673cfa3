"""Matching and annotating records as they arrive against a database that stays.

The lanes are stream-static inner joins, so they need no state. Annotation aggregates over each record's matches within its
micro-batch, which holds all of them because the database side is static.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lociweave.functions.aggspec import Aggregate
from lociweave.operators.annotate import annotate
from lociweave.operators.match import match
from lociweave.options import MatchOptions


def match_stream(records: DataFrame, db: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Pairs of each arriving record with its matches in ``db``, as a stream."""
    return match(records, db, options)


def annotate_stream(records: DataFrame, db: DataFrame, specs: list[Aggregate], sink: Callable[[DataFrame, int], None], options: MatchOptions = MatchOptions(), types: dict[str, str] | None = None):
    """A stream writer that hands every micro-batch, annotated, to ``sink(frame, batch_id)``."""
    return records.writeStream.foreachBatch(lambda batch, n: sink(annotate(batch, db, specs, options, types), n))

"""Spark-first analytics over structural-variant callsets: fuzzy interval and point joins, annotation, clustering and cohort merging."""

__version__ = "0.1.0"

"""Registered queries against their SQL in DuckDB, and the shape of the registry."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from lociweave.plans.oracles import core_oracle_sql
from lociweave.plans.queries import core_queries

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
SOME = ["match_all", "match_self", "chr_set_filter", "set_difference", "anno_best", "anno_unique", "skip_stats", "parse_bnd_alt", "components", "representative_pass_centre_order", "collapse_callers", "merge_missing_to_ref", "merge_callers_union", "cluster_average", "cluster_complete", "collapse_average", "merge_average", "scan_vcf", "scan_vcf_gz", "scan_bcf", "scan_parquet", "unknown_contigs", "merge_files", "collapse_files", "annotate_files"]


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, name):
    got = core_queries()[name](spark, str(DATA))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    want = db.execute(core_oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_registry():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(core_queries()) <= set(oracles)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry_module.entry(spark).limit(5).count() == 5


def test_text_operators_are_not_imported_elsewhere():
    for path in [*(ROOT / "lociweave").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("lociweave.llm", "corpus_pipeline")) for n in names), path

"""Scalar functions, options, headers, components and agglomeration against independent versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lociweave.functions.aggspec import Aggregate, checked, parse_aggregate
from lociweave.functions.normalize import info_text, kept_info
from lociweave.functions.similarity import bin_range, jaccard, passes, quantized_qual, reciprocal_overlap, signed_svlen, six_decimals, size_bin
from lociweave.operators import match as m
from lociweave.operators.annotate import annotate
from lociweave.operators.cluster import agglomerate, cluster, unique_edges
from lociweave.operators.collapse import collapse
from lociweave.operators.components import _fingerprint, connected_components
from lociweave.operators.merge import merge
from lociweave.options import ClusterOptions, MatchOptions, name_list, parse_priority
from lociweave.sources.header import Field, Header, unify

SCHEMA = "src_index long, chrom string, svtype string, pos long, end_pos long, svlen long, chr2 string, pos2 long"


def test_similarity_values(spark):
    rows = [(1000, 2000, 1100, 2100), (1000, 2000, 2000, 3000), (5, 5, 1, 9), (17000, 22000, 17000, 18000)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select(reciprocal_overlap(*map(F.col, "abcd")), jaccard(*map(F.col, "abcd"))).collect()
    assert [tuple(r) for r in got] == [(0.9, 900 / 1100), (0.0, 0.0), (0.0, 0.0), (0.2, 0.2)]


def test_bins_signs_and_quality(spark):
    lengths = [1, 511, 512, 1023, 1024, 100000, 0, -1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lengths], "x long").select(size_bin(F.col("x"))).collect()]
    assert got == [0, 0, 1, 1, 2, 8, 0, 0]
    assert [bin_range(n) for n in (0, 1, 8)] == [(0, 512), (512, 1024), (65536, 131072)]
    df = spark.createDataFrame([("DEL", 5), ("DUP", 5), ("INS", 5), ("INV", 5), ("BND", 5)], "t string, n long")
    assert [r[0] for r in df.select(signed_svlen(F.col("t"), F.col("n"))).collect()] == [-5, 5, 5, 5, 0]
    df = spark.createDataFrame([(50.3,), (-1.0,), (1e9,), (None,)], "q double")
    assert [r[0] for r in df.select(quantized_qual(F.col("q"))).collect()] == [201, 0, 65535, 0]
    df = spark.createDataFrame([([],), (["PASS"],), (["PASS", "x"],), (None,)], "f array<string>")
    assert [r[0] for r in df.select(passes(F.col("f"))).collect()] == [True, True, False, True]
    df = spark.createDataFrame([(0.9765625,), (2 / 3,), (1.0,)], "x double")
    assert [r[0] for r in df.select(six_decimals(F.col("x"))).collect()] == [f"{x:.6f}" for x in (0.9765625, 2 / 3, 1.0)]


def test_options():
    assert MatchOptions().threshold == 0.75 and MatchOptions(min_overlap=0.5).metric == "overlap"
    assert MatchOptions(chr_set=("a", "b")).chrs == ("a", "b")
    for bad in ({"min_overlap": 0.5, "min_jaccard": 0.5}, {"min_overlap": 0.0}, {"min_jaccard": 1.1}, {"bnd_slop": 0}, {"min_ins_sim": 2.0}, {"chrs": ("c",), "chr_set": ("a",)}):
        with pytest.raises(ValueError):
            MatchOptions(**bad)
    assert parse_priority("qual") == ("QUAL", "ORDER") and parse_priority("PASS,CENTER,ORDER") == ("PASS", "CENTRE", "ORDER")
    for bad in ("a,,b", "a,a", ""):
        with pytest.raises(ValueError):
            name_list(bad, "x")
    with pytest.raises(ValueError):
        ClusterOptions(linkage="ward")


def test_expressions():
    assert parse_aggregate("OUT=MAX(AF)") == Aggregate("OUT", "max", "AF")
    for bad in ("no_equals(x)", "BAD=", "BAD=funcwithoutparens", "BAD=max()", "=max(X)", "BAD=max(BAD NAME)", "BAD=median(X)"):
        with pytest.raises(ValueError):
            parse_aggregate(bad)
    a = parse_aggregate("X=max(AF)")
    for specs, existing in (([], set()), ([a, a], set()), ([a], {"X"}), ([parse_aggregate("X=max(ZZ)")], set())):
        with pytest.raises(ValueError):
            checked(specs, {"AF": "Float"}, existing)
    assert checked([a], {"AF": "Float"}, {"X"}, overwrite=True) == [a]
    assert parse_aggregate("X=all(AC)").number_and_type("Integer") == (".", "Integer") and parse_aggregate("X=mean(AC)").number_and_type("Integer") == ("1", "Float")


def test_info_projection(spark):
    df = spark.createDataFrame([({"A": "1", "A_x": "2", "B": "0.5", "F": ""},), ({},)], "info map<string,string>")
    assert [r[0] for r in df.select(kept_info(["A"])).collect()] == [{"A": "1", "A_x": "2"}, {}]
    assert [r[0] for r in df.select(info_text("info", ["B", "A", "Z"], ("B",))).collect()] == ["B=0.500000;A=1", "."]


def test_header_unification():
    one, two = Header(info={"A": Field("A", "1", "Integer", "x"), "B": Field("B", "1", "Float", "y")}), Header(info={"A": Field("A", ".", "Integer", "z"), "B": Field("B", "1", "String", "y")})
    got = unify([one, two], ["p", "q"])
    assert got.info["A"] == Field("A", ".", "Integer", "x; z") and set(got.info) == {"A", "B_p", "B_q"} and got.info_renames == [{"B": "B_p"}, {"B": "B_q"}]
    lines = one.lines()
    assert Header.parse(lines).info == one.info


def brute_agglomerate(nodes, sims, linkage, threshold):
    groups = [[x] for x in sorted(nodes)]
    of = lambda x, y: sims.get((min(x, y), max(x, y)), 0.0)
    size = lambda g, h: [of(x, y) for x in g for y in h]
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                v = size(groups[i], groups[j])
                s = max(v) if linkage == "single" else min(v) if linkage == "complete" else sum(v) / len(v)
                if s >= threshold and (best is None or s > best[0] + 1e-12):
                    best = (s, i, j)
        if best is None:
            return sorted(sorted(g) for g in groups)
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("linkage", ["single", "average", "complete"])
def test_agglomeration_against_brute_force(linkage):
    rng = random.Random(3)
    for n in (1, 8, 20, 40):
        for _ in range(4):
            sims = {(i, j): round(rng.uniform(0.3, 1), 4) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3}
            got = agglomerate(list(range(n)), sims, linkage, 0.6)
            assert sorted(sorted(g) for g in got) == brute_agglomerate(range(n), sims, linkage, 0.6)
    assert agglomerate([], {}, linkage, 0.5) == [] and agglomerate([4], {}, linkage, 0.5) == [[4]]
    ties = {(i, j): 0.9 for i in range(9) for j in range(i + 1, 9)}
    assert len(agglomerate(list(range(9)), ties, linkage, 0.5)) == 1


def test_absent_pair_splits_average_and_complete(spark):
    records = spark.createDataFrame([(1,), (2,), (3,), (9,)], "src_index long")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "src_a long, src_b long, sim double")
    got = {k: {r["src_index"]: r["cluster_id"] for r in cluster(records, edges, k, 0.75).collect()} for k in ("single", "average", "complete")}
    assert got["single"] == {1: 1, 2: 1, 3: 1, 9: 9}
    assert got["average"] == got["complete"] == {1: 1, 2: 1, 3: 3, 9: 9}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    for most in (10**6, 0):  # in one task, and in rounds
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", task_edges=most).collect()}
        assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("options", [MatchOptions(min_jaccard=0.3), MatchOptions(min_overlap=0.9), MatchOptions(min_jaccard=1.0), MatchOptions(min_overlap=0.05)])
def test_interval_join_against_brute_force(spark, options):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        pos, length = rng.randrange(1, 4000), int(2 ** rng.uniform(0, 13))
        rows.append((i, f"chr{rng.randrange(2)}", rng.choice(["DEL", "DUP"]), pos, pos + length, length, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["src_a"], r["src_b"], round(r["sim"], 9)) for r in m.match_self(df, options).collect())
    want = []
    for a in rows:
        for b in rows:
            ov = min(a[4], b[4]) - max(a[3], b[3])
            if a[0] < b[0] and a[1:3] == b[1:3] and ov > 0:
                s = ov / (max(a[4], b[4]) - min(a[3], b[3])) if options.metric == "jaccard" else ov / max(a[5], b[5])
                if s >= options.threshold:
                    want.append((a[0], b[0], round(s, 9)))
    assert got == sorted(want)


def test_self_join_keeps_pairs_across_size_classes(spark):
    rows = [(1, "chr1", "DEL", 1000, 2100, 1100, None, None), (2, "chr1", "DEL", 1050, 2050, 1000, None, None)]
    assert [(r["src_a"], r["src_b"]) for r in m.match_self(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 2)]


def test_breakends_match_but_do_not_cluster(spark):
    rows = [(1, "chr2", "BND", 60000, 60001, None, "chr2", 80000), (2, "chr2", "BND", 60020, 60021, None, "chr2", 80020)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = m.match_self(df)
    assert [round(r["sim"], 9) for r in pairs.collect()] == [0.6]
    assert {r["cluster_id"] for r in cluster(df, unique_edges(pairs), "average", 0.75).collect()} == {1, 2}


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "chr1", "DEL", 5, None, None, None, None)], SCHEMA)
    assert m.match(none, nulls).count() == 0 and m.match_self(nulls).count() == 0
    with_info = nulls.withColumn("info", F.create_map().cast("map<string,string>"))
    got = annotate(nulls, with_info, [parse_aggregate("N=max(MATCH_COUNT)"), parse_aggregate("M=max(AF)")], types={"AF": "Float"}).collect()
    assert [(r["N"], r["M"]) for r in got] == [(0, None), (0, None)]


def test_keys_of_a_record_grow_with_the_inverse_threshold(spark):
    """No threshold makes a record visit quadratically many tiles."""
    df = spark.createDataFrame([(1, "chr1", "DEL", 5_000_000, 5_100_000, 100_000, None, None)], SCHEMA)
    keys = {t: m.interval_keys(df, t).count() for t in (0.75, 0.2, 0.1, 0.05, 0.025)}
    assert keys[0.75] <= 8 and keys[0.025] <= 2.6 * keys[0.05] <= 2.6 * 2.6 * keys[0.1] and keys[0.025] < 300


def test_large_components_name_their_caller(spark):
    from lociweave.operators.cluster import component_report

    rows = [(i, i % 3 if i < 4 else 2, "chr1", "DEL") for i in range(8)] + [(20, 0, "chr2", "DUP"), (21, 1, "chr2", "DUP")]
    records = spark.createDataFrame(rows, "src_index long, caller_idx int, chrom string, svtype string")
    edges = spark.createDataFrame([(i, i + 1, 0.9) for i in range(7)] + [(20, 21, 0.9)], "src_a long, src_b long, sim double")
    got = [tuple(r) for r in component_report(records, edges, 3).collect()]
    assert got == [(0, 8, 7, "chr1", "DEL", 2, 5 / 8)]


def test_fingerprint_of_very_many_edges(spark):
    edges = spark.range(1 << 25).select((F.col("id") + 1).alias("hi"), F.col("id").alias("lo"))
    n, h = _fingerprint(edges)
    assert n == 1 << 25 and (n, h) == _fingerprint(edges.repartition(3)) and h != _fingerprint(edges.where("lo > 0"))[1]


def _calls(spark, n):
    """Single-base calls of two samples at 50 loci."""
    return spark.range(n).selectExpr(
        "id AS src_index", "CAST(id % 2 AS INT) AS caller_idx", "'chr1' AS chrom", "'INS' AS svtype", "10000 * (id % 50) AS pos", "10000 * (id % 50) + 1 AS end_pos", "CAST(100 AS BIGINT) AS svlen",
        "'chr1' AS chr2", "CAST(0 AS BIGINT) AS pos2", "true AS is_pass", "CAST(id AS INT) AS qual_q", "'S' || id % 2 AS sample", "'0/1' AS gt", "'c' AS callers",
    )


@pytest.mark.parametrize("linkage", ["single", "average"])
def test_tables_that_grow_with_the_records_are_not_broadcast(spark, linkage):
    options = ClusterOptions(linkage=linkage, priority=("PASS", "CENTRE", "QUAL"))
    merged, collapsed = merge(_calls(spark, 100), ["S0", "S1"], options), collapse(_calls(spark, 100), ["a", "b"], options)
    for found in (merged, collapsed):
        assert found.count() == 50
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()

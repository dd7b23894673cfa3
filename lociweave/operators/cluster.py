"""Clusters of similar records, and their representatives.

A merge under any of the three linkages needs at least one pair at the threshold between the two sides, so clusters never
leave the components of the graph of pairs at or above it. Single linkage is those components. For average and complete linkage
each component, with all its pairs, is agglomerated by one kernel call; components are small wherever the threshold means
anything, and ``large_components`` names the others.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators.components import connected_components
from lociweave.plans.runtime import exchanged, materialize

LARGE = 500


def unique_edges(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair: src_a < src_b and the largest similarity."""
    return pairs.where("src_a <> src_b").groupBy(F.least("src_a", "src_b").alias("src_a"), F.greatest("src_a", "src_b").alias("src_b")).agg(F.max("sim").alias("sim"))


def agglomerate(nodes: list[int], sims: dict[tuple[int, int], float], linkage: str, threshold: float) -> list[list[int]]:
    """Greedy agglomeration: always the most similar pair of groups, the first in node order among equals, while at or above the threshold.

    Absent pairs are 0. A group is known by its first node; merging keeps the lower of two.
    """
    order = sorted(nodes)
    place = {x: i for i, x in enumerate(order)}
    near: list[dict[int, float]] = [{} for _ in order]
    heap = []
    for (x, y), s in sims.items():
        i, j = sorted((place[x], place[y]))
        if s > near[i].get(j, 0.0):
            near[i][j] = near[j][i] = s
    for i, row in enumerate(near):
        heap += [(-s, i, j) for j, s in row.items() if i < j and s >= threshold]
    heapq.heapify(heap)
    groups = {i: [x] for i, x in enumerate(order)}
    while heap:
        s, i, j = heapq.heappop(heap)
        if i not in groups or j not in groups or near[i].get(j) != -s:
            continue
        a, b = len(groups[i]), len(groups[j])
        for k in (near[i].keys() | near[j].keys()) - {i, j}:
            p, q = near[i].get(k, 0.0), near[j].get(k, 0.0)
            value = max(p, q) if linkage == "single" else min(p, q) if linkage == "complete" else (a * p + b * q) / (a + b)
            near[k].pop(j, None)
            if value > 0:
                near[i][k] = near[k][i] = value
                if value >= threshold and value != p:
                    heapq.heappush(heap, (-value, min(i, k), max(i, k)))
            else:
                near[i].pop(k, None)
                near[k].pop(i, None)
        near[i].pop(j, None)
        near[j].clear()
        groups[i] += groups.pop(j)
    return list(groups.values())


def cluster(records: DataFrame, edges: DataFrame, linkage: str = "average", threshold: float = 0.75) -> DataFrame:
    """src_index and cluster_id (the smallest member) of every record; ``edges`` as from ``unique_edges``."""
    linked = connected_components(edges.where(F.col("sim") >= threshold), "src_a", "src_b")
    if linkage == "single":
        found = linked.select(F.col("node").alias("src_index"), F.col("component").alias("cluster_id"))
    else:
        left = linked.select(F.col("node").alias("src_a"), "component")
        right = linked.select(F.col("node").alias("src_b"), F.col("component").alias("_other"))
        inside = edges.join(exchanged(left), "src_a").join(exchanged(right), "src_b").where(F.col("component") == F.col("_other")).select("component", "src_a", "src_b", "sim")

        def kernel(table: pa.Table) -> pa.Table:
            a, b, s = (table[c].to_pylist() for c in ("src_a", "src_b", "sim"))
            sims = {(x, y): z for x, y, z in zip(a, b, s, strict=True)}
            groups = agglomerate(list({*a, *b}), sims, linkage, threshold)
            rows = [(x, min(g)) for g in groups for x in g]
            return pa.table({"src_index": pa.array([r[0] for r in rows], pa.int64()), "cluster_id": pa.array([r[1] for r in rows], pa.int64())})

        found = inside.groupBy("component").applyInArrow(kernel, "src_index long, cluster_id long")
    return records.select("src_index").join(exchanged(found), "src_index", "left").select("src_index", F.coalesce("cluster_id", "src_index").alias("cluster_id"))


def large_components(edges: DataFrame, least: int = LARGE) -> DataFrame:
    """component and n of the components of all edges with at least ``least`` records."""
    return connected_components(edges, "src_a", "src_b").groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def component_report(records: DataFrame, edges: DataFrame, least: int = LARGE) -> DataFrame:
    """component, n, n_edges, chrom, svtype, caller_idx (the one with most records) and share (of its records) of each large component."""
    linked = connected_components(edges, "src_a", "src_b")
    inside = edges.select(F.col("src_a").alias("node")).join(exchanged(linked), "node").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    per_caller = records.select(F.col("src_index").alias("node"), "chrom", "svtype", "caller_idx").join(exchanged(linked), "node")
    per_caller = per_caller.groupBy("component", "caller_idx").agg(F.count(F.lit(1)).alias("k"), F.min("chrom").alias("chrom"), F.min("svtype").alias("svtype"))
    top = F.max_by("caller_idx", F.struct(F.col("k"), -F.col("caller_idx")))
    found = per_caller.groupBy("component").agg(F.sum("k").alias("n"), F.min("chrom").alias("chrom"), F.min("svtype").alias("svtype"), top.alias("caller_idx"), (F.max("k") / F.sum("k")).alias("share"))
    return found.where(F.col("n") >= least).join(inside, "component").select("component", "n", "n_edges", "chrom", "svtype", "caller_idx", "share")


def centrality(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """src_index, centre: mean similarity to the other members, absent pairs counting 0; only members with an inner edge have a row."""
    left = clusters.select(F.col("src_index").alias("src_a"), "cluster_id")
    right = clusters.select(F.col("src_index").alias("src_b"), F.col("cluster_id").alias("_other"))
    inside = edges.join(exchanged(left), "src_a").join(exchanged(right), "src_b").where(F.col("cluster_id") == F.col("_other"))
    both = inside.select(F.explode(F.array(F.col("src_a"), F.col("src_b"))).alias("src_index"), "cluster_id", "sim")
    sums = both.groupBy("src_index", "cluster_id").agg(F.sum("sim").alias("s"))
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(exchanged(sizes), "cluster_id").select("src_index", (F.col("s") / (F.col("n") - 1)).alias("centre"))


def cascade(priority: tuple[str, ...]) -> list:
    """Sort keys, best first ascending, over is_pass, qual_q, centre and caller_idx."""
    keys = {"PASS": (~F.col("is_pass")).cast("int"), "QUAL": -F.col("qual_q"), "CENTRE": -F.round(F.coalesce("centre", F.lit(0.0)), 12), "ORDER": F.col("caller_idx")}
    return [keys[p] for p in priority] + [F.col("caller_idx"), F.col("src_index")]


def representatives(records: DataFrame, clusters: DataFrame, edges: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """cluster_id and rep (src_index), the first member by the cascade; a partial aggregate, whatever the cluster's size."""
    members = records.select("src_index", "is_pass", "qual_q", "caller_idx").join(exchanged(clusters), "src_index")
    if "CENTRE" in priority:
        members = members.join(exchanged(centrality(clusters, edges)), "src_index", "left")
    keys = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(cascade(priority))))
    return members.groupBy("cluster_id").agg(F.min_by("src_index", keys).alias("rep"))


def staged_clusters(records: DataFrame, pairs: DataFrame, linkage: str, threshold: float, watch=None) -> tuple[DataFrame, DataFrame]:
    """Clusters and edges, both written once for the several readers that follow; ``watch(records, edges)`` sees the edges first."""
    edges = materialize(unique_edges(pairs), "edges")
    if watch is not None:
        watch(records, edges)
    return materialize(cluster(records, edges, linkage, threshold), "clusters"), edges

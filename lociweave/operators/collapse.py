"""Collapsing the calls of several callers for one sample: one representative per cluster with its provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators.cluster import representatives, staged_clusters
from lociweave.operators.match import active, match_self
from lociweave.options import ClusterOptions
from lociweave.plans.runtime import exchanged


def provenance(members: DataFrame, names: list[str]) -> DataFrame:
    """cluster_id, callers (the representative's first, then by index), n_callers, n_merged from cluster_id, rep, src_index, caller_idx."""
    lead = F.max(F.when(F.col("src_index") == F.col("rep"), F.col("caller_idx")))
    grouped = members.groupBy("cluster_id").agg(F.array_sort(F.collect_set("caller_idx")).alias("c"), lead.alias("lead"), F.count(F.lit(1)).alias("n_merged"))
    named = F.array(*(F.lit(n) for n in names))
    listed = F.concat(F.array("lead"), F.filter("c", lambda x: x != F.col("lead")))
    return grouped.select("cluster_id", F.array_join(F.transform(listed, lambda i: F.get(named, i)), ",").alias("callers"), F.size("c").alias("n_callers"), "n_merged")


def collapse(records: DataFrame, names: list[str], options: ClusterOptions = ClusterOptions(), watch=None) -> DataFrame:
    """The representatives' rows of ``records`` with cluster_id, callers, n_callers and n_merged, which replace columns of these names.

    ``names`` are the callers by caller_idx. Skipped and inactive records are not part of the result. The cluster threshold
    is the interval threshold for every type. ``watch`` is called with the records and their edges before clustering.
    """
    kept = active(records, options.match)
    clusters, edges = staged_clusters(kept, match_self(kept, options.match), options.linkage, options.match.threshold, watch)
    reps = representatives(kept, clusters, edges, options.priority)
    members = clusters.join(exchanged(reps), "cluster_id").join(exchanged(kept.select("src_index", "caller_idx")), "src_index")
    found = provenance(members, names).join(exchanged(reps), "cluster_id").withColumnRenamed("rep", "src_index")
    return kept.drop("cluster_id", "callers", "n_callers", "n_merged").join(exchanged(found), "src_index")

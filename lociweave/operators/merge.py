"""Merging single-sample callsets into a cohort table with genotypes by sample and allele counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.cluster import representatives, staged_clusters
from lociweave.operators.match import active, match_self
from lociweave.options import ClusterOptions
from lociweave.plans.runtime import exchanged, materialize


def alleles(gt: Column) -> Column:
    return F.split(gt, r"[/|]")


def called(gt: Column) -> Column:
    """Alleles that are not missing."""
    return F.size(F.filter(alleles(gt), lambda x: (x != ".") & (x != "")))


def alternate(gt: Column) -> Column:
    """Alleles of 1 or more."""
    return F.size(F.filter(alleles(gt), lambda x: x.try_cast("int") >= 1))


def sample_picks(members: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """The member that stands for each (cluster_id, sample): PASS and QUAL where asked for, then the representative, then the smallest src_index."""
    keys = {"PASS": (~F.col("is_pass")).cast("int"), "QUAL": -F.col("qual_q"), "CENTRE": F.col("caller_idx"), "ORDER": F.col("caller_idx")}
    order = [keys[p] for p in priority] + [(F.col("src_index") != F.col("rep")).cast("int"), F.col("src_index")]
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order)))
    return members.groupBy("cluster_id", "sample").agg(F.min_by(F.struct("src_index", "gt"), key).alias("p"), F.count(F.lit(1)).alias("n")).select("cluster_id", "sample", "p.src_index", "p.gt", "n")


def allele_counts(picks: DataFrame, n_samples: int, missing_to_ref: bool = False) -> DataFrame:
    """cluster_id, ac, an, af; absent samples count as reference of the row's largest ploidy if ``missing_to_ref``."""
    each = picks.select("cluster_id", called(F.col("gt")).alias("c"), alternate(F.col("gt")).alias("a"), F.size(alleles(F.col("gt"))).alias("k"))
    an = F.sum("c")
    if missing_to_ref:
        an = an + (F.lit(n_samples) - F.count(F.lit(1))) * F.max("k")
    summed = each.groupBy("cluster_id").agg(F.coalesce(F.sum("a"), F.lit(0)).cast("int").alias("ac"), F.coalesce(an, F.lit(0)).cast("int").alias("an"))
    return summed.withColumn("af", F.when(F.col("an") > 0, F.col("ac") / F.col("an")))


def genotype_map(picks: DataFrame) -> DataFrame:
    """cluster_id and genotypes: a map from sample to genotype."""
    return picks.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("genotypes"))


def genotype_of(sample: str, ploidy: Column | None = None, missing_to_ref: bool = False) -> Column:
    """A sample's genotype in a cohort row: missing, or reference if so asked, where it has none."""
    width = F.lit(2) if ploidy is None else ploidy
    blank = F.array_join(F.array_repeat(F.lit("0" if missing_to_ref else "."), width), "/")
    return F.coalesce(F.col("genotypes")[sample], blank)


def callers_union(members: DataFrame) -> DataFrame:
    """cluster_id, callers, n_callers from members with a ``callers`` list: the representative's first, then by src_index, each name once."""
    own = F.struct((F.col("src_index") != F.col("rep")).alias("o"), "src_index", F.transform(F.split("callers", ","), lambda x: F.trim(x)).alias("v"))
    listed = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("callers").isNotNull(), own))), lambda s: s["v"])))
    out = members.groupBy("cluster_id").agg(listed.alias("c"))
    return out.where(F.size("c") > 0).select("cluster_id", F.array_join("c", ",").alias("callers"), F.size("c").alias("n_callers"))


def merge(records: DataFrame, samples: list[str], options: ClusterOptions = ClusterOptions(), missing_to_ref: bool = False, watch=None) -> DataFrame:
    """The representatives' rows of ``records`` with cluster_id, genotypes, ac, an, af and collisions (records passed over for another of
    the same sample), which replace columns of these names.

    ``records`` have sample and gt; ``samples`` lists all of the cohort. If they have a column ``callers`` of comma-separated names,
    it becomes the union over the cluster, with n_callers.
    """
    kept = active(records, options.match)
    clusters, edges = staged_clusters(kept, match_self(kept, options.match), options.linkage, options.match.threshold, watch)
    reps = materialize(representatives(kept, clusters, edges, options.priority), "reps")
    named = ["callers"] if "callers" in kept.columns else []
    members = clusters.join(exchanged(reps), "cluster_id").join(exchanged(kept.select("src_index", "caller_idx", "is_pass", "qual_q", "sample", "gt", *named)), "src_index")
    picks = materialize(sample_picks(members, options.priority), "picks")
    counts = allele_counts(picks, len(samples), missing_to_ref)
    lost = picks.groupBy("cluster_id").agg((F.sum("n") - F.count(F.lit(1))).alias("collisions"))
    found = reps.join(exchanged(counts), "cluster_id").join(exchanged(genotype_map(picks)), "cluster_id").join(exchanged(lost), "cluster_id").withColumnRenamed("rep", "src_index")
    if named:
        found = found.join(exchanged(callers_union(members)), "cluster_id", "left")
    return kept.drop("cluster_id", "genotypes", "ac", "an", "af", "collisions", "callers", "n_callers").join(exchanged(found), "src_index")

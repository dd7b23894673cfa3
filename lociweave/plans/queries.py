"""Registered queries of the callset operators over the derived callsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.commands import run_annotate, run_collapse, run_merge
from lociweave.functions import normalize as norm
from lociweave.functions.aggspec import parse_aggregate
from lociweave.functions.normalize import info_text
from lociweave.functions.similarity import quantized_qual, signed_svlen, six_decimals
from lociweave.operators import cluster as cl
from lociweave.operators import match as m
from lociweave.operators.annotate import annotate
from lociweave.operators.collapse import collapse
from lociweave.operators.merge import allele_counts, callers_union, genotype_of, merge, sample_picks
from lociweave.operators.setops import intersect, setdiff
from lociweave.options import INTERVAL_TYPES, ClusterOptions, MatchOptions
from lociweave.plans.derived import callset, fresh_table, raw_file, raw_records, sample_file, sides
from lociweave.plans.runtime import materialize
from lociweave.sources.vcf import read_callset

JACCARD = MatchOptions(min_jaccard=0.75)
OVERLAP = MatchOptions(min_overlap=0.8)
SINGLE = ClusterOptions(linkage="single")
TYPES = {"AF": "Float", "AC": "Integer", "ANN": "String"}
SAMPLES = ["S0", "S1", "S2"]
CALLERS = ["c0", "c1", "c2"]
_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _FOUND[f.__name__] = f
    return f


def _micro(name: str = "sim"):
    return F.round(F.col(name) * 1000000).cast("long").alias(f"{name}_micro")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("src_a", "src_b", "chrom", "svtype", "pos_a", "pos_b", _micro())


@query
def match_interval_jaccard(spark, sf_dir):
    return _pairs(m.interval_pairs(*sides(spark, sf_dir), JACCARD))


@query
def match_interval_overlap(spark, sf_dir):
    return _pairs(m.interval_pairs(*sides(spark, sf_dir), OVERLAP))


@query
def match_bnd(spark, sf_dir):
    return _pairs(m.breakend_pairs(*sides(spark, sf_dir), JACCARD))


@query
def match_ins(spark, sf_dir):
    return _pairs(m.insertion_pairs(*sides(spark, sf_dir), JACCARD))


@query
def match_all(spark, sf_dir):
    return _pairs(m.match(*sides(spark, sf_dir), JACCARD))


@query
def match_self(spark, sf_dir):
    return _pairs(m.match_self(callset(spark, sf_dir), JACCARD))


@query
def match_by_svtype(spark, sf_dir):
    return m.match(*sides(spark, sf_dir), JACCARD).groupBy("svtype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("sim") * 1000000).cast("long")).alias("sim_micro"))


@query
def match_contigs(spark, sf_dir):
    return _pairs(m.match(*sides(spark, sf_dir), MatchOptions(chrs=("chr2",))))


@query
def match_resolved(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return m.resolved(m.match(a, b, JACCARD), a, b, ("qual_q", "sample")).select("src_a", "src_b", "svtype", "qual_q_a", "qual_q_b", "sample_a", "sample_b", six_decimals(F.col("sim")).substr(1, 5).alias("sim_text"))


@query
def chr_set_filter(spark, sf_dir):
    return _pairs(m.match(*sides(spark, sf_dir), MatchOptions(chr_set=("chr1", "chr2"))))


def _shown(df):
    return df.select("src_index", "chrom", "svtype", "pos", "end_pos", "svlen")


@query
def set_intersect(spark, sf_dir):
    return _shown(intersect(*sides(spark, sf_dir), JACCARD))


@query
def set_difference(spark, sf_dir):
    return _shown(setdiff(*sides(spark, sf_dir), JACCARD))


@query
def setop_partition_check(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    both = intersect(a, b, JACCARD).select("svtype", F.lit(1).alias("i"), F.lit(0).alias("d")).union(setdiff(a, b, JACCARD).select("svtype", F.lit(0), F.lit(1)))
    return both.groupBy("svtype").agg(F.sum("i").alias("n_intersect"), F.sum("d").alias("n_setdiff"), F.count(F.lit(1)).alias("n_all"))


def _annotated(expression: str, shown):
    spec = parse_aggregate(expression)

    def run(spark, sf_dir):
        a, b = sides(spark, sf_dir)
        return annotate(a, b, [spec], JACCARD, TYPES).select("src_index", shown(F.col(spec.out)).alias(spec.out.lower()))

    return run


_whole = lambda c: F.round(c * 1000000).cast("long")
_same = lambda c: c
_list = lambda c: F.array_join(c, ",")
ANNOTATIONS = {
    "anno_max": ("MAX_AF=max(AF)", _whole), "anno_min": ("MIN_AC=min(AC)", _same), "anno_mean": ("MEAN_AC=mean(AC)", lambda c: F.floor(c * 1000).cast("long")), "anno_first": ("FIRST_AC=first(AC)", _same),
    "anno_last": ("LAST_ANN=last(ANN)", _same), "anno_best": ("BEST_ANN=best(ANN)", _same), "anno_all": ("ALL_ANN=all(ANN)", _list), "anno_unique": ("UNIQUE_ANN=unique(ANN)", _list),
    "anno_count": ("N_MATCH=first(MATCH_COUNT)", _same), "anno_similarity": ("TOP_SIM=max(MATCH_SIMILARITY)", _whole), "anno_text_number": ("MAX_ANN=max(ANN)", _whole),
}
for _name, (_expression, _show) in ANNOTATIONS.items():
    _FOUND[_name] = _annotated(_expression, _show)


@query
def resolve_svtype(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).select("src_index", "svtype", "skip_reason")


@query
def resolve_end_svlen(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).where(F.col("svtype").isin(*INTERVAL_TYPES)).select("src_index", "pos", "end_pos", "svlen")


@query
def parse_bnd_alt(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).where("svtype = 'BND'").select("src_index", "chr2", "pos2", "end_pos")


@query
def ins_length(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).where("svtype = 'INS'").select("src_index", "svlen")


@query
def synthesized_ids(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).select("src_index", "id")


@query
def skip_stats(spark, sf_dir):
    return norm.skip_statistics(norm.normalize(raw_records(spark, sf_dir), chr_set=("chr1", "chr2")))


@query
def size_bins(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).where("svtype is not null").groupBy("svtype", "size_bin").agg(F.count(F.lit(1)).alias("n"))


@query
def signed_lengths(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).where("svtype is not null").select("src_index", signed_svlen(F.col("svtype"), F.col("svlen")).alias("signed_svlen"))


@query
def qual_quantize(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).select("src_index", quantized_qual(F.col("qual") * 20).alias("qual_q"), "is_pass")


def _round_trip(end):
    """Records written in a format and read back: parsing, line numbers, normalisation and synthesized names."""

    def run(spark, sf_dir):
        found, _ = read_callset(spark, raw_file(spark, sf_dir, end))
        return found.select("lineno", "chrom", "pos", "id", "svtype", "end_pos", "svlen", "chr2", "pos2", "skip_reason", "is_pass", "qual_q", info_text("info", ["END", "SVLEN", "INSLEN"]).alias("info"))

    return run


for _end in ("vcf", "vcf.gz", "bcf", "parquet"):
    _FOUND[f"scan_{_end.replace('.', '_')}"] = _round_trip(f".{_end}")


@query
def unknown_contigs(spark, sf_dir):
    """Reasons of records when only two contigs of the file are known, and mates only on one."""
    found, _ = read_callset(spark, raw_file(spark, sf_dir, ".vcf"), contigs=["chr1", "chr2"], chr_set=("chr1",))
    return found.groupBy("chrom", F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def merge_files(spark, sf_dir):
    """The merge command over three files whose DP differ in type: renamed fields, GT added, counts and cells written and read back."""
    paths = [sample_file(spark, sf_dir, i, "Integer" if i == 0 else "String") for i in range(3)]
    out = fresh_table(spark)
    run_merge(spark, paths, out, ClusterOptions(linkage="single", priority=("PASS", "QUAL")), formats=["DP"])
    found, _ = read_callset(spark, out)
    cells = [F.get("samples", F.lit(i)).alias(f"cell_{s.lower()}") for i, s in enumerate(SAMPLES)]
    return found.select("id", "chrom", "svtype", "pos", F.array_join("format", ":").alias("format"), *cells, F.col("info")["AC"].alias("ac"), F.col("info")["AN"].alias("an"), F.col("info")["END"].alias("info_end"), F.col("info")["SVLEN"].alias("info_svlen"))


@query
def collapse_files(spark, sf_dir):
    """The collapse command over the same files: the representative's own cells under the renamed fields, with provenance."""
    paths = [(CALLERS[i], sample_file(spark, sf_dir, i, "Integer" if i == 0 else "String")) for i in range(3)]
    out = fresh_table(spark)
    run_collapse(spark, paths, out, ClusterOptions(linkage="single", priority=("PASS", "QUAL")), formats=["GT", "DP"])
    found, _ = read_callset(spark, out)
    return found.select("id", "chrom", "pos", F.array_join("format", ":").alias("format"), F.get("samples", F.lit(0)).alias("cell"), F.array_join("alt", ",").alias("alt"), *(F.col("info")[k].alias(k.lower()) for k in ("CALLERS", "N_CALLERS", "N_MERGED")))


@query
def annotate_files(spark, sf_dir):
    """The annotate command over two files: aggregates written as INFO, by match count and similarity."""
    paths = [sample_file(spark, sf_dir, i, "Integer") for i in range(2)]
    out = fresh_table(spark)
    run_annotate(spark, *paths, ["N=first(MATCH_COUNT)", "LONGEST=max(SVLEN)", "KINDS=unique(SVTYPE)"], out, JACCARD)
    found, _ = read_callset(spark, out)
    return found.select("id", "chrom", "pos", *(F.col("info")[k].alias(k.lower()) for k in ("N", "LONGEST", "KINDS")))


@query
def info_filter(spark, sf_dir):
    kept = raw_records(spark, sf_dir).select("src_index", norm.kept_info(["SVLEN"], ("END",)).alias("kept"))
    return kept.select("src_index", norm.info_text("kept", ["END", "SVLEN", "SVTYPE"]).alias("info"))


@query
def symbolic_alts(spark, sf_dir):
    return norm.normalize(raw_records(spark, sf_dir)).select("src_index", norm.symbolic_alt(F.coalesce("svtype", F.lit(""))).alias("alt"))


def _edges(spark, sf_dir):
    return cl.unique_edges(m.match_self(callset(spark, sf_dir), JACCARD))


@query
def edges_dedup(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    both = m.match(a, b, JACCARD).unionByName(m.match(b, a, JACCARD))
    return cl.unique_edges(both).select("src_a", "src_b", _micro())


@query
def components(spark, sf_dir):
    from lociweave.operators.components import connected_components

    return connected_components(_edges(spark, sf_dir), "src_a", "src_b").select(F.col("node").alias("src_index"), "component")


@query
def large_components(spark, sf_dir):
    return cl.large_components(_edges(spark, sf_dir), 12)


def _clusters(linkage):
    def run(spark, sf_dir):
        return cl.cluster(callset(spark, sf_dir), materialize(_edges(spark, sf_dir), "edges"), linkage, 0.75)

    return run


for _linkage in ("single", "average", "complete"):
    _FOUND[f"cluster_{_linkage}"] = _clusters(_linkage)


def _representatives(*priority):
    def run(spark, sf_dir):
        records = callset(spark, sf_dir)
        options = ClusterOptions(linkage="single", priority=priority)
        clusters, edges = cl.staged_clusters(records, m.match_self(records, options.match), "single", 0.75)
        return cl.representatives(records, clusters, edges, options.priority)

    return run


_FOUND["representative_pass_order"] = _representatives("PASS", "ORDER")
_FOUND["representative_qual"] = _representatives("QUAL")
_FOUND["representative_pass_centre_order"] = _representatives("PASS", "CENTRE", "ORDER")


@query
def collapse_callers(spark, sf_dir):
    found = collapse(callset(spark, sf_dir), CALLERS, ClusterOptions(linkage="single", priority=("PASS", "QUAL")))
    return found.select("src_index", "cluster_id", "chrom", "svtype", "pos", signed_svlen(F.col("svtype"), F.col("svlen")).alias("svlen"), "callers", "n_callers", "n_merged")


@query
def collapse_provenance(spark, sf_dir):
    found = collapse(callset(spark, sf_dir), CALLERS, ClusterOptions(linkage="single", priority=("QUAL",)))
    return found.groupBy("callers").agg(F.count(F.lit(1)).alias("n"), F.sum("n_merged").alias("n_merged"))


@query
def collapse_average(spark, sf_dir):
    return collapse(callset(spark, sf_dir), CALLERS).select("src_index", "cluster_id", "callers", "n_callers", "n_merged")


def _merged(missing_to_ref):
    def run(spark, sf_dir):
        options = ClusterOptions(linkage="single", priority=("PASS", "QUAL"))
        found = merge(callset(spark, sf_dir), SAMPLES, options, missing_to_ref)
        return found.select("src_index", "cluster_id", "chrom", "pos", *(genotype_of(s, None, missing_to_ref).alias(f"gt_{s.lower()}") for s in SAMPLES), "ac", "an", F.floor(F.col("af") * 1000000).cast("long").alias("af_micro"))

    return run


_FOUND["merge_cohort"] = _merged(False)
_FOUND["merge_missing_to_ref"] = _merged(True)




def _members(spark, sf_dir):
    records = callset(spark, sf_dir)
    options = ClusterOptions(linkage="single", priority=("PASS", "QUAL"))
    clusters, edges = cl.staged_clusters(records, m.match_self(records, options.match), "single", 0.75)
    reps = cl.representatives(records, clusters, edges, options.priority)
    return clusters.join(reps, "cluster_id").join(records.select("src_index", "caller_idx", "is_pass", "qual_q", "sample", "gt", F.col("ann").alias("callers")), "src_index"), options


@query
def same_sample_pick(spark, sf_dir):
    members, options = _members(spark, sf_dir)
    return sample_picks(members, options.priority).select("cluster_id", "sample", "src_index", "gt", "n")


@query
def merge_allele_counts(spark, sf_dir):
    members, options = _members(spark, sf_dir)
    counts = allele_counts(sample_picks(members, options.priority), len(SAMPLES))
    return counts.groupBy("ac", "an").agg(F.count(F.lit(1)).alias("n"))


@query
def merge_callers_union(spark, sf_dir):
    members, _ = _members(spark, sf_dir)
    return callers_union(members)


@query
def merge_average(spark, sf_dir):
    return merge(callset(spark, sf_dir), SAMPLES).select("src_index", "cluster_id", "ac", "an")


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)

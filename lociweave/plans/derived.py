"""Callsets derived from the order table by projections that read the same in Spark SQL and in ANSI SQL.

Each customer is a locus with about ten records of three callers; see the expressions for positions, types and genotypes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.plans.runtime import staged_path
from lociweave.sources.header import Field, Header
from lociweave.sources.vcf import record_line, write_callset

_TYPE = "CASE o_custkey % 5 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' WHEN 3 THEN 'BND' ELSE 'INS' END"
_POS = "(10000 * o_custkey + (o_orderkey * 7919 % 40) * 10)"
_LEN = "(300 + (o_custkey % 60) * 40 + (o_orderkey % 7) * 15)"

#: Name and expression of each column of the derived callset.
CALLSET = {
    "src_index": "CAST(o_orderkey AS BIGINT)",
    "caller_idx": "CAST(o_orderkey % 3 AS INT)",
    "chrom": "'chr' || CAST(1 + o_custkey % 3 AS STRING)",
    "svtype": _TYPE,
    "pos": f"CAST({_POS} AS BIGINT)",
    "end_pos": f"CAST({_POS} + CASE WHEN o_custkey % 5 < 3 THEN {_LEN} ELSE 1 END AS BIGINT)",
    "svlen": f"CAST({_LEN} AS BIGINT)",
    "chr2": "'chr' || CAST(1 + (o_custkey * 7) % 3 AS STRING)",
    "pos2": "CAST(500000 + 10000 * o_custkey + (o_orderkey % 30) * 5 AS BIGINT)",
    "is_pass": "o_orderstatus <> 'P'",
    "qual": "CAST(o_totalprice AS DOUBLE) / 100.0E0",
    "sample": "'S' || CAST(o_orderkey % 3 AS STRING)",
    "gt": "CASE o_orderpriority WHEN '1-URGENT' THEN '0/1' WHEN '2-HIGH' THEN '1/1' WHEN '3-MEDIUM' THEN '0/0' WHEN '5-LOW' THEN '0|1' ELSE './.' END",
    "af": "CAST(o_orderkey % 1000 AS DOUBLE) / 1000.0E0",
    "ac": "CAST(o_orderkey % 97 AS INT)",
    "ann": "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'c' || CAST(o_orderkey % 3 AS STRING) || ',x' ELSE 'c' || CAST(o_orderkey % 3 AS STRING) END",
}

_BAD = "o_orderkey % 11"
_MATE = "'chr' || CAST(1 + (o_custkey * 7) % 3 AS STRING) || ':' || CAST(500000 + o_orderkey % 3000 AS STRING)"
#: Records as a file would hold them, about one in ten malformed in one of several ways.
RAW = {
    "src_index": "CAST(o_orderkey AS BIGINT)",
    "caller_idx": "CAST(o_orderkey % 3 AS INT)",
    "chrom": CALLSET["chrom"],
    "pos": CALLSET["pos"],
    "id": "CASE WHEN o_orderkey % 5 = 0 THEN '.' ELSE 'v' || CAST(o_orderkey AS STRING) END",
    "ref": "'N'",
    "alt": f"""CASE o_custkey % 5
      WHEN 0 THEN CASE WHEN {_BAD} = 0 THEN '<CNV>' ELSE '<DEL>' END
      WHEN 1 THEN CASE WHEN {_BAD} = 1 THEN '<TRA>' WHEN o_orderkey % 2 = 0 THEN '<dup>' ELSE 'N' END
      WHEN 2 THEN '<INV>'
      WHEN 3 THEN CASE WHEN {_BAD} = 3 THEN 'N[chr1:' WHEN o_orderkey % 2 = 0 THEN 'N[' || {_MATE} || '[' ELSE ']' || {_MATE} || ']N' END
      ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'NACGTACGTACGT' ELSE '<INS>' END END""",
    "info_svtype": "CASE o_custkey % 5 WHEN 0 THEN 'DUP' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'DUP' END WHEN 3 THEN 'BND' ELSE NULL END",
    "info_end": f"CASE WHEN o_custkey % 5 > 2 OR o_orderkey % 3 = 0 THEN NULL WHEN {_BAD} = 5 THEN CAST({_POS} - 5 AS STRING) ELSE CAST({_POS} + {_LEN} AS STRING) END",
    "info_svlen": f"CASE WHEN o_custkey % 5 = 3 OR o_orderkey % 13 = 0 OR (o_custkey % 5 = 4 AND o_orderkey % 4 <> 1) THEN NULL ELSE CAST(-{_LEN} AS STRING) END",
    "info_inslen": "CASE WHEN o_custkey % 5 = 4 AND o_orderkey % 4 = 2 THEN CAST(30 + o_orderkey % 50 AS STRING) ELSE NULL END",
    "info_left": "CASE WHEN o_custkey % 5 = 4 AND o_orderkey % 8 = 3 THEN 'ACGTACGT' ELSE NULL END",
    "info_right": "CASE WHEN o_custkey % 5 = 4 AND o_orderkey % 8 = 3 THEN 'ACG' ELSE NULL END",
    "qual": CALLSET["qual"],
    "filter": "CASE WHEN o_orderstatus = 'P' THEN 'LowQual' WHEN o_orderstatus = 'O' THEN 'PASS' ELSE '.' END",
}

INFO_KEYS = {"SVTYPE": "info_svtype", "END": "info_end", "SVLEN": "info_svlen", "INSLEN": "info_inslen", "LEFT_SVINSSEQ": "info_left", "RIGHT_SVINSSEQ": "info_right"}


def callset_sql(columns: dict[str, str] = CALLSET) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def callset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived callset with qual_q and an info map of AF, AC and ANN."""
    df = _orders(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in CALLSET.items()))
    fields = F.map_from_arrays(F.array(F.lit("AF"), F.lit("AC"), F.lit("ANN")), F.array(F.format_string("%.3f", "af"), F.col("ac").cast("string"), F.col("ann")))
    quarter = F.coalesce(F.least(F.greatest(F.floor(F.col("qual") * 4), F.lit(0)), F.lit(65535)), F.lit(0)).cast("int")
    return df.withColumns({"qual_q": quarter, "info": F.map_filter(fields, lambda _, v: v.isNotNull())})


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Callset A (odd ids) and callset B (even ids)."""
    df = callset(spark, sf_dir)
    return df.where("src_index % 2 = 1"), df.where("src_index % 2 = 0")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records before normalisation: alt and filters as arrays, info as a map."""
    df = _orders(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in RAW.items()))
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in INFO_KEYS)), F.array(*(F.col(c) for c in INFO_KEYS.values())))
    return df.select(
        "src_index", "caller_idx", F.col("src_index").alias("lineno"), "chrom", "pos", "id", "ref", F.array("alt").alias("alt"), "qual",
        F.when(F.col("filter") == ".", F.array().cast("array<string>")).otherwise(F.array("filter")).alias("filters"), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("info"),
    )


_INFO_TYPES = {"SVTYPE": "String", "END": "Integer", "SVLEN": "Integer", "INSLEN": "Integer", "LEFT_SVINSSEQ": "String", "RIGHT_SVINSSEQ": "String"}


def _header(**more) -> Header:
    info = {k: Field(k, "1", t, "") for k, t in _INFO_TYPES.items()}
    return Header(info=info, filters={"PASS": "All filters passed", "LowQual": "Low quality"}, contigs={f"chr{i}": None for i in (1, 2, 3)}, **more)


def raw_file(spark: SparkSession, sf_dir: str, end: str) -> str:
    """The path of a new file of ``raw_records`` by contig, position and index, in the format of its ending."""
    path = staged_path(spark, "callset", end)
    lines = raw_records(spark, sf_dir).orderBy("chrom", "pos", "src_index").select(record_line().alias("line"))
    write_callset(lines, _header(), path)
    return path


def sample_file(spark: SparkSession, sf_dir: str, caller: int, depth_type: str) -> str:
    """The path of a new file of one caller's records of ``callset`` as sample S<caller>, with a FORMAT field DP of the given type."""
    path = staged_path(spark, "callset", ".vcf")
    df = callset(spark, sf_dir).where(F.col("caller_idx") == caller)
    mate = F.concat(F.lit("N["), F.col("chr2"), F.lit(":"), F.col("pos2").cast("string"), F.lit("["))
    own = {"SVTYPE": F.col("svtype"), "END": F.when(F.col("svtype").isin("DEL", "DUP", "INV"), F.col("end_pos").cast("string")), "SVLEN": F.when(F.col("svtype") != "BND", F.col("svlen").cast("string"))}
    fields = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k in own)), F.array(*own.values())), lambda _, v: v.isNotNull())
    df = df.select(
        "chrom", "pos", "src_index", F.concat(F.lit("r"), F.col("src_index").cast("string")).alias("id"), F.lit("N").alias("ref"), "qual", fields.alias("info"), F.array(F.lit("GT"), F.lit("DP")).alias("format"),
        F.array(F.when(F.col("svtype") == "BND", mate).otherwise(F.concat(F.lit("<"), F.col("svtype"), F.lit(">")))).alias("alt"), F.array(F.when(F.col("is_pass"), "PASS").otherwise("LowQual")).alias("filters"),
        F.array(F.concat_ws(":", "gt", (F.col("src_index") % 50).cast("string"))).alias("samples"),
    )
    lines = df.orderBy("chrom", "pos", "src_index").select(record_line("samples").alias("line"))
    write_callset(lines, _header(format={"GT": Field("GT", "1", "String", "Genotype"), "DP": Field("DP", "1", depth_type, "Depth")}, samples=[f"S{caller}"]), path)
    return path


def fresh_table(spark: SparkSession) -> str:
    return staged_path(spark, "callset", ".parquet")

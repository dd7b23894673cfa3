"""Reading callsets (VCF text, plain or compressed, BCF, and Parquet folders) into the canonical columns, and writing them.

Text is read by Spark's text source: an uncompressed file splits, a compressed one is a task. BCF files are decompressed one file a
task and decoded by all. Parquet folders are read and written by all tasks. Line numbers come from counts per split and places within it, without a sort.
"""

from __future__ import annotations

import contextlib
import io
import sys
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.functions.normalize import normalize
from lociweave.plans.runtime import broadcast_bounded, drop_staged, materialize
from lociweave.sources import bcf, files
from lociweave.sources.bgzf import BgzfWriter
from lociweave.sources.csi import CsiBuilder
from lociweave.sources.header import Header

#: Bases per bucket of ``assign_index``; the buckets of a genome are few whatever the number of records.
_BUCKET = 1 << 16
#: Name of the header's file within a ``.parquet`` folder; readers of the folder pass over it.
_HEADER = "_header.vcf"
#: Bytes of blocks, or of decompressed records, that a task hands on at once.
_PIECE = 1 << 22
#: Compressed bytes taken up at once.
_STEP = 1 << 18


def _is_bcf(path: str) -> bool:
    return path.endswith(".bcf")


def _is_table(path: str) -> bool:
    return path.endswith(".parquet")


def require_index(spark: SparkSession, path: str) -> None:
    """Raises unless the file has an index beside it."""
    if not any(files.exists(spark, path + end) for end in (".csi", ".tbi")):
        raise FileNotFoundError(f"{path} has no .csi or .tbi index")


def _bcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, part and id of each record. A file is decompressed piece by piece in one task; its pieces are decoded by all tasks."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("head", pa.binary()), ("records", pa.binary())])

    def split(batches):
        for rb in batches:
            for name, content in zip(rb.column("path").to_pylist(), rb.column("content"), strict=True):
                raw = content.as_buffer()
                runs = bcf.pieces(files.unpacked(raw[i : i + _STEP].to_pybytes() for i in range(0, len(raw), _STEP)), _PIECE)
                head = next(runs)
                for i, records in enumerate(runs):
                    yield pa.RecordBatch.from_pylist([{"file": name, "start": i, "head": head, "records": records}], schema)

    def kernel(batches):
        for rb in batches:
            for run in rb.to_pylist():
                _, names, contigs, _ = bcf.read_header(run["head"])
                part = {"file": run["file"], "start": run["start"]}
                n = 0
                for lines in batched(bcf.decode(run["records"], 0, names, contigs), 4096):
                    yield pa.RecordBatch.from_pydict({"value": pa.array(lines), "part": pa.array([part] * len(lines)), "id": pa.array(range(n, n + len(lines)), pa.int64())})
                    n += len(lines)

    runs = found.mapInArrow(split, "file string, start long, head binary, records binary").repartition("file", "start")
    return runs.mapInArrow(kernel, "value string, part struct<file:string,start:long>, id long")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, part (the split it is from; splits sort in file order) and id, which counts up by one within a part."""
    if _is_table(path):
        return spark.read.parquet(path).select("value", F.struct(F.lit(path).alias("file"), F.shiftright("place", 33).alias("start")).alias("part"), F.col("place").alias("id"))
    if _is_bcf(path):
        return _bcf_lines(spark, path)
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("part"))
    return rows.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("id", F.monotonically_increasing_id())


def _header_lines(pieces: Iterator[bytes]) -> list[str]:
    """Lines that begin with '#', read no further than the first that does not."""
    lines, rest = [], b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            if not line.startswith(b"#"):
                return lines
            lines.append(line.decode())
    return lines + ([rest.decode()] if rest.startswith(b"#") else [])


def read_header(spark: SparkSession, path: str) -> Header:
    """The header; of a single file no more than its beginning is read."""
    source = f"{path}/{_HEADER}" if _is_table(path) else path
    if files.is_file(spark, source):
        pieces = files.unpacked(files.chunks(spark, source))
        if not _is_bcf(path):
            return Header.parse(_header_lines(pieces))
        data = b""
        for piece in pieces:
            data += piece
            if bcf.has_header(data):
                break
        return bcf.read_header(data)[0]
    if _is_bcf(path):
        raise ValueError(f"not a single file: {path}")
    rows = spark.read.text(path).where(F.col("value").startswith("#")).collect()
    return Header.parse([r["value"] for r in rows])


def _numbered(lines: DataFrame) -> DataFrame:
    """Records with their 1-based number in the file: the records of the parts before, and the place within the part."""
    parts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(parts.select("part", (before - F.col("first") + 1).alias("shift")), "splits")  # one row per split
    return lines.join(broadcast_bounded(starts), "part").select("value", (F.col("id") + F.col("shift")).cast("long").alias("lineno"))


def parse_info(text: Column) -> Column:
    """INFO as a map from key to text, '' for flags; of a repeated key the first stays."""
    items = F.filter(F.split(text, ";"), lambda x: (x != "") & (x != "."))
    keys = F.transform(items, lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    values = F.transform(items, lambda x: F.when(x.contains("="), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(F.lit("")))
    entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i")), lambda e: F.array_position(keys, e["k"]) == e["i"])
    filled = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"])))
    return F.when(F.size(items) > 0, filled).otherwise(F.create_map().cast("map<string,string>"))


def show_info(info: str | Column) -> Column:
    source = F.col(info) if isinstance(info, str) else info
    shown = F.array_join(F.transform(F.map_entries(source), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    return F.when(F.size(source) > 0, shown).otherwise(F.lit("."))


def read_callset(spark: SparkSession, path: str, caller_idx: int = 0, contigs: list[str] | None = None, chr_set: tuple[str, ...] | None = None, index_needed: bool = False) -> tuple[DataFrame, Header]:
    """The normalised records of one file, skipped ones included, and its header.

    ``contigs`` gives the order of contigs (default: the header's). ``src_index`` is the record's number in the file. The records are
    parsed once and staged, since every join lane reads them.
    """
    if index_needed:
        require_index(spark, path)
    header = read_header(spark, path)
    order = list(header.contigs) if contigs is None else contigs
    f = F.split("value", "\t")
    place = F.array_position(F.array(*(F.lit(c) for c in order)).cast("array<string>"), F.get(f, F.lit(0))) - 1
    null_dot = lambda c, sep: F.when((c == ".") | (c == ""), F.array().cast("array<string>")).otherwise(F.split(c, sep))
    rows = _numbered(_lines(spark, path)).select(
        F.lit(caller_idx).alias("caller_idx"), "lineno", F.col("lineno").alias("src_index"), F.get(f, F.lit(0)).alias("chrom"), F.when(place >= 0, place).cast("int").alias("chrom_idx"), F.get(f, F.lit(1)).cast("long").alias("pos"),
        F.get(f, F.lit(2)).alias("id"), F.get(f, F.lit(3)).alias("ref"), null_dot(F.get(f, F.lit(4)), ",").alias("alt"), F.get(f, F.lit(5)).try_cast("float").alias("qual"), null_dot(F.get(f, F.lit(6)), ";").alias("filters"), parse_info(F.get(f, F.lit(7))).alias("info"),
        F.when(F.size(f) > 9, F.split(F.get(f, F.lit(8)), ":")).alias("format"), F.when(F.size(f) > 9, F.slice(f, 10, F.size(f))).alias("samples"), F.col("value").alias("raw"),
    )
    return materialize(normalize(rows, chr_set, order), "records"), header.with_standard_info()


def assign_index(records: DataFrame) -> DataFrame:
    """Replaces src_index by the rank in (chrom_idx, pos, caller_idx, lineno), by counts per stretch of genome and row numbers inside."""
    placed = records.withColumn("_b", F.floor(F.col("pos") / _BUCKET))
    counts = placed.groupBy("chrom_idx", "_b").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.orderBy("chrom_idx", "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("chrom_idx", "_b").orderBy("pos", "caller_idx", "lineno"))
    ranked = placed.withColumn("_i", inside).join(before, ["chrom_idx", "_b"])
    return ranked.withColumn("src_index", F.col("_before") + F.col("_i") - 1).drop("_b", "_i", "_before")


def show_number(x: Column) -> Column:
    """A quality as text: whole numbers without a point, missing as '.'."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("."))


def record_line(samples: str | None = None) -> Column:
    """The record's text line from its columns; ``samples`` names an array column of formatted sample fields, whose FORMAT is in ``format``."""
    base = [
        F.col("chrom"), F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), F.col("ref"), F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise("."), show_number(F.col("qual")),
        F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise("."), show_info("info"),
    ]
    line = F.concat_ws("\t", *base)
    if samples is None:
        return line
    return F.when(F.size(samples) > 0, F.concat_ws("\t", line, F.coalesce(F.array_join("format", ":"), F.lit(".")), F.array_join(samples, "\t"))).otherwise(line)


def _opened(path: str):
    return contextlib.nullcontext(sys.stdout.buffer) if path in ("", "-", "/dev/stdout") else files.created(path)


def check_output(path: str) -> None:
    if path not in ("", "-", "/dev/stdout") and not path.endswith((".vcf", ".vcf.gz", ".bcf", ".parquet")):
        raise ValueError(f"output must end in .vcf, .vcf.gz, .bcf or .parquet: {path}")


def write_lines(lines: Iterator[str], header: Header, path: str, write_index: bool = False) -> int:
    """One file out of sorted record lines; the format follows the extension. Returns the number of records."""
    count, packed, binary = 0, path.endswith((".vcf.gz", ".bcf")), path.endswith(".bcf")
    names = bcf.Dictionary(header)
    index = CsiBuilder(list(header.contigs), text=not binary) if write_index and packed else None
    with _opened(path) as f:
        out = BgzfWriter(f) if packed else f
        out.write(bcf.file_start(header) if binary else ("\n".join(header.lines()) + "\n").encode())
        for line in lines:
            before = out.tell() if index else 0
            out.write(bcf.encode(line, header, names) if binary else (line + "\n").encode())
            if index:
                chrom, pos, _, ref, _, _, _, info = line.split("\t", 8)[:8]
                end = next((int(x[4:]) for x in info.split(";") if x.startswith("END=") and x[4:].isdigit()), 0)
                index.add(names.contig[chrom], int(pos) - 1, max(end, int(pos) - 1 + len(ref)), before, out.tell())
            count += 1
        if packed:
            out.close()
    if index:
        index.write(path + ".csi")
    return count


def _write_table(df: DataFrame, header: Header, path: str) -> int:
    """The distributed form: a folder of record lines with the columns that readers prune by, written by all tasks, and the header."""
    f = F.split("value", "\t")
    place = F.monotonically_increasing_id().alias("place")  # in the order of df, by one within a task
    rows = df.select("value", place, F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos"), F.get(f, F.lit(2)).alias("id"))
    rows.write.mode("overwrite").parquet(path)
    files.put(df.sparkSession, f"{path}/{_HEADER}", ("\n".join(header.lines()) + "\n").encode())
    return df.sparkSession.read.parquet(path).count()


def _write_packed(lines: DataFrame, header: Header, path: str) -> int:
    """One compressed file whose blocks all tasks encode and compress; the driver strings them together in the order of ``lines``."""
    binary = path.endswith(".bcf")

    def kernel(batches):
        names, held = bcf.Dictionary(header), io.BytesIO()
        out, n = BgzfWriter(held), 0

        def piece():
            return pa.RecordBatch.from_pydict({"blocks": pa.array([held.getvalue()], pa.binary()), "n": pa.array([n], pa.int64())})

        for rb in batches:
            for line in rb.column(0).to_pylist():
                out.write(bcf.encode(line, header, names) if binary else (line + "\n").encode())
                n += 1
                if held.tell() > _PIECE:
                    yield piece()
                    held.seek(0)
                    held.truncate()
                    n = 0
        out.flush()
        if held.tell():
            yield piece()

    packed = materialize(lines.mapInArrow(kernel, "blocks binary, n long").withColumn("place", F.monotonically_increasing_id()), "packed")
    count = 0
    with _opened(path) as f:
        start = BgzfWriter(f)
        start.write(bcf.file_start(header) if binary else ("\n".join(header.lines()) + "\n").encode())
        start.flush()
        for row in packed.orderBy("place").toLocalIterator():
            f.write(bytes(row["blocks"]))
            count += row["n"]
        start.close()
    drop_staged(packed)
    return count


def write_callset(df: DataFrame, header: Header, path: str, line: str = "line", write_index: bool = False) -> int:
    """Writes the text column ``line`` in the order of ``df``: a ``.parquet`` folder, or one file. Its blocks are compressed by all
    tasks unless it is plain text or an index is asked for, which the driver builds while it writes."""
    if _is_table(path):
        return _write_table(df.select(F.col(line).alias("value")), header, path)
    if path.endswith((".vcf.gz", ".bcf")) and not write_index:
        return _write_packed(df.select(line), header, path)
    return write_lines((r[line] for r in df.select(line).toLocalIterator()), header, path, write_index)

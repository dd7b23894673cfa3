"""Where intermediate tables live, and how they are written, reread and dropped.

Every cut of lineage in this library is a Parquet table in the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a re-read and never a recomputation from lost blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that ``broadcast_bounded`` sends to every executor (narrow rows: at most about 64 MB).
BROADCAST_ROWS = 1_000_000
#: Paths staged by each application of this process.
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, where nothing is set."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"file://{tempfile.gettempdir()}/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def staged_path(spark: SparkSession, name: str, end: str = "") -> str:
    """A new path in the shared folder, which ``drop_all_staged`` will delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}{end}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once and return it as read back: lineage is cut, types stay, any later loss rereads the files."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a table made by ``materialize`` once nothing reads them any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_all_staged(spark: SparkSession) -> int:
    """Delete all that this application staged; for the end of a job, when no result of it is read any more. Returns their number."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exchanged(df: DataFrame) -> DataFrame:
    """Hint that a join with ``df`` exchanges both sides; for tables that grow with the records.

    Spark would broadcast a staged table by the bytes of its files, and numbers that compress well take many times that in the driver.
    """
    return df.hint("shuffle_merge")


def broadcast_bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted size is within ``limit``; beyond it the plain shuffled join stands."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df

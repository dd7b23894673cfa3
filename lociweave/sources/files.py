"""Single files through Hadoop's FileSystem, so that any path that Spark reads can be looked into, and written, by the driver."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

_STEP = 1 << 16


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return bool(fs.exists(target))


def is_file(spark: SparkSession, path: str) -> bool:
    """True for one plain file; a folder or a pattern is none."""
    fs, target = _located(spark, path)
    return bool(fs.exists(target)) and not fs.getFileStatus(target).isDirectory()


def chunks(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The file's bytes piece by piece; a reader that has enough stops asking."""
    fs, target = _located(spark, path)
    stream = fs.open(target)
    try:
        while data := bytes(stream.readNBytes(_STEP)):
            yield data
    finally:
        stream.close()


def unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members, decompressed; others as they are. Raises if the last member is cut off."""
    member = None
    for i, data in enumerate(pieces):
        if i == 0 and data[:2] != b"\x1f\x8b":
            yield data
            yield from pieces
            return
        while data:
            member = member or zlib.decompressobj(31)
            yield member.decompress(data)
            data, member = (member.unused_data.lstrip(b"\0"), None) if member.eof else (b"", member)
    if member:
        raise EOFError("the file ends within a compressed block")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written where Spark itself would write it."""
    fs, target = _located(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(data))
    stream.close()


class _Sink:
    def __init__(self, stream) -> None:
        self.stream = stream

    def write(self, data: bytes) -> None:
        self.stream.write(bytearray(data))


@contextlib.contextmanager
def created(path: str):
    """A binary file to write: a local one, or one of any file system that the active session knows."""
    if "://" not in path or path.startswith("file://"):
        with open(path.removeprefix("file://"), "wb") as f:
            yield f
        return
    fs, target = _located(SparkSession.getActiveSession(), path)
    stream = fs.create(target, True)
    try:
        yield _Sink(stream)
    finally:
        stream.close()

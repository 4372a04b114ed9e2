"""Files on whatever storage a path names: the driver goes through Spark's file systems, a task through Arrow's."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text; a byte order mark is left out."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8-sig")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str) -> str | None:
    """A file's first line, None for an empty file."""
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0].lstrip("﻿") if rows else None


def write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Writes a file beside its place and then moves it there, so that nobody sees half of it."""
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"{path} can't be put in place")


def _arrow(path: str):
    from pyarrow import fs as arrow

    return arrow.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (arrow.LocalFileSystem(), os.path.abspath(path))


def listed(path: str) -> list[str]:
    """The files that a path names, sorted: itself, those with .json of a folder, or those that fit a pattern in its last part."""
    from fnmatch import fnmatch

    from pyarrow import fs as arrow

    head, last = path.rsplit("/", 1) if "/" in path else (".", path)
    store, at = _arrow(path if not any(c in last for c in "*?[") else head)
    prefix = path[: path.index("://") + 3] if path.startswith(("s3://", "gs://")) else "hdfs://" + path[7:].split("/", 1)[0] if path.startswith("hdfs://") else ""
    if any(c in last for c in "*?["):
        found = [i.path for i in store.get_file_info(arrow.FileSelector(at, allow_not_found=True)) if i.is_file and fnmatch(i.base_name, last)]
    else:
        info = store.get_file_info(at)
        if info.type == arrow.FileType.Directory:
            found = [i.path for i in store.get_file_info(arrow.FileSelector(at)) if i.is_file and i.base_name.endswith(".json")]
        else:
            found = [at] if info.is_file else []
    return sorted(prefix + f for f in found)


def chunks(path: str, size: int = 1 << 22) -> Iterator[str]:
    """A file's text in pieces of bounded size; bytes that are no text are replaced."""
    import codecs

    store, at = _arrow(path)
    decode = codecs.getincrementaldecoder("utf-8-sig")(errors="replace").decode
    with store.open_input_stream(at) as f:
        while part := f.read(size):
            yield decode(part)
    yield decode(b"", True)

"""Objects that are written once: exclusive creation with a comparison of bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class ImmutableConflict(RuntimeError):
    """An object is there with other bytes. Nothing was written."""


def _system(spark: SparkSession, path: str):
    """The file system of a path, and a maker of paths."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def get(spark: SparkSession, path: str) -> bytes | None:
    """An object's bytes; None if there is none."""
    fs, Path = _system(spark, path)
    try:
        stream = fs.open(Path(path))
    except Exception as e:
        if "FileNotFoundException" in str(e) or "NoSuchFile" in str(e):
            return None
        raise
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, content: bytes, same: Callable[[bytes], bool] | None = None) -> str:
    """created, or reused if the object is there with the same bytes (or with such that `same` takes); else ImmutableConflict.

    The bytes are written beside it and take the name by one step that fails where the name is taken: a
    hard link on a local disk, a rename elsewhere (which must not replace files, as on HDFS). So of any number of
    writers one creates the object, and no reader sees a part of it.
    """
    fs, Path = _system(spark, path)
    whole = fs.makeQualified(Path(path))
    beside = Path(whole.getParent(), f".{whole.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    try:
        created = _named(spark, fs, beside, whole)
    finally:
        fs.delete(beside, False)
    if created:
        return "created"
    held = get(spark, path)
    if held is None or not (same(held) if same else held == content):
        raise ImmutableConflict(f"{path} has other bytes")
    return "reused"


def _named(spark: SparkSession, fs, beside, whole) -> bool:
    """Whether the file beside got the name."""
    if whole.toUri().getScheme() != "file":
        return not fs.exists(whole) and fs.rename(beside, whole)
    files, of = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Path.of
    try:
        files.createLink(of(whole.toUri()), of(beside.toUri()))
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True

"""Folders in whatever store Spark reaches: looked into and moved through its own file systems."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _at(spark, folder)
    return files.exists(path)


def children(spark: SparkSession, folder: str) -> dict[str, tuple[bool, int]]:
    """name -> (is a folder, bytes), without what Spark's writers hide (names that begin with _ or .)."""
    files, path = _at(spark, folder)
    found = {s.getPath().getName(): (s.isDirectory(), int(s.getLen())) for s in files.listStatus(path)} if files.exists(path) else {}
    return {n: x for n, x in found.items() if n[0] not in "_."}


def literal(path: str) -> str:
    """A path none of whose characters is taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def delete(spark: SparkSession, folder: str) -> None:
    files, path = _at(spark, folder)
    files.delete(path, True)


def swap(spark: SparkSession, folder: str, new: str) -> None:
    """Put ``new`` in the place of ``folder`` by two renames. ``recover`` mends what a crash between them leaves."""
    files, path = _at(spark, folder)
    old = f"{_parent(folder)}/.old-{_name(folder)}"
    delete(spark, old)
    if not files.rename(path, _at(spark, old)[1]) or not files.rename(_at(spark, new)[1], path):
        raise OSError(f"{folder} could not be replaced")
    delete(spark, old)


def recover(spark: SparkSession, folder: str) -> None:
    """Bring back what ``swap`` had moved away when it was cut off, and drop what it had no more use for."""
    files, path = _at(spark, folder)
    old = f"{_parent(folder)}/.old-{_name(folder)}"
    if exists(spark, old):
        if files.exists(path):
            delete(spark, old)
        elif not files.rename(_at(spark, old)[1], path):
            raise OSError(f"{folder} could not be brought back")


def beside(folder: str) -> str:
    """A new hidden folder next to ``folder``, on the same store, so that it can be renamed into its place."""
    return f"{_parent(folder)}/.new-{_name(folder)}-{uuid.uuid4().hex}"


def _parent(folder: str) -> str:
    return folder.rstrip("/").rpartition("/")[0]


def _name(folder: str) -> str:
    return folder.rstrip("/").rpartition("/")[2]

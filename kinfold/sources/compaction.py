"""Rewriting of folders that hold many small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .folders import beside, children, literal, recover, swap

TARGET_BYTES = 128 << 20


def plan(spark: SparkSession, folder: str, target: int = TARGET_BYTES) -> int:
    """Files that the folder's own files would fill at ``target`` bytes each; 0 where they are no more than that."""
    sizes = [size for is_folder, size in children(spark, folder).values() if not is_folder]
    wanted = max(1, -(-sum(sizes) // target))
    return wanted if len(sizes) > wanted else 0


def compact(spark: SparkSession, root: str, schema: StructType, form: str = "json", target: int = TARGET_BYTES) -> dict[str, tuple[int, int]]:
    """Rewrite each folder below ``root`` (and ``root`` itself) that has more files than its bytes fill, and return
    folder -> (files before, files after). The new files are written beside the old and swapped in by renames, so
    readers find one or the other; a run that was cut off is mended by the next, and a second run finds nothing to do.
    Rows keep their text. Lines that don't parse are kept as they are."""
    recover(spark, root)
    done: dict[str, tuple[int, int]] = {}
    hidden = [n for n in _all(spark, root) if n.startswith(".old-")]
    for name in hidden:
        recover(spark, f"{root}/{name.removeprefix('.old-')}")
    for name, (is_folder, _) in sorted(children(spark, root).items()):
        if is_folder:
            done |= _one(spark, f"{root}/{name}", schema, form, target)
    return done | (_one(spark, root, schema, form, target) if not any(x for x, _ in children(spark, root).values()) else {})


def _one(spark: SparkSession, folder: str, schema: StructType, form: str, target: int) -> dict[str, tuple[int, int]]:
    wanted = plan(spark, folder, target)
    if not wanted:
        return {}
    before, new = len(children(spark, folder)), beside(folder)
    rows = _read(spark, folder, schema, form).coalesce(wanted)
    rows.write.text(new) if form == "json" else rows.write.parquet(new)
    swap(spark, folder, new)
    return {folder: (before, len(children(spark, folder)))}


def _read(spark: SparkSession, folder: str, schema: StructType, form: str) -> DataFrame:
    """JSON lines are moved as text, which keeps every one of them as it is."""
    path = literal(folder)
    return spark.read.text(path).select("value") if form == "json" else spark.read.schema(schema).parquet(path)


def _all(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

"""Tables between the steps of a job, in the folder that the executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders handed out within the innermost ``stages`` block of this thread.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)
_lock, _writers = threading.Lock(), {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session has none, a temporary one in local mode; on a
    cluster that is an error, since executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of each query that ends meanwhile, rather than when the driver happens to
    collect its garbage. Blocks of one session may overlap: the last to end puts the setting back."""
    name = id(spark._jsparkSession)
    with _lock:
        count, old = _writers.get(name, (0, spark.conf.get(_CLEANUP, "false")))
        _writers[name] = (count + 1, old)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, old = _writers[name]
            _writers[name] = (count - 1, old)
            if count == 1:
                del _writers[name]
                spark.conf.set(_CLEANUP, old)


@contextmanager
def stages(spark: SparkSession) -> Iterator[list[str]]:
    """Owns what is staged inside the block, by this thread, and deletes it at its end: results must have been written by then.
    What other callers stage is theirs."""
    held: list[str] = []
    token = _held.set(held)
    try:
        yield held
    finally:
        _held.reset(token)
        for folder in held:
            _delete(spark, folder)


def stage_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. It belongs to the ``stages`` block around, or else to the caller."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (held := _held.get()) is not None:
        held.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that what follows neither computes
    it again nor depends on its executors. ``unstage`` deletes the files, and so does the end of a ``stages`` block."""
    spark = df.sparkSession
    path = stage_folder(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            _delete(df.sparkSession, folder)


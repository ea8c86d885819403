"""Sinks. Ordered files are ranged and sorted within partitions, never brought into one."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """Quoted CSV that reads back as written; ``order_by`` orders the rows across the files."""
    if order_by:
        df = df.repartitionByRange(order_by).sortWithinPartitions(order_by)
    df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_results(df: DataFrame, root: str) -> None:
    """A directory per profile; only the profiles present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("profile").json(root)


def write_scores(df: DataFrame, path: str, form: str = "csv") -> None:
    write_csv(df, path) if form == "csv" else write_stage(df, path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table of the session's catalog, bucketed and sorted by ``key``. Tables with the same key and number of buckets
    are joined on it without an exchange; anything else joins them as it would other tables. One file a bucket."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)

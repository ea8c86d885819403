"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import shared_dir, shuffles_freed, staged as stage, unstage  # noqa: F401

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(names: list[str], wish: str) -> str:
    """A column name like ``wish`` that none of ``names`` is, whatever its case."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def id_fold(column: str, folds: int):
    """crc32(doc_id as text) mod ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds


def word_count(text):
    """Number of words of a text; 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACE_RE}+"))).cast("long")

"""What the operators on vectors share: usable rows, one for each id, and blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def one_per_id(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each non-null ``key``: of repeated rows the smallest by ``columns``. Map-side minima come
    first, so a key that many rows share does not meet in one task."""
    least = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_row"))
    return least.select(key, *(F.col("_row")[c].alias(c) for c in columns))


def n_blocks(df: DataFrame, rows: int, least: int, most: int) -> int:
    """Blocks that ``rows`` are dealt to: one for each core at least, of ``least`` to ``most`` rows. Results
    don't depend on it."""
    size = min(most, max(least, -(-rows // df.sparkSession.sparkContext.defaultParallelism)))
    return max(1, -(-rows // size))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def matrix(vectors: pd.Series, kind: type, dims: int) -> np.ndarray:
    """Vectors as the rows of a matrix; components that shorter ones lack are 0."""
    out = np.zeros((len(vectors), dims), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out

"""Checks that ride along with the pass that writes a table, instead of a job of their own."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, functions as F


def guarded(skel: DataFrame, join: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataFrame], key: str, measures: list[Column] = ()) -> tuple[DataFrame, dict[str, int]]:
    """``write(join(skel))``, which must keep every row of ``skel`` once, and what was measured on it.

    Rows are counted before and after the joins while they are written. Where the counts differ, the written
    table is looked through for keys that repeat: a right side that repeats a key fails the job and is named
    by its keys. (Only then: a stage that ran again after a lost executor may count rows twice.)"""
    before, after = Observation(), Observation()
    written = write(join(skel.observe(before, F.count(F.lit(1)).alias("rows"))).observe(after, F.count(F.lit(1)).alias("rows"), *measures))
    seen = _measured(after, written, measures)
    if _measured(before, written, ())["rows"] != seen["rows"]:
        repeated = [r[key] for r in written.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(3).collect()]
        if repeated:
            raise ValueError(f"rows of one {key} were multiplied by the joins: {repeated}")
    return written, seen


def _measured(observation: Observation, written: DataFrame, measures: list[Column]) -> dict[str, int]:
    """What was observed; counted on the written table where the optimizer had proved the input empty, so that nothing was."""
    try:
        return dict(observation.get)
    except Py4JJavaError:
        return written.agg(F.count(F.lit(1)).alias("rows"), *measures).first().asDict()

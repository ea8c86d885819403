"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage, unstage


def _pull(edges: DataFrame, both: bool) -> DataFrame:
    """One star step: every node's neighbours (``both``: all, those above it linked on; else those
    below it) are linked to the smallest of them and the node."""
    if both:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if both:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (its component's smallest node) for the nodes of the links ``u``, ``v`` (long) but
    the roots. Large-star and small-star steps alternate until the links stop changing; each round
    is written to the shared folder, and no link reaches the driver."""
    now = stage(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        if seen[0] == 0:
            break
        new = stage(_pull(_pull(now, True), False), "links")
        unstage(now)
        now = new
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Weighted draws with replacement, reproducible whatever the partitioning.

Weights are scaled to integers, so sums don't depend on order. Persons stand in the order of a hash of
their key (equal hashes by key); draw k is the point floor(u_k * total) with u_k from md5 of seed and k.
The order is cut into buckets, as many as the persons need, which changes nothing in it. A draw finds its
bucket by an equi-join on bins of the total, and its person by a running order of points and cumulative
weights inside the bucket. Only buckets that a draw touches are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import PERSON_KEY, WEIGHT

SEED = 20260602
DRAWS = 500
SCALE = 1_000_000
#: Draws that are sent to every executor rather than having the persons' table shuffled: two values each.
BROADCAST_DRAWS = 100_000
#: Persons of a bucket, about.
PER_BUCKET = 100_000


def scaled(weight: str) -> Column:
    return F.round(F.col(weight) * SCALE).cast("long")


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)").cast("long")


def place(key: str) -> Column:
    """Where a key stands, from 0 to 2^32 - 1."""
    return _number(F.md5(F.col(key).cast("string")), 8)


def with_probability(df: DataFrame, weight: str = WEIGHT) -> DataFrame:
    """``df`` with ``p``, the weight's share of the total."""
    total = df.agg(F.sum(scaled(weight)).alias("_total"))  # one row
    return df.join(F.broadcast(total)).withColumn("p", scaled(weight) / F.col("_total")).drop("_total")


def draw_keys(df: DataFrame, weight: str = WEIGHT, n: int = DRAWS, seed: int = SEED, buckets: int | None = None, key: str = PERSON_KEY) -> DataFrame:
    """sample_pick_order (1 to n) and the key of the person drawn. Weights of zero, below, or missing are never drawn."""
    spark = df.sparkSession
    people = df.select(key, scaled(weight).alias("_w")).filter("_w > 0").withColumn("_place", place(key))
    buckets = buckets or max(1, -(-people.count() // PER_BUCKET))
    people = people.withColumn("_bucket", F.shiftright(F.col("_place") * buckets, 32))
    sums = people.groupBy("_bucket").agg(F.sum("_w").alias("_sum"))
    total = int(sums.agg(F.sum("_sum")).first()[0] or 0)
    draws = spark.range(1, n + 1).select(F.col("id").cast("int").alias("sample_pick_order"))
    if not total:
        return draws.limit(0).withColumn(key, F.lit(None).cast("string"))
    draws = draws.withColumn("_t", F.expr(f"cast((cast({_number_sql(seed)} AS decimal(18,0)) * cast({total} AS decimal(19,0))) div {1 << 52} AS long)"))

    # A bucket's interval covers bins of the total; there are at most two bins per bucket and bucket.
    span = max(1, -(-total // buckets))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as buckets
    sums = sums.withColumn("_lo", before).withColumn("_hi", F.col("_lo") + F.col("_sum"))
    bins = sums.withColumn("_bin", F.explode(F.expr(f"sequence(_lo div {span}, (_hi - 1) div {span})")))
    draws = draws.withColumn("_bin", F.expr(f"_t div {span}")).join(bins, "_bin").filter("_t >= _lo AND _t < _hi")
    draws = draws.select("sample_pick_order", "_bucket", (F.col("_t") - F.col("_lo")).alias("_at"))

    touched = people.join(draws.select("_bucket").distinct(), "_bucket", "left_semi")
    inside = Window.partitionBy("_bucket").orderBy("_place", key).rowsBetween(Window.unboundedPreceding, -1)
    begins = touched.select("_bucket", F.coalesce(F.sum("_w").over(inside), F.lit(0)).alias("_at"), F.lit(0).alias("_kind"), F.col(key), F.lit(None).cast("int").alias("sample_pick_order"))
    points = draws.select("_bucket", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(df.schema[key].dataType).alias(key), "sample_pick_order")
    order = Window.partitionBy("_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = begins.unionByName(points).withColumn(key, F.last(key, ignorenulls=True).over(order))
    return both.filter("_kind = 1").select("sample_pick_order", key)


def _number_sql(seed: int) -> str:
    return f"conv(substring(md5(concat('{seed}:', cast(sample_pick_order AS string))), 1, 13), 16, 10)"


def weighted_sample(df: DataFrame, weight: str = WEIGHT, n: int = DRAWS, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """``n`` rows of ``df`` drawn with replacement in proportion to the weight, numbered by sample_pick_order. Few draws
    go to the persons; the wide table is shuffled for many only."""
    draws = draw_keys(df, weight, n, seed, buckets)
    return (F.broadcast(draws) if n <= BROADCAST_DRAWS else draws).join(df, PERSON_KEY).select("sample_pick_order", *df.columns)

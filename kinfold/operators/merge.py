"""Selection of survey columns, joins into the person-level wide table, and its filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import HOUSEHOLD_KEY, PERSON_KEY, WEIGHT


def select_profile_columns(df: DataFrame, catalog: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """The columns that the catalog lists for ``table``, in its order, after the merge keys. A listed
    column that the table lacks is an error. The catalog is small and read on the driver."""
    listed = [r["field"] for r in catalog.filter(F.col("table") == table).select("field").collect()]
    lacking = [c for c in listed if c not in df.columns]
    if lacking:
        raise ValueError(f"{table} has no columns {lacking}")
    return df.select(*keys, *(c for c in dict.fromkeys(listed) if c not in keys))


def skeleton(df: DataFrame) -> DataFrame:
    """Persons of the cross-section who are alive."""
    return df.filter((F.col("crosssection") == 1) & (F.col("died") == 0))


def merge_person(skel: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left joins on the person key. One key throughout, so the skeleton is shuffled once, and not at all where
    the tables are bucketed by it. Columns that a right side shares with what is joined so far (but the key) are
    left out. A right side that repeats a key multiplies persons: ``guards.guarded`` tells."""
    out = skel
    for t in tables:
        out = out.join(t.select(PERSON_KEY, *(c for c in t.columns if c not in out.columns)), PERSON_KEY, "left")
    return out


def merge_household(df: DataFrame, family: DataFrame) -> DataFrame:
    """Left join of one row per household. Persons without a household key match nothing and would all
    meet in one task, so each joins by a key of their own."""
    family = family.select(HOUSEHOLD_KEY, *(c for c in family.columns if c not in df.columns)).filter(F.col(HOUSEHOLD_KEY).isNotNull())
    own = F.concat(F.lit("\0"), F.col(PERSON_KEY).cast("string"))
    left = df.withColumn("_household", F.coalesce(F.col(HOUSEHOLD_KEY).cast("string"), own))
    right = family.withColumn("_household", F.col(HOUSEHOLD_KEY).cast("string")).drop(HOUSEHOLD_KEY)
    return left.join(right, "_household", "left").drop("_household")


def analysis_sample(df: DataFrame, weight: str = WEIGHT) -> DataFrame:
    """The skeleton's conditions, a positive weight, and no proxy answers; a missing proxy flag is no proxy."""
    w = F.nullif(F.col(weight).cast("double"), F.lit(float("nan")))
    own = ~F.col("proxy_2").eqNullSafe(1) & ~F.col("proxy_5").eqNullSafe(1)
    return skeleton(df).filter(w.isNotNull() & (w > 0) & own)


def age_filter(df: DataFrame, min_age: int = 45) -> DataFrame:
    return df.filter(F.col("xrage") >= min_age)


def first_children(df: DataFrame, n: int = 2) -> DataFrame:
    """household_id, children: the first ``n`` children (by child_no) of each household as an array."""
    rank = F.row_number().over(Window.partitionBy(HOUSEHOLD_KEY).orderBy("child_no"))
    rows = df.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return rows.groupBy(HOUSEHOLD_KEY).agg(F.array_sort(F.collect_list(F.struct("child_no", "contact"))).alias("children"))

"""Dependent generation steps over persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import PERSON_KEY, STEPS
from ..sources.staging import staged
from .ledger import Generator, Ledger, call_key


def unique_ids(df: DataFrame) -> DataFrame:
    """The earliest draw of each person, with ``pick_count``, the number of its draws."""
    person = Window.partitionBy(PERSON_KEY)
    rank = F.row_number().over(person.orderBy("sample_pick_order"))
    return df.withColumn("pick_count", F.count(F.lit(1)).over(person)).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def step_inputs(facts: DataFrame, step: str) -> DataFrame:
    """``facts`` with ``payload``: the step's groups, then the upstream texts it reads, a line each;
    what is missing is left out. The texts are carried along as columns, so nothing is joined."""
    groups, upstream = STEPS[step]
    lines = [F.concat(F.lit(f"[{c}] "), F.col(c)) for c in (*groups, *upstream)]
    return facts.withColumn("payload", F.concat_ws("\n", *lines))


def run_steps(facts: DataFrame, generators: dict[str, Generator], ledger: Ledger, attempts: int = 1, per_task: int = 1_000, batch: int = 32, timeout: float | None = None, version: str = "") -> tuple[DataFrame, DataFrame]:
    """Personas and errors. Each generator gets the ids and payloads of a batch and returns ``text`` and ``error``;
    rows with an error leave the chain for the error table (id, step, error). Every answer goes through the ledger:
    a run with the same ledger makes only the calls that have no answer yet and fewer than ``attempts`` attempts.
    A new ``version`` of the generators asks all of them anew. Rows are written between the steps; ``facts`` is read
    three times, so stage what is dear."""
    tasks = max(1, -(-facts.count() // per_task))
    rows, errors = facts, None
    for step in STEPS:
        asked = step_inputs(rows, step).withColumn("key", call_key("payload", step, version))
        ledger.ask(asked, step, generators[step], attempts, tasks, batch, timeout)
        outcome = ledger.outcomes(step).select(PERSON_KEY, "key", "answered", F.col("text").alias(step), "error")
        met = staged(asked.drop("payload").join(outcome, [PERSON_KEY, "key"]).drop("key"), step)
        failed = met.filter(~F.col("answered")).select(PERSON_KEY, F.lit(step).alias("step"), "error")
        errors = failed if errors is None else errors.unionByName(failed)
        rows = met.filter("answered").drop("answered", "error")
    return rows.select(PERSON_KEY, *STEPS), errors


def missing_ids(facts: DataFrame, personas: DataFrame) -> DataFrame:
    """Sampled persons without a persona."""
    return facts.select(PERSON_KEY).distinct().join(personas.select(PERSON_KEY), PERSON_KEY, "left_anti")


def slice_users(df: DataFrame, start: int, limit: int, order: str = "sample_pick_order") -> DataFrame:
    """At most ``limit`` rows from the ``start``-th (0-based) in the order on; equal rows of the order by a hash of the
    row, rows without an order left out. Only the order's column is ranged and counted, part by part; the sums of
    the parts before tell which parts hold the slice, and their bounds filter the rows. Nothing is sorted whole."""
    ordered = df.filter(F.col(order).isNotNull())
    ranged = ordered.select(F.col(order).alias("at")).repartitionByRange("at").withColumn("part", F.spark_partition_id())
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect()  # a row for each partition
    before, kept = 0, []
    for p in sorted(parts, key=lambda p: p["part"]):
        if before < start + limit and before + p["n"] > start:
            kept.append((before, p["low"], p["high"]))
        before += p["n"]
    if not kept:
        return df.limit(0)
    inside = ordered.filter(F.col(order).between(kept[0][1], kept[-1][2]))
    begins = F.array(*(F.lit(low) for _, low, _ in kept))
    part = F.size(F.filter(begins, lambda low: low <= F.col(order)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order, "_tie")) - 1 + F.element_at(F.array(*(F.lit(n) for n, _, _ in kept)), F.col("_part"))
    ranked = inside.withColumn("_part", part).withColumn("_tie", F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).withColumn("_rank", rank)
    return ranked.filter((F.col("_rank") >= start) & (F.col("_rank") < start + limit)).select(*(F.col(f"`{c}`") for c in df.columns))


def slice_dense(df: DataFrame, start: int, limit: int, order: str = "sample_pick_order") -> DataFrame:
    """The same where the order is 1, 2, 3, ...: a range filter, without a sort."""
    return df.filter((F.col(order) > start) & (F.col(order) <= start + limit))

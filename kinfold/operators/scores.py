"""Scores of runs: extraction, combination, means and the summary of all profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RUN = ["profile", "run_id"]


def score_entries(results: DataFrame, sides: list[str], column: str = "result") -> DataFrame:
    """profile, run_id, side, dimension, score, reason, raw: every score of nested JSON results, whatever its dimensions are
    called, and everything that is none, with the reason why (null for scores).

    A result is an object of ``sides`` (who scored), each with an object ``scores``. One pass serves both: the rows
    without a reason are the scores, the others the quarantine. A side that a result lacks, as the evaluator's in
    manual runs, is no error; a result without any score is."""
    schema = ", ".join(f"`{s}` STRUCT<scores: MAP<STRING, STRING>>" for s in sides) + ", _corrupt STRING"
    parsed = results.withColumn("_r", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    given = F.filter(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"_r.`{s}`.scores").alias("scores")) for s in sides)), lambda x: F.size(x["scores"]) > 0)
    broken = F.when(F.col(column).isNull(), "no result").when(F.col("_r._corrupt").isNotNull() | F.col("_r").isNull(), "not JSON").when(F.size(given) == 0, "no scores")
    sided = parsed.select(*RUN, F.col(column).alias("raw"), broken.alias("reason"), F.explode_outer(F.when(broken.isNull(), given)).alias("_side"))
    each = sided.select(*RUN, "raw", "reason", F.col("_side.side").alias("side"), F.explode_outer("_side.scores").alias("dimension", "_value"))
    score = F.expr("try_cast(_value AS double)")
    each = each.withColumn("score", F.when(~F.isnan(score), score))
    reason = F.coalesce("reason", F.when(F.col("score").isNull(), "not a number"))
    return each.select(*RUN, "side", "dimension", "score", reason.alias("reason"), F.when(reason.isNotNull(), F.coalesce("_value", "raw")).alias("raw"))


def extract_scores(results: DataFrame, paths: dict[str, str], column: str = "result") -> DataFrame:
    """profile, run_id, dimension, score (long) from JSON results. What is absent or no number is null."""
    wide = results.select(*RUN, *(F.expr(f"try_cast(get_json_object(`{column}`, '{p}') AS double)").alias(d) for d, p in paths.items()))
    return long_scores(wide, list(paths))


def long_scores(wide: DataFrame, dimensions: list[str]) -> DataFrame:
    wide = wide.select(*RUN, *(F.col(d).cast("double").alias(d) for d in dimensions))
    return wide.unpivot(RUN, dimensions, "dimension", "score")


def combine_scores(user: DataFrame, evaluator: DataFrame) -> DataFrame:
    """The user-side scores of each run with the evaluator's, null where the evaluator gave none."""
    return user.join(evaluator, RUN, "left")


def mean_scores(scores: DataFrame) -> DataFrame:
    """profile, dimension, mean_score, n, n_missing."""
    return scores.groupBy("profile", "dimension").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("score").alias("n"), F.count_if(F.col("score").isNull()).alias("n_missing"))


def score_summary(scores: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per profile, one column of means per dimension."""
    return scores.groupBy("profile").agg(*(F.round(F.avg(F.when(F.col("dimension") == d, F.col("score"))), 6).alias(d) for d in dimensions))

"""Dialogue turns: rounds, transcripts and the state of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RUN = ["profile", "run_id"]


def rounds(turns: DataFrame) -> DataFrame:
    """profile, run_id, round_no, user_text, reply_text: each user message with the reply that follows it;
    null where none does."""
    run = Window.partitionBy(*RUN)
    talk = turns.filter(F.col("role").isin("user", "assistant"))
    talk = talk.withColumn("_next", F.lead(F.struct("role", "text")).over(run.orderBy("turn")))
    talk = talk.filter("role = 'user'").withColumn("round_no", F.row_number().over(run.orderBy("turn")))
    reply = F.when(F.col("_next.role") == "assistant", F.col("_next.text"))
    return talk.select(*RUN, "round_no", F.col("text").alias("user_text"), reply.alias("reply_text"))


def cap_rounds(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("round_no") <= n)


def transcripts(turns: DataFrame) -> DataFrame:
    """profile, run_id, n_turns, transcript: a run's turns in order, a line each. A run is bounded by its rounds."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit(""))))
    grouped = turns.groupBy(*RUN).agg(listed.alias("_turns"))
    return grouped.select(*RUN, F.size("_turns").cast("long").alias("n_turns"), F.array_join(lines, "\n").alias("transcript"))


def run_status(paired: DataFrame, n: int) -> DataFrame:
    """profile, run_id, n_rounds, n_answered, complete: whether a run has ``n`` answered rounds."""
    out = paired.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_rounds"), F.count("reply_text").alias("n_answered"))
    return out.withColumn("complete", F.col("n_answered") >= n)


def requested_status(paired: DataFrame, requested: DataFrame) -> DataFrame:
    """profile, run_id, rounds, n_rounds, n_answered, state of every run that was asked for (profile, run_id, rounds) or that
    left turns: complete, incomplete, unanswered (no round was answered), not run (no user message), not requested."""
    seen = paired.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_rounds"), F.count("reply_text").alias("n_answered"))
    out = requested.select(*RUN, "rounds").join(seen, RUN, "full_outer").fillna(0, ["n_rounds", "n_answered"])
    state = F.when(F.col("rounds").isNull(), "not requested").when(F.col("n_rounds") == 0, "not run").when(F.col("n_answered") == 0, "unanswered")
    return out.withColumn("state", state.when(F.col("n_answered") >= F.col("rounds"), "complete").otherwise("incomplete"))

"""A ledger of generation steps: every attempt of every call, so that none is made twice.

A call is known by person, step and key, the hash of what it was asked (and of the generator's version).
What is answered already is skipped by a join; what failed is asked again until it has had its attempts.
Attempts are appended as they come. Each task's answers are published when the task ends, not when the
job does, so a job that dies loses the answers of its running tasks only, ``per_task`` rows each.

An exception, a timeout or a wrong number of answers does not fail the job: the batch is asked again in
halves until the row that raises stands alone, and that row's attempt is recorded with the error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from threading import Thread

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..schema import PERSON_KEY
from ..sources.folders import exists

Generator = Callable[[pd.Series, pd.Series], pd.DataFrame]

ATTEMPTS = StructType([StructField(PERSON_KEY, StringType()), StructField("key", StringType()), StructField("attempt", IntegerType()), StructField("text", StringType()), StructField("error", StringType())])
#: The older committer publishes a task's files when it commits, and a job that is aborted leaves them in place.
_PUBLISH_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


@dataclass(frozen=True)
class Ledger:
    """Attempts below ``path``, a folder per step. One run at a time may write to it."""

    spark: SparkSession
    path: str

    def _folder(self, step: str) -> str:
        return f"{self.path}/step={step}"

    def attempts(self, step: str) -> DataFrame:
        """id, key, attempt, text, error: all that was recorded."""
        folder = self._folder(step)
        return self.spark.read.schema(ATTEMPTS).parquet(folder) if exists(self.spark, folder) else self.spark.createDataFrame([], ATTEMPTS)

    def outcomes(self, step: str) -> DataFrame:
        """One row per call: id, key, attempts, answered, text (of the first attempt that gave one) and error (the last)."""
        first = F.min(F.when(F.col("error").isNull(), F.struct("attempt", "text")))
        seen = self.attempts(step).groupBy(PERSON_KEY, "key").agg(F.max("attempt").alias("attempts"), first.alias("_first"), F.max_by("error", F.struct("attempt", "error")).alias("_error"))
        answered = F.col("_first").isNotNull()
        return seen.select(PERSON_KEY, "key", "attempts", answered.alias("answered"), F.col("_first.text").alias("text"), F.when(~answered, F.col("_error")).alias("error"))

    def ask(self, calls: DataFrame, step: str, generate: Generator, attempts: int = 1, tasks: int | None = None, batch: int = 32, timeout: float | None = None) -> None:
        """Make the calls (id, key, payload) that are neither answered nor out of attempts, and record them."""
        calls = calls.select(PERSON_KEY, "key", "payload")
        calls = (calls.repartition(tasks, PERSON_KEY, "key") if tasks else calls).dropDuplicates([PERSON_KEY, "key"])
        known = self.outcomes(step).select(PERSON_KEY, "key", "attempts", "answered") if exists(self.spark, self._folder(step)) else None
        if known is None:
            todo = calls.withColumn("attempt", F.lit(1))
        else:
            open_ = ~F.coalesce("answered", F.lit(False)) & (F.coalesce("attempts", F.lit(0)) < attempts)
            todo = calls.join(known, [PERSON_KEY, "key"], "left").filter(open_).select(PERSON_KEY, "key", "payload", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"))
        made = todo.mapInPandas(_asker(generate, batch, timeout), ATTEMPTS)
        made.write.mode("append").options(**_PUBLISH_BY_TASK).parquet(self._folder(step))


def call_key(payload: str, step: str, version: str = "") -> Column:
    """Hash of what is asked of which step, by which version of its generator."""
    return F.sha2(F.concat_ws("\x1f", F.lit(version), F.lit(step), F.col(payload)), 256)


def _asker(generate: Generator, batch: int, timeout: float | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                asked = pdf.iloc[at : at + batch]
                made = answers(generate, asked[PERSON_KEY].reset_index(drop=True), asked["payload"].reset_index(drop=True), timeout)
                yield pd.DataFrame({PERSON_KEY: asked[PERSON_KEY].to_numpy(), "key": asked["key"].to_numpy(), "attempt": asked["attempt"].to_numpy(), "text": made["text"].to_numpy(), "error": made["error"].to_numpy()})

    return run


def answers(generate: Generator, ids: pd.Series, payloads: pd.Series, timeout: float | None = None) -> pd.DataFrame:
    """text and error of each payload. What raises is halved until it is a single row, which gets the error."""
    try:
        made = _within(timeout, lambda: generate(ids, payloads))
        if len(made) != len(ids):
            raise ValueError(f"{len(made)} answers to {len(ids)} payloads")
        made = pd.DataFrame({"text": made["text"].to_numpy(object), "error": made["error"].to_numpy(object)})
        neither = made["text"].isna() & made["error"].isna()
        made.loc[neither, "error"] = "no text"
        made.loc[made["error"].notna(), "text"] = None
        return made
    except Exception as error:  # whatever a caller's function raises is recorded, not swallowed
        if len(ids) <= 1:
            return pd.DataFrame({"text": [None] * len(ids), "error": [f"{type(error).__name__}: {error}"] * len(ids)}, dtype=object)
    half = len(ids) // 2
    parts = [(ids.iloc[:half], payloads.iloc[:half]), (ids.iloc[half:], payloads.iloc[half:])]
    return pd.concat([answers(generate, i.reset_index(drop=True), p.reset_index(drop=True), timeout) for i, p in parts], ignore_index=True)


def _within(timeout: float | None, call: Callable[[], pd.DataFrame]) -> pd.DataFrame:
    """The call's result. A call that takes longer is left alone in its thread; its result is dropped."""
    if timeout is None:
        return call()
    out: dict[str, object] = {}

    def run() -> None:
        try:
            out["made"] = call()
        except BaseException as error:
            out["error"] = error

    thread = Thread(target=run, daemon=True)
    thread.start()
    thread.join(timeout)
    if "error" in out:
        raise out["error"]
    if "made" not in out:
        raise TimeoutError(f"no answer within {timeout:g} s")
    return out["made"]

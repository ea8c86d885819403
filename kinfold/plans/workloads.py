"""The three workloads over the survey-shaped views, step by step."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import catalogs
from ..functions.coded import decode, null_missing
from ..operators import dialogs, ledger as ledgers, merge, sampling, scores, steps
from ..operators.guards import guarded
from ..schema import MISSING_CODES, PERSON_KEY, STEPS
from ..sources.staging import stage_folder, staged
from . import fixtures, jobs
from .fixtures import view

#: Rounds that a dialogue is asked for in the examples.
ROUNDS = 3


def person_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, with its rows counted against the skeleton's on the way."""
    skel, *right, family = (view(spark, sf_dir, t) for t in ("s_sample", "s_weights", "s_demo", "s_health", "s_work", "s_family"))
    join = lambda df: merge.merge_household(merge.merge_person(df, *right), family)
    return guarded(merge.skeleton(skel), join, lambda df: staged(df, "wide"), PERSON_KEY)[0]


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.analysis_sample(person_wide(spark, sf_dir))


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.age_filter(analysis(spark, sf_dir))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw reads the persons several times, from the wide table as it was written."""
    return sampling.weighted_sample(aged(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine texts of every draw, from the catalog tables; children from their long table."""
    children = merge.first_children(view(spark, sf_dir, "s_child"))
    return jobs.texts(sample(spark, sf_dir).join(children, "household_id", "left"), fixtures.catalogs(spark), ["sample_pick_order", "id"])


def child_text(spark: SparkSession, children: DataFrame) -> DataFrame:
    """household_id and the phrases of its children."""
    catalog = fixtures.catalogs(spark)
    fact = catalog["facts"].filter("`group` = 'children'")
    groups = catalog["groups"].filter("`group` = 'children'")
    return children.select("household_id", *catalogs.group_columns(groups, fact, catalog["flags"], catalogs.dictionary_labels(catalog["labels"]), children.columns))


def stand_in(step: str):
    """A generator for tests: md5 of step and payload; payloads whose digest begins with 0 fail."""

    def generate(ids: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        digests = [hashlib.md5(f"{step}|{p}".encode()).hexdigest() for p in payloads]
        return pd.DataFrame({"text": digests, "error": ["refused" if d[0] == "0" else None for d in digests]})

    return generate


def raising(step: str):
    """The stand-in, but a batch that holds a payload whose digest begins with f raises."""
    plain = stand_in(step)

    def generate(ids: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        made = plain(ids, payloads)
        if made["text"].str.startswith("f").any():
            raise ConnectionError("hung up")
        return made

    return generate


def personas(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The facts of the persons are read once a step, so they are written first."""
    once = staged(steps.unique_ids(facts(spark, sf_dir) if known is None else known), "persons")
    return steps.run_steps(once, {s: stand_in(s) for s in STEPS}, ledgers.Ledger(spark, stage_folder(spark, "ledger")))


def step_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, id, answered, attempts, error of every call after two runs with a generator that raises, two attempts a call."""
    once = staged(steps.unique_ids(facts(spark, sf_dir)), "persons")
    kept = ledgers.Ledger(spark, stage_folder(spark, "ledger"))
    for _ in range(2):
        steps.run_steps(once, {s: raising(s) for s in STEPS}, kept, attempts=2)
    parts = [kept.outcomes(s).select(F.lit(s).alias("step"), "id", "answered", "attempts", "error") for s in STEPS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def missing_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts are read twice, so they are written first."""
    known = staged(facts(spark, sf_dir), "facts")
    return steps.missing_ids(known, personas(spark, sf_dir, known)[0])


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores of two kinds of results: events, and documents with the evaluator's labels."""
    results = view(spark, sf_dir, "event_results")
    events = scores.long_scores(results.withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') AS double)")), ["value", "k"])
    return events.unionByName(scores.long_scores(combined(spark, sf_dir), ["length", "quality", "toxic"]))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.combine_scores(view(spark, sf_dir, "user_scores"), view(spark, sf_dir, "eval_scores"))


def dialog_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.cap_rounds(dialogs.rounds(view(spark, sf_dir, "turns")), ROUNDS)


DECODED = ("sex", "residence", "edu", "marriage")


def coded_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = catalogs.missing_codes(fixtures.catalogs(spark)["fields"], MISSING_CODES)
    return null_missing(view(spark, sf_dir, "s_demo"), {f: c for (t, f), c in codes.items() if t == "s_demo"})


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = catalogs.dictionary_labels(fixtures.catalogs(spark)["labels"])
    return decode(coded_demo(spark, sf_dir), {f: labels[f] for f in DECODED})

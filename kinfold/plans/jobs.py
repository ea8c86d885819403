"""The three jobs, from paths to paths. All that is particular to a survey comes from its catalog tables.

    python -m kinfold.plans.jobs survey --tables DIR --schemas FILE --catalogs DIR --out DIR
    python -m kinfold.plans.jobs scores --results DIR --sides user,evaluator --out DIR
    python -m kinfold.plans.jobs compact --folder DIR

The generation job takes a caller's functions and so is called from Python: ``personas``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import catalogs
from ..functions.coded import null_missing, repeated_groups, unknown_counts
from ..operators import ledger as ledgers, merge, sampling, scores, steps
from ..operators.guards import guarded
from ..schema import HOUSEHOLD_KEY, MISSING_CODES, PERSON_KEY, SCORES, WEIGHT
from ..sources import compaction, readers, writers
from ..sources.staging import stages

#: Columns that the joins, filters and draws need, kept whatever the catalog says.
KEPT = (PERSON_KEY, HOUSEHOLD_KEY, WEIGHT, "proxy_2", "proxy_5")
CATALOGS = {"fields": readers.read_catalog, "labels": readers.read_dictionary, "groups": readers.read_groups, "facts": readers.read_fact_catalog, "flags": readers.read_flags, "slots": readers.read_slots}


@dataclass(frozen=True)
class Table:
    """A survey table: ``name`` as its file and the field catalog have it."""

    name: str
    schema: StructType
    form: str = "parquet"


@dataclass(frozen=True)
class Survey:
    """The six tables by their part in the merge, and where they lie."""

    folder: str
    sample: Table
    family: Table
    persons: list[Table] = field(default_factory=list)  # joined by person in this order

    @property
    def tables(self) -> list[Table]:
        return [self.sample, *self.persons, self.family]


def read_catalogs(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(CATALOGS)) -> dict[str, DataFrame]:
    return {name: catalogs.localised(CATALOGS[name](spark, f"{folder}/{name}.csv")) for name in names}


def selected(spark: SparkSession, survey: Survey, fields: DataFrame, mode: str = "PERMISSIVE") -> dict[str, DataFrame]:
    """Each table cut to the kept columns and those that the field catalog lists."""
    out = {}
    for t in survey.tables:
        read = readers.read_survey(spark, survey.folder, t.name, t.schema, t.form, mode)
        out[t.name] = merge.select_profile_columns(read, fields, t.name, [c for c in KEPT if c in read.columns])
    return out


def rejects(spark: SparkSession, survey: Survey) -> DataFrame:
    """table, file, fields, line of all CSV lines that don't parse."""
    bad = [readers.read_rejects(spark, survey.folder, t.name, t.schema) for t in survey.tables if t.form == "csv"]
    out = bad[0] if bad else spark.createDataFrame([], "table string, file string, fields array<string>, line string")
    for more in bad[1:]:
        out = out.unionByName(more)
    return out


def wide(spark: SparkSession, survey: Survey, tables: dict[str, DataFrame], catalog: dict[str, DataFrame], out: str) -> tuple[DataFrame, dict[str, int]]:
    """The wide table, written to ``out``, with its number of rows and for each decoded field the answers that the dictionary
    lacks, all from the pass that writes it. Joins that multiply persons fail it."""
    labels = catalogs.dictionary_labels(catalog["labels"])
    codes = catalogs.by_column(catalogs.missing_codes(catalog["fields"], MISSING_CODES))
    columns = list(dict.fromkeys(c for t in tables.values() for c in t.columns))

    def write(df: DataFrame) -> DataFrame:
        writers.write_stage(df, out)
        return spark.read.schema(df.schema).parquet(out)

    join = lambda skel: merge.merge_household(merge.merge_person(skel, *(tables[t.name] for t in survey.persons)), tables[survey.family.name])
    return guarded(merge.skeleton(tables[survey.sample.name]), join, write, PERSON_KEY, unknown_counts(codes, labels, columns))


def texts(rows: DataFrame, catalog: dict[str, DataFrame], carried: list[str]) -> DataFrame:
    """``carried`` and one text per group: reserved codes, repeated columns, labels, lists, templates and the groups' order all
    as the catalogs say."""
    labels = catalogs.dictionary_labels(catalog["labels"])
    rows = null_missing(rows, catalogs.by_column(catalogs.missing_codes(catalog["fields"], MISSING_CODES)))
    for name, slots in catalogs.repeated_columns(catalog["slots"]).items():
        if name not in rows.columns and all(c in rows.columns for slot in slots for c in slot.values()):
            rows = rows.withColumn(name, repeated_groups(slots, "child_no", 2))
    return rows.select(*carried, *catalogs.group_columns(catalog["groups"], catalog["facts"], catalog["flags"], labels, rows.columns))


def survey_to_facts(spark: SparkSession, survey: Survey, catalog_folder: str, out: str, n: int = sampling.DRAWS, seed: int = sampling.SEED, min_age: int = 45, mode: str = "PERMISSIVE") -> dict[str, int]:
    """Below ``out``: wide, analysis (Parquet), sample.csv, facts.csv, rejects (JSON lines). Returns what was counted on the way."""
    catalog = read_catalogs(spark, catalog_folder)
    writers.write_jsonl(rejects(spark, survey), f"{out}/rejects")
    rows, seen = wide(spark, survey, selected(spark, survey, catalog["fields"], mode), catalog, f"{out}/wide")
    writers.write_stage(merge.analysis_sample(rows), f"{out}/analysis")
    drawn = sampling.weighted_sample(merge.age_filter(spark.read.schema(rows.schema).parquet(f"{out}/analysis"), min_age), n=n, seed=seed)
    writers.write_csv(drawn, f"{out}/sample.csv", "sample_pick_order")
    back = readers.read_sample(spark, f"{out}/sample.csv", drawn.schema)
    writers.write_csv(texts(back, catalog, ["sample_pick_order", PERSON_KEY]), f"{out}/facts.csv", "sample_pick_order")
    return {**seen, "rejects": spark.read.schema("table string").json(f"{out}/rejects").count()}


def personas(spark: SparkSession, facts: str, generators: dict[str, ledgers.Generator], ledger: str, out: str, start: int | None = None, limit: int | None = None, **how) -> None:
    """From the fact file to ``out``/personas (JSON lines, one object for each person that has all texts), ``out``/errors and
    ``out``/missing. The same ``ledger`` again goes on where a run ended; ``start`` and ``limit`` take a slice of the draws."""
    known = readers.read_facts(spark, facts)
    if limit is not None:
        known = steps.slice_users(known, start or 0, limit)
    once = steps.unique_ids(known)
    made, errors = steps.run_steps(once, generators, ledgers.Ledger(spark, ledger), **how)
    writers.write_jsonl(made, f"{out}/personas")
    writers.write_jsonl(errors, f"{out}/errors")
    writers.write_jsonl(steps.missing_ids(known, spark.read.schema(f"{PERSON_KEY} string").json(f"{out}/personas")), f"{out}/missing")


def results_to_scores(spark: SparkSession, results: str, sides: list[str], out: str, profile: str | None = None, include_manual: bool = False, form: str = "csv") -> dict[str, int]:
    """From result folders to ``out``/scores (compact table), ``out``/means, ``out``/summary (a row per profile, over the
    dimensions that occur) and ``out``/rejects, for one profile or all."""
    read = readers.read_results(spark, results, StructType.fromDDL("run_id string, result string"), profile, include_manual)
    entries = scores.score_entries(read, sides)
    writers.write_stage(entries, f"{out}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{out}/entries")
    good = entries.filter("reason IS NULL").select("profile", "run_id", F.concat_ws(".", "side", "dimension").alias("dimension"), "score")
    writers.write_scores(good, f"{out}/scores", form)
    writers.write_jsonl(entries.filter("reason IS NOT NULL"), f"{out}/rejects")
    writers.write_scores(scores.mean_scores(good), f"{out}/means", form)
    found = sorted(r[0] for r in catalogs.rows(good.select("dimension").distinct()))
    writers.write_scores(scores.score_summary(good, found), f"{out}/summary", form)
    return {r["reason"] or "scores": r["count"] for r in entries.groupBy("reason").count().collect()}


def _survey(folder: str, schemas: str) -> Survey:
    """{"sample": {"name", "schema" (DDL), "form"}, "family": {...}, "persons": [{...}, ...]}"""
    with open(schemas) as file:
        told = json.load(file)
    one = lambda x: Table(x["name"], StructType.fromDDL(x["schema"]), x.get("form", "parquet"))
    return Survey(folder, one(told["sample"]), one(told["family"]), [one(x) for x in told["persons"]])


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinfold.plans.jobs")
    of = parser.add_subparsers(dest="job", required=True)
    survey = of.add_parser("survey")
    for name in ("tables", "schemas", "catalogs", "out"):
        survey.add_argument(f"--{name}", required=True)
    survey.add_argument("--draws", type=int, default=sampling.DRAWS)
    survey.add_argument("--seed", type=int, default=sampling.SEED)
    survey.add_argument("--min-age", type=int, default=45)
    survey.add_argument("--mode", choices=["PERMISSIVE", "FAILFAST"], default="PERMISSIVE")
    result = of.add_parser("scores")
    for name in ("results", "out"):
        result.add_argument(f"--{name}", required=True)
    result.add_argument("--sides", default="user,evaluator")
    result.add_argument("--profile")
    result.add_argument("--include-manual", action="store_true")
    pack = of.add_parser("compact")
    pack.add_argument("--folder", required=True)
    pack.add_argument("--target-mb", type=int, default=compaction.TARGET_BYTES >> 20)
    told = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    with stages(spark):
        done = _run(spark, told)
    print(json.dumps(done, ensure_ascii=False))


def _run(spark: SparkSession, told: argparse.Namespace) -> dict:
    if told.job == "survey":
        return survey_to_facts(spark, _survey(told.tables, told.schemas), told.catalogs, told.out, told.draws, told.seed, told.min_age, told.mode)
    if told.job == "scores":
        return results_to_scores(spark, told.results, told.sides.split(","), told.out, told.profile, told.include_manual)
    return compaction.compact(spark, told.folder, SCORES, target=told.target_mb << 20)


if __name__ == "__main__":
    main()

"""The jobs from files to files over the given tables: survey tables, catalogs and result files are written
as a user would have them, the jobs are called on them, and what they wrote is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.catalogs import local_table
from ..operators import merge, scores
from ..schema import DICTIONARY, PERSON_KEY, SCORES, STEPS
from ..sources import readers, writers
from ..sources.staging import stage_folder, staged
from . import fixtures, jobs, workloads as w
from .fixtures import view

#: The tables after the sample, with the form that each is kept in.
PERSONS = {"s_weights": "parquet", "s_demo": "csv", "s_health": "parquet", "s_work": "csv"}
#: Left out of the dictionary of the file jobs, so that codes stay unknown: field and code.
LEFT_OUT = ("edu", 10)
#: Fields with a dictionary in the wide table.
DECODED = ("sex", "residence", "edu", "marriage", "satisfaction", "retired")
#: Every so many persons the sex of the demographic file is a word.
BROKEN = 50


def dictionary_rows() -> list[tuple[str, int, str]]:
    return [r for r in fixtures.DICTIONARY if (r[0], r[1]) != LEFT_OUT]


def survey_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six tables as they go into the files. A weight of 0 stands there as NaN and is read as missing; households have their
    children in repeated columns."""
    out = {name: view(spark, sf_dir, name) for name in ("s_sample", *PERSONS, "s_family")}
    weight = F.col("indv_weight_ad2")
    out["s_weights"] = out["s_weights"].withColumn("indv_weight_ad2", F.when(weight == 0, float("nan")).otherwise(weight))
    out["s_family"] = out["s_family"].join(view(spark, sf_dir, "s_slots"), "household_id", "left")
    return out


def write_survey(spark: SparkSession, tables: dict[str, DataFrame], broken: bool = False) -> jobs.Survey:
    """The tables' files and what a job has to know of them. ``broken``: some lines of a CSV file have a word for a number."""
    at = stage_folder(spark, "survey")
    told = {name: jobs.Table(name, df.schema, PERSONS.get(name, "csv")) for name, df in tables.items()}
    for name, df in tables.items():
        if broken and name == "s_demo":
            df = df.withColumn("sex", F.when(F.col("id").cast("long") % BROKEN == 0, "forty").otherwise(F.col("sex").cast("string")))
        path = f"{at}/{name}.{told[name].form}"
        writers.write_csv(df, path) if told[name].form == "csv" else writers.write_stage(df, path)
    return jobs.Survey(at, told["s_sample"], told["s_family"], [told[name] for name in PERSONS])


def write_catalogs(spark: SparkSession, names: tuple[str, ...] = tuple(jobs.CATALOGS)) -> str:
    at = stage_folder(spark, "catalogs")
    tables = fixtures.catalogs(spark) | {"labels": local_table(spark, dictionary_rows(), DICTIONARY)}
    for name in names:
        writers.write_csv(tables[name].coalesce(1), f"{at}/{name}.csv")
    return at


def _wide(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("fields", "labels")) -> tuple[DataFrame, dict[str, int], dict[str, DataFrame]]:
    survey, catalog = write_survey(spark, survey_tables(spark, sf_dir)), jobs.read_catalogs(spark, write_catalogs(spark, names), names)
    rows, seen = jobs.wide(spark, survey, jobs.selected(spark, survey, catalog["fields"]), catalog, stage_folder(spark, "wide"))
    return rows, seen, catalog


def selected_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)[0]


def catalog_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine texts of the whole analysis sample, through a CSV file."""
    rows, _, catalog = _wide(spark, sf_dir, tuple(jobs.CATALOGS))
    path, out = stage_folder(spark, "facts"), jobs.texts(merge.analysis_sample(rows), catalog, [PERSON_KEY])
    writers.write_csv(out, path, PERSON_KEY)
    return readers.read_sample(spark, path, out.schema)


def unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row, counted while the wide table was written: answers of each decoded field that the dictionary lacks, reserved codes aside."""
    seen = _wide(spark, sf_dir)[1]
    return spark.range(1).select(*(F.lit(seen[f]).cast("long").alias(f) for f in DECODED))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table, id: the persons whose lines of a CSV file don't parse, and those that the table is read with."""
    survey = write_survey(spark, {"s_demo": view(spark, sf_dir, "s_demo")} | {n: view(spark, sf_dir, n) for n in ("s_sample", "s_family")} | {n: view(spark, sf_dir, n).limit(0) for n in PERSONS if n != "s_demo"}, broken=True)
    demo = next(t for t in survey.tables if t.name == "s_demo")
    bad = jobs.rejects(spark, survey).select("table", F.lit("rejected").alias("state"), F.substring_index("line", ",", 1).alias("id"))
    good = readers.read_survey(spark, survey.folder, demo.name, demo.schema, demo.form).select(F.lit("s_demo").alias("table"), F.lit("read").alias("state"), "id")
    return bad.unionByName(good)


def facts_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_folder(spark, "fact-text")
    writers.write_csv(w.facts(spark, sf_dir), path, "sample_pick_order")
    return readers.read_facts(spark, path)


def survey_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact file of the whole survey job, called on folders."""
    out = stage_folder(spark, "job")
    jobs.survey_to_facts(spark, write_survey(spark, survey_tables(spark, sf_dir)), write_catalogs(spark), out)
    return readers.read_facts(spark, f"{out}/facts.csv")


def sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, drawn = stage_folder(spark, "sample"), w.sample(spark, sf_dir)
    writers.write_csv(drawn, path, "sample_pick_order")
    return readers.read_sample(spark, path, drawn.schema)


def persona_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_folder(spark, "personas")
    writers.write_jsonl(w.personas(spark, sf_dir)[0], path)
    return spark.read.schema(StructType([StructField(c, StringType()) for c in (PERSON_KEY, *STEPS)])).json(path)


def _results(spark: SparkSession, sf_dir: str) -> str:
    """Result files in a directory per profile. The runs whose number 7 divides are manual, and their files lack the value."""
    root, rows = stage_folder(spark, "results"), view(spark, sf_dir, "event_results")
    manual = F.col("run_id").cast("long") % 7 == 0
    writers.write_results(rows.filter(~manual), root)
    writers.write_results(rows.filter(manual).withColumn("profile", F.lit("manual")).drop("value"), root)
    return root


def scores_file(spark: SparkSession, sf_dir: str, include_manual: bool = True) -> DataFrame:
    """profile, run_id, dimension, score: all profiles' results to the compact table, as a file."""
    results = readers.read_results(spark, _results(spark, sf_dir), StructType.fromDDL("run_id string, value double, props string"), include_manual=include_manual)
    results = results.filter(F.col("_corrupt_record").isNull())
    found = scores.long_scores(results.withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') AS double)")), ["value", "k"])
    path = stage_folder(spark, "scores")
    writers.write_scores(found, path)
    return spark.read.schema(SCORES).option("header", True).csv(path)


def named_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mode, profile, n, total: result folders of profiles whose names need encoding, read all at once and one by one."""
    root, kind = stage_folder(spark, "results"), StructType.fromDDL("run_id string, value double")
    writers.write_results(view(spark, sf_dir, "named_results"), root)
    parts = [readers.read_results(spark, root, kind).withColumn("mode", F.lit("all"))]
    parts += [readers.read_results(spark, root, kind, profile=name).withColumn("mode", F.lit("one")) for name in fixtures.PROFILES.values()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("mode", "profile").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def result_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and quarantine of nested results with unknown dimensions, through result folders."""
    root = stage_folder(spark, "results")
    writers.write_results(view(spark, sf_dir, "json_results"), root)
    return scores.score_entries(readers.read_results(spark, root, StructType.fromDDL("run_id string, result string")), ["user", "evaluator"])


def result_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reason, n: entries by the reason they are no scores; a score has none."""
    return staged(result_entries(spark, sf_dir), "entries").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

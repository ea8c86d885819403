"""The ledger, result folders, catalogs, quarantine, slices, bucketed tables and compaction."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.functions import catalogs
from kinfold.operators import dialogs, ledger, merge, scores, steps
from kinfold.plans import fixtures, jobs
from kinfold.schema import FACT_CATALOG, FLAG_CATALOG, GROUP_CATALOG, GROUPS, STEPS
from kinfold.sources import compaction, folders, readers, staging, writers

FACTS = ", ".join(["sample_pick_order int, id string", *(f"{g} string" for g in GROUPS)])


def people(spark, n):
    return spark.createDataFrame([(i, f"p{i:03}", *(f"{g}{i}" for g in GROUPS)) for i in range(n)], FACTS)


def noting(log, step, fails=lambda i: False, ends=lambda i: False):
    """A generator that notes every payload it answers or refuses, one file each."""

    def generate(ids, payloads):
        if any(ends(i) for i in ids):
            os._exit(1)
        for i in ids:
            with open(f"{log}/{step}-{i}-{time.time_ns()}", "w"):
                pass
        return pd.DataFrame({"text": [f"{step} of {i}" for i in ids], "error": ["no" if fails(i) else None for i in ids]})

    return generate


def noted(log):
    return sorted(name.rpartition("-")[0] for name in os.listdir(log))


def test_a_run_that_ends_between_steps_goes_on_without_a_repeated_call(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    kept = ledger.Ledger(spark, f"{tmp_path}/ledger")
    made = {s: noting(log, s) for s in STEPS}
    with pytest.raises(KeyError):
        steps.run_steps(people(spark, 20), {s: made[s] for s in ("personality", "experience")}, kept)
    assert len(noted(log)) == 40
    done, errors = steps.run_steps(people(spark, 25), made, kept)
    assert done.count() == 25 and errors.count() == 0
    assert noted(log) == sorted(f"{s}-p{i:03}" for s in STEPS for i in range(25))
    assert done.filter("id = 'p003'").first()["anchors"] == "anchors of p003"
    again, _ = steps.run_steps(people(spark, 25), made, kept)
    assert again.count() == 25 and len(noted(log)) == 100
    steps.run_steps(people(spark, 25), made, kept, version="2")
    assert len(noted(log)) == 200


def test_a_job_that_dies_keeps_the_answers_of_its_finished_tasks(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    kept = ledger.Ledger(spark, f"{tmp_path}/ledger")
    calls = people(spark, 40).select("id", F.col("id").alias("payload"), ledger.call_key("id", "personality").alias("key"))
    calls = calls.repartitionByRange(8, "id")
    hanging = lambda i: i == "p039" and not time.sleep(4)  # noqa: E731  the last task dies after the others have ended
    with pytest.raises(Exception, match="(?i)exit|crash|EOF"):
        kept.ask(calls, "personality", noting(log, "personality", ends=hanging))
    before = noted(log)
    assert 30 <= len(before) < 40
    kept.ask(calls, "personality", noting(log, "personality"))
    assert len(noted(log)) == 40 and kept.outcomes("personality").filter("answered").count() == 40


def test_failed_calls_are_asked_again_up_to_their_attempts(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    kept = ledger.Ledger(spark, f"{tmp_path}/ledger")
    made = {s: noting(log, s, fails=lambda i, s=s: (s, i) == ("personality", "p001")) for s in STEPS}
    for run in range(4):
        done, errors = steps.run_steps(people(spark, 3), made, kept, attempts=3)
        assert done.count() == 2 and [tuple(r) for r in errors.collect()] == [("p001", "personality", "no")]
        assert noted(log).count("personality-p001") == min(run + 1, 3)
    made["personality"] = noting(log, "personality")
    assert steps.run_steps(people(spark, 3), made, kept, attempts=4)[0].count() == 3
    seen = {r["id"]: (r["answered"], r["attempts"], r["error"]) for r in kept.outcomes("personality").collect()}
    assert seen == {"p000": (True, 1, None), "p001": (True, 4, None), "p002": (True, 1, None)}


def test_exceptions_timeouts_and_wrong_numbers_are_answers_with_errors():
    ids = pd.Series(list("abcdefgh"))

    def one_raises(i, payloads):
        if (payloads == "d").any():
            raise ValueError("bad d")
        return pd.DataFrame({"text": payloads.str.upper(), "error": None})

    got = ledger.answers(one_raises, ids, ids)
    assert list(got["text"].where(got["text"].notna(), None)) == ["A", "B", "C", None, "E", "F", "G", "H"]
    assert list(got["error"].dropna()) == ["ValueError: bad d"]
    slow = ledger.answers(lambda i, p: time.sleep(1) if "a" in set(p) else pd.DataFrame({"text": p, "error": None}), ids[:2], ids[:2], 0.1)
    assert list(slow["error"].where(slow["error"].notna(), None)) == ["TimeoutError: no answer within 0.1 s", None]
    short = ledger.answers(lambda i, p: pd.DataFrame({"text": p[:1], "error": None}), ids[:3], ids[:3])
    assert list(short["text"]) == ["a", "b", "c"]
    none = ledger.answers(lambda i, p: pd.DataFrame({"text": [None, ""], "error": [None, None]}), ids[:2], ids[:2])
    assert none["error"][0] == "no text" and none["text"][1] == "" and none["error"][1] is None
    assert len(ledger.answers(one_raises, ids[:0], ids[:0])) == 0


NAMES = [*fixtures.PROFILES.values(), "a/b", "[x]*?", "007", "manual", "é'\"", "2024-01-01"]


def test_profile_names_come_back_as_they_were(spark, tmp_path):
    rows = [(n, str(i), float(i)) for i, n in enumerate(NAMES)] + [(None, "none", 1.0)]
    writers.write_results(spark.createDataFrame(rows, "profile string, run_id string, value double"), f"{tmp_path}/out")
    kind = StructType.fromDDL("run_id string, value double")
    read = readers.read_results(spark, f"{tmp_path}/out", kind, include_manual=True)
    assert sorted((r["profile"] or "", r["run_id"]) for r in read.collect()) == sorted((p or "", i) for p, i, _ in rows)
    for name, run, _ in rows[:-1]:
        one = readers.read_results(spark, f"{tmp_path}/out", kind, profile=name)
        assert [(r["profile"], r["run_id"]) for r in one.collect()] == [(name, run)]
    plan = readers.read_results(spark, f"{tmp_path}/out", kind, profile="GLM 4.7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(profile" in plan
    assert {r["profile"] for r in readers.read_results(spark, f"{tmp_path}/out", kind).collect()} == {*NAMES, None} - {"manual"}


def test_folders_named_after_their_profile(spark, tmp_path):
    names = [n for n in NAMES if "/" not in n]
    for i, name in enumerate(names):
        os.makedirs(tmp_path / "out" / name)
        (tmp_path / "out" / name / "runs.jsonl").write_text(json.dumps({"run_id": str(i)}) + "\nbroken\n")
    kind = StructType.fromDDL("run_id string")
    read = readers.read_results(spark, f"{tmp_path}/out", kind, include_manual=True)
    assert sorted((r["profile"], r["run_id"]) for r in read.filter("_corrupt_record IS NULL").collect()) == sorted((n, str(i)) for i, n in enumerate(names))
    for i, name in enumerate(names):
        one = readers.read_results(spark, f"{tmp_path}/out", kind, profile=name)
        assert sorted((r["profile"], r["run_id"] or "") for r in one.collect()) == [(name, ""), (name, str(i))]
        assert len(one.inputFiles()) == 1
    assert readers.read_results(spark, f"{tmp_path}/out", kind, profile="nobody").count() == 0


def test_templates(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None), (9, 9)], "a int, b int")
    labels = {"b": {2: "two"}}
    said = lambda t: [r[0] for r in df.select(catalogs.template(t, F.col, labels)).collect()]
    assert said("a{a}b{b:label}") == ["a1btwo", None, None, None]
    assert said("a{a}[, b {b:label}]!") == ["a1, b two!", None, "a1!", "a9!"]
    assert said("plain") == ["plain"] * 4
    for wrong in ("{a:label}", "{a:name}"):
        with pytest.raises(ValueError):
            said(wrong)


def test_groups_come_in_their_order_and_wrong_catalogs_are_errors(spark):
    table = lambda rows, kind: catalogs.local_table(spark, rows, kind)
    groups = table([("z", 1, "Z"), ("a", 2, "A"), ("empty", 3, "E")], GROUP_CATALOG)
    facts = [("a", 2, "number", None, None, "n{x}"), ("z", 1, "label", "x", "X", None), ("a", 1, "flags", "l", "L", "none")]
    flags = table([("l", 1, "f", "eff")], FLAG_CATALOG)
    df = spark.createDataFrame([(5, 1), (None, 0), (3, None)], "x int, f int")
    made = df.select(*catalogs.group_columns(groups, table(facts, FACT_CATALOG), flags, {"x": {5: "five"}}, df.columns))
    assert made.columns == ["z", "a", "empty"]
    assert [tuple(r) for r in made.collect()] == [("X：five", "L：eff；n5", None), (None, "L：none", None), (None, "n3", None)]
    for wrong in (("q", 1, "label", "x", "X", None), ("a", 3, "label", "y", "Y", None), ("a", 3, "flags", "m", "M", "none"), ("a", 3, "sum", "x", "X", None)):
        with pytest.raises(ValueError):
            catalogs.group_columns(groups, table([*facts, wrong], FACT_CATALOG), flags, {}, df.columns)
    codes = {("t", "x"): [97], ("u", "x"): []}
    with pytest.raises(ValueError):
        catalogs.by_column(codes)
    assert catalogs.by_column({("t", "id"): [], ("u", "id"): []}, ["id"]) == {"id": []}


def test_malformed_lines_are_set_aside(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "t.csv")
    lines = ['id,xrage,w', '"01",40,1.5', '"02",forty,1.5', '"03",,', '"04",41', '"05",42,1.5,7', '"06",4.5,NaN', '"07",43,NaN', '"08",99999999999,1']
    (tmp_path / "in" / "t.csv" / "part 1.csv").write_text("\n".join(lines) + "\n")
    kind = StructType.fromDDL("id string, xrage int, w double")
    good = readers.read_survey(spark, f"{tmp_path}/in", "t", kind, "csv")
    assert good.schema == kind and sorted(map(tuple, good.collect())) == [("01", 40, 1.5), ("03", None, None), ("07", 43, None)]
    assert good.select("w").count() == 3
    bad = readers.read_rejects(spark, f"{tmp_path}/in", "t", kind)
    assert sorted((r["line"], r["fields"]) for r in bad.collect()) == [('"04",41', []), ('"05",42,1.5,7', []), ("02,forty,1.5", ["xrage"]), ("06,4.5,NaN", ["xrage"]), ("08,99999999999,1", ["xrage"])]
    assert {r["file"].rpartition("/")[2] for r in bad.collect()} == {"part 1.csv"} and bad.select("table").distinct().count() == 1
    with pytest.raises(Exception, match="malformed line"):
        readers.read_survey(spark, f"{tmp_path}/in", "t", kind, "csv", "FAILFAST").collect()


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_slices_equal_a_sorted_whole(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), F.lit("t").alias("t"), F.lit(1).alias("part")).repartition(6)
        for start, limit in ((0, 10), (1234, 2000), (4990, 100), (6000, 5), (7, 0)):
            got = [r["k"] for r in steps.slice_users(df, start, limit, "k").collect()]
            assert sorted(got) == list(range(5_000))[start : start + limit]
        ties = spark.range(1_000).select((F.col("id") % 3).alias("k"), "id")
        parts = [{r["id"] for r in steps.slice_users(ties, s, 100, "k").collect()} for s in range(0, 1_000, 100)]
        assert sum(map(len, parts)) == len(set().union(*parts)) == 1_000
        assert steps.slice_users(df.limit(0), 0, 5, "k").count() == 0
        text = df.select(F.format_string("n%05d", "k").alias("name"))
        assert sorted(r[0] for r in steps.slice_users(text, 100, 2, "name").collect()) == ["n00100", "n00101"]
        plan = steps.slice_users(df, 1234, 2000, "k")._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit" not in plan and "Sort" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_requested_runs(spark):
    turns = [("m", "1", 1, "user", "q"), ("m", "1", 2, "assistant", "a"), ("m", "2", 1, "user", "q"), ("m", "3", 1, "assistant", "hi"), ("m", "9", 1, "user", "q"), ("m", "5", 1, "user", "q"), ("m", "5", 2, "assistant", "a")]
    paired = dialogs.rounds(spark.createDataFrame(turns, "profile string, run_id string, turn long, role string, text string"))
    asked = spark.createDataFrame([("m", str(i), 1 + (i == 5)) for i in range(1, 6)], "profile string, run_id string, rounds int")
    got = {r["run_id"]: r["state"] for r in dialogs.requested_status(paired, asked).collect()}
    assert got == {"1": "complete", "2": "unanswered", "3": "not run", "4": "not run", "5": "incomplete", "9": "not requested"}


def test_score_entries(spark):
    rows = ['{"user": {"scores": {"warm": 4, "x.y": "2"}}, "evaluator": {"scores": {"kind": 3.5, "bad": "high", "nan": "NaN"}}}', '{"user": {"scores": {"warm": 1}}}', '{"user": {"sco', "", None, '{"user": {}}', "[]", '{"user": {"scores": {"n": null}}}']
    df = spark.createDataFrame([("m", str(i), r) for i, r in enumerate(rows)], "profile string, run_id string, result string")
    entries = scores.score_entries(df, ["user", "evaluator"]).collect()
    assert sorted((r["run_id"], r["side"], r["dimension"], r["score"]) for r in entries if r["reason"] is None) == [("0", "evaluator", "kind", 3.5), ("0", "user", "warm", 4.0), ("0", "user", "x.y", 2.0), ("1", "user", "warm", 1.0)]
    told = sorted((r["run_id"], r["reason"], r["dimension"] or "") for r in entries if r["reason"] is not None)
    assert told[:2] == [("0", "not a number", "bad"), ("0", "not a number", "nan")]
    assert {i: reason for i, reason, _ in told[2:]} | {"3": None, "6": None} == {"2": "not JSON", "3": None, "4": "no result", "5": "no scores", "6": None, "7": "not a number"}
    assert {i for i, *_ in told} == {"0", "2", "3", "4", "5", "6", "7"}


def test_bucketed_tables_join_without_an_exchange(spark):
    names = []
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, columns in (("skel", ["household_id"]), ("demo", ["sex"]), ("work", ["days"])):
            df = spark.range(500).select(F.col("id").cast("string").alias("id"), *(F.lit(1).alias(c) for c in columns))
            names.append(f"bucketed_{name}_{time.time_ns()}")
            writers.write_bucketed(df, names[-1], "id", 4)
        skel, demo, work = (spark.table(n) for n in names)
        wide = merge.merge_person(skel, demo, work)
        assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString() and wide.count() == 500
        plain = merge.merge_person(skel, spark.table(names[1]).repartition(3), work)  # another table as any other
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString() and plain.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_compaction(spark, tmp_path):
    root, kind = f"{tmp_path}/out", StructType.fromDDL("run_id string, value double")
    for name in ("plain", "GLM 4.7"):
        os.makedirs(f"{root}/{name}")
        for i in range(250):
            with open(f"{root}/{name}/run-{i}.json", "w") as file:
                file.write(json.dumps({"run_id": str(i), "value": i / 2}) + ("\nbroken" if i == 3 else "") + "\n")
    rows = lambda: sorted(map(str, readers.read_results(spark, root, kind).collect()))
    before = rows()
    done = compaction.compact(spark, root, kind)
    assert {k.rpartition("/")[2]: v for k, v in done.items()} == {"plain": (250, 1), "GLM 4.7": (250, 1)}
    assert rows() == before and len(before) == 502
    assert compaction.compact(spark, root, kind) == {} and rows() == before
    os.rename(f"{root}/plain", f"{root}/.old-plain")  # as a crash between the two renames leaves it
    assert compaction.compact(spark, root, kind) == {} and rows() == before
    os.makedirs(f"{root}/.old-plain")  # and one before the old folder is deleted
    assert compaction.compact(spark, root, kind) == {} and rows() == before and not os.path.exists(f"{root}/.old-plain")
    table = f"{tmp_path}/parquet"
    spark.range(1_000).repartition(50).write.parquet(table)
    small = compaction.compact(spark, table, StructType.fromDDL("id long"), "parquet", 4_000)
    assert small[table][0] == 50 > small[table][1] >= 2 and spark.read.parquet(table).distinct().count() == 1_000
    assert folders.literal("a[b]*") == "a\\[b\\]\\*"


def test_stages_own_their_folders(spark):
    with staging.stages(spark) as outer:
        one = staging.staged(spark.range(3), "one")
        with staging.stages(spark) as inner:
            two = staging.staged(spark.range(4), "two")
            with staging.shuffles_freed(spark), staging.shuffles_freed(spark):
                assert two.count() == 4
        assert len(outer) == len(inner) == 1 and not folders.exists(spark, inner[0]) and one.count() == 3
    assert not folders.exists(spark, outer[0])
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_the_survey_job_from_the_command_line(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from kinfold.plans import files

    survey, at = files.write_survey(spark, files.survey_tables(spark, sf), broken=True), files.write_catalogs(spark)
    one = lambda t: {"name": t.name, "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema), "form": t.form}
    told = {"sample": one(survey.sample), "family": one(survey.family), "persons": [one(t) for t in survey.persons]}
    (tmp_path / "schemas.json").write_text(json.dumps(told))
    out = f"{tmp_path}/out"
    jobs.main(["survey", "--tables", survey.folder, "--schemas", f"{tmp_path}/schemas.json", "--catalogs", at, "--out", out, "--draws", "40"])
    facts = readers.read_facts(spark, f"{out}/facts.csv")
    assert facts.count() == 40 and facts.columns == ["sample_pick_order", "id", *GROUPS]
    bad = spark.read.json(f"{out}/rejects")
    assert bad.count() == files.view(spark, sf, "s_demo").filter(F.col("id").cast("long") % files.BROKEN == 0).count() > 0
    jobs.personas(spark, f"{out}/facts.csv", {s: noting(str(tmp_path), s) for s in STEPS}, f"{out}/ledger", out, start=5, limit=10)
    made = spark.read.json(f"{out}/personas")
    assert made.count() == facts.filter("sample_pick_order BETWEEN 6 AND 15").select("id").distinct().count()


def test_the_scores_job(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from kinfold.plans import files

    writers.write_results(files.view(spark, sf, "json_results"), f"{tmp_path}/results")
    told = jobs.results_to_scores(spark, f"{tmp_path}/results", ["user", "evaluator"], f"{tmp_path}/out")
    assert set(told) == {"scores", "not JSON", "not a number", "no scores", "no result"}
    summary = spark.read.option("header", True).csv(f"{tmp_path}/out/summary")
    assert set(summary.columns) == {"profile", "user.k", "user.m", *(f"evaluator.e{i}" for i in range(3))} and summary.count() == 5
    one = jobs.results_to_scores(spark, f"{tmp_path}/results", ["user", "evaluator"], f"{tmp_path}/one", profile="view")
    assert 0 < one["scores"] < told["scores"]

"""The survey, persona and score jobs on hand-made frames."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.functions import catalogs, coded
from kinfold.operators import decoding, dialogs, merge, sampling, scores, steps
from kinfold.operators.guards import guarded
from kinfold.operators.ledger import Ledger
from kinfold.plans import fixtures, jobs
from kinfold.schema import GROUPS, STEPS
from kinfold.sources import readers, writers
from kinfold.sources.staging import stage_folder, staged


def people(spark):
    nan = float("nan")
    rows = [("01", "h1", 1, 0, 5.0, 2, None, 50), ("02", "h1", 1, 0, 0.0, None, None, 60), ("03", None, 1, 0, nan, 2, 2, 70), ("04", "h2", 1, 1, 3.0, 2, 2, 80), ("05", "h3", 0, 0, 3.0, 2, 2, 80), ("06", "h3", 1, 0, 2.0, 1, 2, 44), ("07", "h3", 1, 0, 2.0, 2, 1, 44), ("08", "h4", 1, 0, None, 2, 2, 44), ("09", "h4", 1, 0, 1.5, 2, 2, 44)]
    return spark.createDataFrame(rows, "id string, household_id string, crosssection int, died int, indv_weight_ad2 double, proxy_2 int, proxy_5 int, xrage int")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(spark):
    df = people(spark)
    assert ids(merge.skeleton(df)) == ["01", "02", "03", "06", "07", "08", "09"]
    assert ids(merge.analysis_sample(df)) == ["01", "09"]
    assert ids(merge.age_filter(merge.analysis_sample(df))) == ["01"]
    assert merge.analysis_sample(df.limit(0)).count() == 0


def test_joins_keep_every_person_once(spark):
    skel = merge.skeleton(people(spark)).select("id", "household_id")
    demo = spark.createDataFrame([("01", 1), ("02", 2), ("99", 3)], "id string, sex int")
    family = spark.createDataFrame([("h1", 7), (None, 8), ("h3", 9)], "household_id string, house int")
    wide = merge.merge_household(merge.merge_person(skel, demo), family)
    got = {r["id"]: (r["sex"], r["house"]) for r in wide.collect()}
    assert len(got) == wide.count() == skel.count()
    assert got["01"] == (1, 7) and got["03"] == (None, None) and got["06"] == (None, 9)


def test_a_right_side_that_repeats_a_key_fails_the_write(spark):
    skel = merge.skeleton(people(spark)).select("id", "household_id")
    demo = spark.createDataFrame([("01", 1), ("02", 2)], "id string, sex int")
    family = spark.createDataFrame([("h1", 7), ("h3", 9)], "household_id string, house int")
    join = lambda d, f: lambda df: merge.merge_household(merge.merge_person(df, d), f)
    unknown = coded.unknown_counts({"sex": [2]}, {"sex": {9: "x"}}, ["sex"])
    wide, seen = guarded(skel, join(demo, family), lambda df: staged(df, "wide"), "id", unknown)
    assert wide.count() == 7 and seen == {"rows": 7, "sex": 1}
    with pytest.raises(ValueError, match="01"):
        guarded(skel, join(demo.union(demo), family), lambda df: staged(df, "wide"), "id")
    with pytest.raises(ValueError, match="0[167]"):
        guarded(skel, join(demo, family.union(family)), lambda df: staged(df, "wide"), "id")
    assert guarded(skel.limit(0), join(demo, family), lambda df: staged(df, "wide"), "id")[1]["rows"] == 0


def test_catalog_selection(spark):
    df = spark.createDataFrame([("1", 2, 3)], "id string, xrage int, other int")
    catalog = spark.createDataFrame([("t", "xrage"), ("u", "other")], "table string, field string")
    assert merge.select_profile_columns(df, catalog, "t", ["id"]).columns == ["id", "xrage"]
    with pytest.raises(ValueError):
        merge.select_profile_columns(df.drop("xrage"), catalog, "t", ["id"])


def test_draws(spark):
    rows = [(f"p{i}", float(i % 5)) for i in range(200)] + [("heavy", 4000.0), ("none", None), ("nan", float("nan")), ("less", -3.0)]
    df = coded.clean_nan(spark.createDataFrame(rows, "id string, indv_weight_ad2 double"))
    one = [tuple(r) for r in sampling.weighted_sample(df).orderBy("sample_pick_order").collect()]
    assert [r[0] for r in one] == list(range(1, 501))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    two = [tuple(r) for r in sampling.weighted_sample(df.repartition(5)).orderBy("sample_pick_order").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two
    other = [tuple(r) for r in sampling.weighted_sample(df, seed=1).orderBy("sample_pick_order").collect()]
    assert other != one
    drawn = pd.Series([r[1] for r in one]).value_counts()
    weights = {k: w for k, w in rows if w and w > 0}
    assert set(drawn.index) <= set(weights)
    share = weights["heavy"] / sum(weights.values())
    assert abs(drawn["heavy"] - 500 * share) < 5 * (500 * share * (1 - share)) ** 0.5
    assert sampling.weighted_sample(df.limit(0)).count() == 0


def test_draws_are_where_the_points_fall(spark):
    df = spark.createDataFrame([(f"p{i}", float(1 + i % 7)) for i in range(50)], "id string, indv_weight_ad2 double")
    p = {r["id"]: r["p"] for r in sampling.with_probability(df).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9
    n = 20_000
    drawn = sampling.draw_keys(df, n=n).groupBy("id").count().toPandas().set_index("id")["count"]
    assert all(abs(drawn.get(k, 0) - n * v) < 5 * (n * v * (1 - v)) ** 0.5 for k, v in p.items())


def test_coded_answers(spark):
    df = spark.createDataFrame([("a", 1, 97, 1, 2), ("b", 98, 3, 2, 2), ("c", None, None, None, None), ("d", 55, 99, 2, None)], "id string, sex int, days int, c1 int, c2 int")
    clean = coded.null_missing(df, {"sex": [97, 98, 99], "days": []})
    assert [tuple(r) for r in clean.select("sex", "days").collect()] == [(1, 97), (None, 3), (None, None), (55, 99)]
    labels = {"sex": {1: "男", 2: "女"}}
    assert [r["sex_label"] for r in coded.decode(clean, labels).collect()] == ["男", None, None, None]
    assert clean.agg(*coded.unknown_counts({}, labels, clean.columns)).first()["sex"] == 1
    assert df.agg(*coded.unknown_counts({"sex": [98]}, labels, df.columns)).first()["sex"] == 1
    table = spark.createDataFrame([("sex", 1, "男"), ("sex", 2, "女")], "field string, code int, label string")
    wide = {r["id"]: r["sex_label"] for r in coded.decode(clean, labels).collect()}
    for rows in (0, 2, 10):  # by shuffles, and by broadcast
        assert {r["id"]: r["label"] for r in decoding.decode_long(clean, "id", table, ["sex"], rows).collect()} == wide
        assert {r["id"]: r["sex_label"] for r in decoding.decode_by_join(clean, "id", table, ["sex"], broadcast_rows=rows).collect()} == wide
    plan = decoding.decode_long(clean, "id", table, ["sex"], 0)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan and "broadcast" not in plan
    flags = df.select(coded.flags_to_list({"c1": "甲", "c2": "乙"}, "无").alias("x"), coded.numeric_fact("days", "工作{}天").alias("y"))
    assert [tuple(r) for r in flags.collect()] == [("甲", "工作97天"), ("无", "工作3天"), (None, None), ("无", "工作99天")]
    text = df.select(*coded.fact_text({"g": [coded.labelled("性别", coded.label_of("sex", labels["sex"])), F.lit(None).cast("string")]}))
    assert [r["g"] for r in text.collect()] == ["性别：男", None, None, None]


def test_children(spark):
    rows = [("h1", 2, 5), ("h1", 1, 1), ("h1", 3, 2), ("h2", 1, 77)]
    got = merge.first_children(spark.createDataFrame(rows, "household_id string, child_no int, contact int"))
    said = catalogs.template(fixtures.CHILD, lambda name: F.col(f"c.{name}"), catalogs.dictionary_labels(fixtures.catalogs(spark)["labels"]))
    each = got.select("household_id", F.posexplode("children").alias("i", "c")).select("household_id", "i", said.alias("t"))
    assert sorted(map(tuple, each.collect())) == [("h1", 0, "子女1，联系几乎每天"), ("h1", 1, "子女2，联系每月一次"), ("h2", 0, "子女1")]


def test_repeated_columns_equal_the_long_form(spark):
    rows = [("h1", None, 3, 4, 5), ("h2", 1, None, None, None), ("h3", None, None, None, None), ("h4", 1, 2, 3, 4)]
    wide = spark.createDataFrame(rows, "household_id string, a1 int, a2 int, a3 int, a4 int")
    slots = [{"contact": f"a{i}"} for i in range(1, 5)]
    made = wide.select("household_id", coded.repeated_groups(slots, "child_no", 2).alias("children"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["household_id"]: [(c["child_no"], c["contact"]) for c in r["children"]] for r in made.collect()}
    long = wide.unpivot("household_id", ["a1", "a2", "a3", "a4"], "name", "contact").filter("contact IS NOT NULL")
    long = merge.first_children(long.select("household_id", F.substring("name", 2, 1).cast("int").alias("child_no"), "contact"))
    assert got == {"h3": []} | {r["household_id"]: [(c["child_no"], c["contact"]) for c in r["children"]] for r in long.collect()}


def facts(spark, n=5):
    cols = ", ".join(f"{g} string" for g in GROUPS)
    return spark.createDataFrame([(i, f"p{i % 3}", *(f"{g}{i}" for g in GROUPS)) for i in range(1, n + 1)], f"sample_pick_order int, id string, {cols}")


def test_steps(spark):
    one = steps.unique_ids(facts(spark))
    assert sorted((r["id"], r["sample_pick_order"], r["pick_count"]) for r in one.collect()) == [("p0", 3, 1), ("p1", 1, 2), ("p2", 2, 2)]
    first = steps.step_inputs(one, "personality").first()["payload"]
    assert "health" not in first and "children" not in first

    def generator(step):
        def run(ids, payloads):
            return pd.DataFrame({"text": [f"{step}:{len(p)}" for p in payloads], "error": ["no" if step == "worries" and i == "p1" else None for i in ids]})

        return run

    done, errors = steps.run_steps(one, {s: generator(s) for s in STEPS}, Ledger(spark, stage_folder(spark, "ledger")))
    assert ids(done) == ["p0", "p2"] and done.columns == ["id", *STEPS]
    assert [tuple(r) for r in errors.collect()] == [("p1", "worries", "no")]
    assert ids(steps.missing_ids(one, done)) == ["p1"]
    last = steps.step_inputs(one.select("*", *(F.lit("up").alias(s) for s in STEPS)), "anchors").first()["payload"]
    assert not any(g in last for g in GROUPS)


def test_slices(spark):
    df = facts(spark, 9)
    for cut in (steps.slice_users, steps.slice_dense):
        assert sorted(r["sample_pick_order"] for r in cut(df, 2, 3).collect()) == [3, 4, 5]
        assert cut(df, 100, 3).count() == 0


def test_dialogs(spark):
    rows = [("m", "1", 1, "user", "q1"), ("m", "1", 2, "assistant", "a1"), ("m", "1", 3, "user", "q2"), ("m", "2", 1, "assistant", "hi"), ("m", "2", 2, "user", "q")]
    turns = spark.createDataFrame(rows, "profile string, run_id string, turn long, role string, text string")
    paired = dialogs.rounds(turns)
    assert sorted(map(tuple, paired.select("run_id", "round_no", "user_text", "reply_text").collect()), key=str) == [("1", 1, "q1", "a1"), ("1", 2, "q2", None), ("2", 1, "q", None)]
    assert dialogs.cap_rounds(paired, 1).count() == 2
    status = {r["run_id"]: (r["n_rounds"], r["n_answered"], r["complete"]) for r in dialogs.run_status(paired, 1).collect()}
    assert status == {"1": (2, 1, True), "2": (1, 0, False)}
    assert {r["run_id"]: r["transcript"] for r in dialogs.transcripts(turns).collect()}["1"] == "user: q1\nassistant: a1\nuser: q2"


def test_scores_and_results(spark, tmp_path):
    rows = [("m", "1", '{"user": {"warm": 4}, "eval": 3}'), ("m", "2", '{"user": {"warm": "bad"}}'), ("manual", "1", '{"user": {"warm": 2}}'), ("m", "3", "broken")]
    results = spark.createDataFrame(rows, "profile string, run_id string, result string")
    writers.write_results(results, f"{tmp_path}/out")
    schema = results.drop("profile").schema
    back = readers.read_results(spark, f"{tmp_path}/out", schema)
    assert {r["profile"] for r in back.collect()} == {"m"} and back.count() == 3
    assert readers.read_results(spark, f"{tmp_path}/out", schema, include_manual=True).count() == 4
    assert readers.read_results(spark, f"{tmp_path}/out", schema, profile="manual").count() == 1
    assert readers.read_results(spark, f"{tmp_path}/out", schema, profile="nobody").count() == 0
    long = scores.extract_scores(results, {"warm": "$.user.warm", "eval": "$.eval"})
    means = {(r["profile"], r["dimension"]): (r["mean_score"], r["n"], r["n_missing"]) for r in scores.mean_scores(long).collect()}
    assert means == {("m", "warm"): (4.0, 1, 2), ("m", "eval"): (3.0, 1, 2), ("manual", "warm"): (2.0, 1, 0), ("manual", "eval"): (None, 0, 1)}
    summary = {r["profile"]: (r["warm"], r["eval"]) for r in scores.score_summary(long, ["warm", "eval"]).collect()}
    assert summary == {"m": (4.0, 3.0), "manual": (2.0, None)}


def test_round_trips(spark, tmp_path):
    rows = [(2, "01", *['say "x", y\nz；、中文' for _ in GROUPS]), (1, "02", *[None for _ in GROUPS])]
    df = spark.createDataFrame(rows, facts(spark).schema)
    writers.write_csv(df, f"{tmp_path}/f", "sample_pick_order")
    assert sorted(map(tuple, readers.read_facts(spark, f"{tmp_path}/f").collect()), key=str) == sorted(rows, key=str)
    writers.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/j").collect()), key=str) == sorted(rows, key=str)
    survey = spark.createDataFrame([("007", float("nan")), ("08", 1.0)], "id string, w double")
    writers.write_stage(survey, f"{tmp_path}/s/Weights.parquet")
    assert {r["id"]: r["w"] for r in readers.read_survey(spark, f"{tmp_path}/s", "Weights", survey.schema).collect()} == {"007": None, "08": 1.0}
    writers.write_csv(fixtures.catalogs(spark)["fields"], f"{tmp_path}/c")
    assert readers.read_catalog(spark, f"{tmp_path}/c").count() == len(fixtures.CATALOG)


def test_ordered_csv_groups_and_score_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'x "{i}", ü\ny') for i in (5, 3, 9, 1, 7)], "k int, t string")
    writers.write_csv(rows, f"{tmp_path}/ordered", "k")
    parts = sorted((tmp_path / "ordered").glob("part-*.csv"))
    read = [r["k"] for p in parts for r in readers.read_sample(spark, str(p), rows.schema).collect()]
    assert read == [1, 3, 5, 7, 9]
    for name, df in fixtures.catalogs(spark).items():
        writers.write_csv(df, f"{tmp_path}/{name}.csv")
    for name, df in jobs.read_catalogs(spark, str(tmp_path)).items():
        assert sorted(map(str, df.collect())) == sorted(str(r).replace("''", "None") for r in fixtures.catalogs(spark)[name].collect()), name
    scored = spark.createDataFrame([("p", "r", "d", 1.5), ("p", "r", "e", None)], "profile string, run_id string, dimension string, score double")
    for form, back in (("csv", lambda p: readers.read_sample(spark, p, scored.schema)), ("parquet", spark.read.parquet)):
        writers.write_scores(scored, f"{tmp_path}/scores-{form}", form)
        assert sorted(map(str, back(f"{tmp_path}/scores-{form}").collect())) == sorted(map(str, scored.collect()))

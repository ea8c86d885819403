"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import decontam, langid, linededup, mixing, pii, quality, simhash, substring, suffix, toxicity

BENCHMARK = "item_id long, text string, answer string"
LABELS = "doc_id long, quality int, toxic int"
#: Names that the operators use inside or return.
CLASHING = ["key", "a", "s", "n", "d", "at", "fp", "first", "root", "size", "_source", "_hash", "_text", "_key", "fold", "term", "features", "score", "spans", "kept", "mask", "copies", "target", "words", "parts", "u", "v", "node", "h", "l", "k"]


def weird(spark):
    r = random.Random(2)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60_000))
    rows = [(1, "Hello there world", "en", "a"), (1, "Hello there world", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "null id text here", "fr", "b"), (None, None, None, None)]
    rows += [(4, " \n\t\n ", "de", "b"), (5, long, "en", "a"), (6, long, "en", "a"), (7, "x", "en", None), (1, "same id, other text", "fr", "c"), (8, "!!! 123 ???", None, "c"), (-9, "日本語のテキスト \U0001f600", "ja", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit("clash").alias(c) for c in CLASHING)), rows


def operators(spark, empty_side):
    labels = spark.createDataFrame([] if empty_side else [(1, 0, 1), (5, 1, 0), (7, 1, None), (None, 1, 1)], LABELS)
    bench = spark.createDataFrame([] if empty_side else [(1, "alpha beta gamma delta", None), (2, None, None), (None, "Hello there world", None)], BENCHMARK)
    return {
        "op1": quality.query,
        "op2": mixing.query,
        "op3": simhash.query,
        "op4": pii.query,
        "op5": lambda d: decontam.query(d, bench),
        "op6": substring.query,
        "op7": linededup.query,
        "op8": suffix.query,
        "op9": lambda d: toxicity.query(d, labels),
        "op10": langid.query,
    }


@pytest.mark.parametrize("op", [f"op{i}" for i in range(1, 11)])
def test_weird_rows_and_clashing_names(spark, op):
    docs, rows = weird(spark)
    got = operators(spark, False)[op](docs).collect()
    if op == "op5":
        assert all(r["doc_id"] in (None, 1, 5, 6) for r in got)
        return
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in rows)
    by = {r["doc_id"]: r for r in got}
    if op == "op3":
        assert by[2]["fingerprint"] == "0" * 16 and by[5]["component_id"] == by[6]["component_id"] == 5 and by[3]["component_id"] == 2
    if op == "op8":
        assert by[5]["n_removed"] == 0 < by[6]["n_removed"] == by[6]["n_bytes"]
    if op == "op6":
        assert by[5]["n_removed"] == by[6]["n_removed"] == 60_000
    if op == "op10":
        assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[8]["lang_pred"] == "und"
    if op == "op9":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    if op == "op7":
        assert by[2]["n_lines"] == by[3]["n_lines"] == 1


@pytest.mark.parametrize("op", [f"op{i}" for i in range(1, 11)])
def test_empty_tables(spark, op):
    docs, _ = weird(spark)
    assert operators(spark, True)[op](docs.limit(0)).collect() == []


def test_no_labels_and_no_benchmark(spark):
    docs, rows = weird(spark)
    assert operators(spark, True)["op5"](docs).collect() == []
    assert {r["score"] for r in operators(spark, True)["op9"](docs).collect()} == {0.0}
    assert {r["lang_pred"] for r in langid.query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}

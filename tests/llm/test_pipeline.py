"""The pipeline's stages on small inputs, each against a plain statement of what it keeps."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import decontam, langid, linededup, mixing, similar
from kinfold.llm.common import stage

from .test_brute_force import plain_lines
from .test_similar import plain_groups


def tables(spark, tmp_path):
    r = random.Random(9)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(5)) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = say(40)
    rows = [(i, "Shared footer line\n" * (i % 2) + say(80), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0"), (101, f"{say(60)} {item} {say(60)}", "en", "s1"), (102, "123 456", "en", "s1"), (103, None, "en", "s2"), (104, rows[4][1] + " tail", "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({x["doc_id"]: x["text"] for x in docs.collect()})
    one, two, three, four = kept
    assert one == {d: t for d, t, *_ in rows if d not in (102, 103)}
    assert two == {d: "\n".join(x) for d, x in plain_lines(list(one.items()), 10).items()} and not any("Shared" in t for t in two.values())
    assert set(three) == set(plain_groups(list(two.items())).values()) and not {100, 104} & set(three)
    assert set(four) == set(three) - {101}
    final = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) <= set(four) and all(x["taken"] == x["size"] * x["copies"] > 0 for x in final.values())
    assert all((x["text"], x["lang"]) == (four[d], "en") for d, x in final.items())


def test_filters_keep_rows_whole(spark):
    rows = [(1, "Some words in a text", "en"), (1, "Some words in a text", "en"), (None, "other words", "en"), (2, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(langid.keep_identified(docs)) == key(docs.filter("text is not null"))
    assert key(linededup.without_common_lines(docs)) == key(docs)
    assert key(similar.keep_first(docs)) == key(docs)
    assert key(decontam.keep_clean(docs, spark.createDataFrame([(1, "nothing like it at all anywhere")], "item_id long, text string"))) == key(docs)


def test_languages_are_learned_from_every_labelled_document(spark):
    """Of 60,000 labelled documents one has letters, and a share of them by their ids' hashes leaves it out: without it no language
    is known and every document goes."""
    left_out = F.xxhash64("doc_id", F.lit("fit")).bitwiseAND(F.lit(0xFFFFFFFF)) > int(0.9 * (1 << 32))
    own = spark.range(100_000, 101_000).withColumnRenamed("id", "doc_id").filter(left_out & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).first()[0]
    few = spark.createDataFrame([(own, "the only words that are labelled", "en"), (-1, "words without a label", None)], "doc_id long, text string, lang string")
    docs = spark.range(80_000).select(F.col("id").alias("doc_id"), F.lit("1 2 3").alias("text"), F.lit("en").alias("lang")).unionByName(few)
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} == {own, -1}


def test_prototypes_are_the_sums_of_all_texts(spark):
    """More n-grams than are added up together, and more distinct ones than are bundled at once; text by text they give the same."""
    r = random.Random(31)
    rows = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyzàéñß ") for _ in range(30_000)), ("fr", "de")[i % 2]) for i in range(40)] + [(50, "", "fr"), (51, "12", "es")]
    got = langid.learn_prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), None)
    table, plain = langid.GramTable(), {}
    for _, text, lang in rows[:40]:
        plain[lang] = plain.get(lang, 0) + table.bundle(*langid.trigrams(text)).astype(float)
    assert list(got) == ["de", "fr"] and all((got[k] == plain[k]).all() for k in got)


def test_leaks_are_weighed_and_fitted_on_every_row(spark, tmp_path, monkeypatch):
    """Rows with null and with equal ids too: each has one benchmark word that no other row has."""
    fitted, svd, counted, count = [], decontam.randomised_svd, [], decontam.document_frequencies
    monkeypatch.setattr(decontam, "randomised_svd", lambda rows, columns, *more: fitted.append(rows.collect()) or svd(rows, columns, *more))
    monkeypatch.setattr(decontam, "document_frequencies", lambda *given: counted.append(count(*given)) or counted[-1])
    items = [(i, " ".join(f"item{i}w{k}" for k in range(30))) for i in range(20)]
    rows = [((None, 7, i)[i % 3], f"item{i // 30}w{i % 30} " + "plain " * (40 * (i % 60)), "en", "s") for i in range(600)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).count() == 600
    (found, n, passages), terms = counted[0], sorted(w for _, text in items for w in text.split())
    assert n == 600 and passages == sum(max(1, -(-len(t.split()) // 20) - 1) for _, t, *_ in rows) and found[1:].tolist() == [1] * len(terms)
    times = [0] * len(terms)
    for row in fitted[0]:
        for c in row["cols"]:
            times[c - 1] += 1
    assert times == [2] * len(terms)  # the item's own row, and the sketch's with the document


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = tables(spark, tmp_path) + [(200, "alpha beta gamma " * 7000, "en", "s0"), (None, "a text without an id", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit(""))).alias(c) for c in ("_key", "_kept", "key", "fp", "a.b")))
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(0), str(tmp_path)).collect() == []
        got = step(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        before = {r["doc_id"]: r for r in docs.collect()}
        for r in got.collect():
            assert all(r[c] == before[r["doc_id"]][c] for c in ("_key", "_kept", "key", "fp", "a.b", "source"))
        assert {200, None} <= {r["doc_id"] for r in got.collect()}
    last = corpus_pipeline.STAGES[-1][1]
    clash = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit(""))).alias(c) for c in ("_row", "copies", "size", "_mix_size", "_taken_row", "_source")))
    assert last(spark, clash.limit(0), str(tmp_path)).collect() == []
    got = last(spark, clash.unionByName(clash), str(tmp_path))  # every row twice
    assert got.columns[: len(clash.columns)] == clash.columns and {"copies_", "size_", "taken"} < set(got.columns)
    for r in got.collect():
        assert r["copies"] == f"copies:{r['text'] or ''}" and r["taken"] == r["copies_"] * r["size_"] and r["size_"] == len((r["text"] or "").split())
    plan = mixing.mix(clash.unionByName(clash)).filter("copies > 0").collect()
    assert sorted((str(r["doc_id"]), r["copies"]) for r in plan) == sorted((str(r["doc_id"]), r["copies_"]) for r in got.collect())

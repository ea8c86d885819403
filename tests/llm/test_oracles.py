"""Whole results of the queries that have no SQL, against plain versions of them."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinfold.llm import langid, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_mixing_takes_the_documents_it_should(spark):
    """Sizes in SQL, targets by sharing out what is above twice a source again and again, documents by rank of their hash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sql = rf"""SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS BIGINT) AS size FROM '{SF}/documents.parquet'"""
    want = duckdb.sql(f"SELECT *, sum(size) OVER (PARTITION BY source) AS source_size FROM ({sql})").df()
    names = sorted(want["source"].dropna().unique()) + ([None] if want["source"].isna().any() else [])
    of = lambda s: want[want["source"].isna()] if s is None else want[want["source"] == s]
    weight, capped, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * want["size"].sum()
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * of(s)["size"].sum()]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * of(s)["size"].sum()
            left -= capped[s]
    target = capped | share
    hashes = dict(map(tuple, docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).collect()))
    taken = {}
    for s in names:
        rows, total = of(s), int(of(s)["size"].sum())
        passes = min(int(target[s] // total), 2)
        lengths = Counter(rows["size"])
        sizes = np.array(sorted(lengths))
        rest = int(round(target[s])) - passes * total
        quota = dict(zip(sizes, mixing.fit(sizes, np.array([lengths[x] for x in sizes]), rest), strict=True)) if rest > 0 and passes < 2 else {}
        for size, group in rows.groupby("size"):
            order = sorted(group["doc_id"], key=lambda d: (hashes[d], d))
            taken |= {d: size * (passes + (k < quota.get(size, 0))) for k, d in enumerate(order)}
    got = mixing.query(docs).toPandas().set_index("doc_id")
    want = want.set_index("doc_id")
    assert len(got) == len(want) and (got["size"] == want["size"]).all() and (got["source_size"] == want["source_size"]).all()
    assert all(math.isclose(got["target"][d], target[None if pd.isna(s) else s]) for d, s in want["source"].items())
    assert got["taken"].to_dict() == taken


def plain_grams(text):
    runs = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
    runs = "".join(c if c.isalpha() else " " for c in runs)
    runs = re.sub(r" +", " ", runs)
    return Counter(runs[i : i + 3] for i in range(len(runs) - 2)) if runs.strip() else Counter()


def plain_bundle(grams):
    code = lambda c: 0 if c == " " else ord(c)
    out = np.zeros(langid.DIMENSIONS)
    for (a, b, c), n in grams.items():
        bound = [langid.letter_vector(code(x)) for x in (a, b, c)]
        out += n * np.array([bound[0][i - 2] * bound[1][i - 1] * bound[2][i] for i in range(langid.DIMENSIONS)])
    return out


def test_languages_by_plain_bundles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang")
    rows = [tuple(r) for r in docs.collect()] + [(1000, None, None), (1001, " 12 !", "en"), (1002, "x", None)]
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows}
    bundles = {d: plain_bundle(plain_grams(t)) for d, t, _ in rows}
    sums = {}
    for d, _, lang in rows:
        if lang is not None and not held[d]:
            sums[lang] = sums.get(lang, 0) + bundles[d]
    names = sorted(sums)
    got = langid.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == held
    for r in got:
        v = bundles[r["doc_id"]]
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosines = [v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n]) for n in names]
        best = max(cosines)
        assert abs(r["score"] - min(1.0, max(0.0, best))) < 1e-5 and cosines[names.index(r["lang_pred"])] > best - 1e-5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_hit(word, terms):
    whole = {t: w for t, w in terms.items() if not t.endswith("*")}
    if word in whole:
        return whole[word], "exact"
    stems = [w for t, w in terms.items() if t.endswith("*") and len(t) - 1 in toxicity.PREFIXES and word.startswith(t[:-1]) and len(word) > len(t) - 1]
    if stems:
        return max(stems), "stem"
    near = [w for t, w in whole.items() if len(t) >= toxicity.FUZZY_LENGTH and edits(word, t) == 1]
    return (max(near), "fuzzy") if near else (0.0, None)


def plain_features(text, terms):
    tokens = re.findall(rf"[^\W\d_]+|[{toxicity.QUOTES}]", (text or "").lower())
    marks = [i for i, t in enumerate(tokens) if t in toxicity.QUOTES]
    sums, hits = Counter(), []
    for i, t in enumerate(tokens):
        weight, how = (0.0, None) if t in toxicity.QUOTES else plain_hit(t, terms)
        if not how:
            continue
        before = [m for m in marks if m < i]
        after = [m for m in marks if m > i]
        inside = len(before) % 2 == 1 and after and after[0] - before[-1] <= 4 * toxicity.WINDOW
        if inside or any(x in toxicity.REPORTING for x in tokens[max(0, i - toxicity.WINDOW) : i]):
            sums["quoted"] += weight
        else:
            sums[how] += weight
            hits.append((i, t, weight))
    n = max(1, len(tokens) - len(marks))
    dense = max((sum(w for j, _, w in hits if i - 4 * toxicity.WINDOW <= j <= i) for i, _, _ in hits), default=0.0)
    kinds = sum({t: w for _, t, w in hits}.values())
    values = [sums["exact"], sums["stem"], sums["fuzzy"], sums["quoted"], 100 * sums["exact"] / n, 100 * (sums["stem"] + sums["fuzzy"]) / n, dense, kinds]
    return [math.log1p(x) for x in values] + [float(sums["exact"] + sums["stem"] + sums["fuzzy"] > 0)]


def test_toxicity_scores_of_a_given_lexicon(spark):
    r = random.Random(6)
    terms = {"grubar": 3.0, "zonk": 2.5, "vilest": 1.5, "vile*": 1.0, "grub*": 0.5, "plonker": 2.0, "plonkar": 2.25}
    pool = ["grubar", "grubbar", "grbar", "zonk", "zonks", "vilest", "vilely", "grubby", "plonkes", "plonkor", "the", "said", "calm", "word", '"', "„", "fine", "house", "12"]
    texts = [None, "", '"', '" zonk', "zonk " * 300] + [" ".join(r.choices(pool, k=r.randrange(1, 120))) for _ in range(80)]
    weights = [0.3, -0.2, 0.5, -0.7, 0.1, 0.2, 0.4, 0.15, 1.0, -2.0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, (terms, weights)).collect()}
    for i, text in enumerate(texts):
        total = sum(w * x for w, x in zip(weights, [*plain_features(text, terms), 1.0], strict=True))
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9, text

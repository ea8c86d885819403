"""The trie of conversation prefixes against a plain one, and its edges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinfold.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            sign = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, sign, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 * (1 if c >= 0 else -1))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes: dict[tuple, list[int]] = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children: dict[tuple, int] = {}
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    return sorted((tuple(r) for r in prefixtrie.query(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed, words", [(1, 1), (2, 2), (3, 3)])
def test_equals_a_plain_trie(spark, seed, words):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 200), 90):
        rows += [(c, t, r.choice("ua"), r.choice(["é", "b", "cc"][:words])) for t in range(r.choice([1, 2, 3, 7, 12, 40]))]
    r.shuffle(rows)
    assert made(spark, rows) == plain(rows)


def test_equal_conversations_one_long_one_and_weird_rows(spark):
    rows = [(c, t, "user", "the same") for c in range(0, 300, 5) for t in range(3)]
    rows += [(1001, t, "user", "long" * (t % 3)) for t in range(700)]
    rows += [(None, 0, "user", "no id"), (2, None, None, None), (2, None, None, None), (2, 0, "user", "x" * 100_000), (3, 1, "", "a"), (3, 1, "b", "a"), (3, 1, "", "ba"), (7, 0, "user", "")]
    assert made(spark, rows) == plain(rows)


def test_empty_and_clashing_names(spark):
    rows = [(5, 0, "user", "a"), (6, 0, "user", "a"), (11, 0, None, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert prefixtrie.query(df.limit(0)).collect() == []
    clash = df.select("*", *(F.lit("clash").alias(c) for c in ("conv", "pos", "sign", "bytes", "part", "name", "root", "depth", "len", "weight", "base", "h", "ups", "_up", "tree")))
    got = sorted((tuple(r) for r in prefixtrie.query(clash).select(*COLUMNS).collect()), key=str)
    assert got == plain(rows)


def test_names_take_as_many_jobs_as_cuts(spark, monkeypatch):
    """A chain of 1,000 turns is named in 10 levels, and what conversations share is one entry above each cut."""
    labels = []
    keep = prefixtrie.stage
    monkeypatch.setattr(prefixtrie, "stage", lambda df, label: labels.append(label) or keep(df, label))
    rows = [(c, t, "user", str(t)) for c in (1, 2) for t in range(1_000)]
    convs, turns = prefixtrie.rebuilt(spark.createDataFrame(rows, SCHEMA), 1, 1)
    cuts = prefixtrie.named(convs, turns, 10)
    assert labels.count("cuts") == 10
    assert cuts.filter("depth < 512").count() == 511
    assert cuts.filter("depth = 512").count() == 2

"""Near duplicates at a similarity against all pairs of small tables."""

import random

import numpy as np
import pytest

from kinfold.llm import similar

TEXT = "doc_id long, text string"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def plain_groups(rows, similarity=0.8):
    sets = [(d, plain_set(t)) for d, t in rows]
    group = {d: d for d, _ in rows}
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) >= similarity * len(x | y)]
    for _ in rows:
        before = dict(group)
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            return group


def say(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def changed(r, words, edits):
    words = list(words)
    for p in r.sample(range(len(words)), edits):
        words[p] = "x" + words[p]
    return words


def groups(spark, rows):
    return {x["doc_id"]: x["component_id"] for x in similar.similar_groups(spark.createDataFrame(rows, TEXT)).collect()}


def test_near_copies_link_and_others_do_not(spark):
    r, rows = random.Random(4), []
    for i in range(60):
        words = say(r, r.randrange(150, 400))
        rows += [(i, " ".join(words)), (100 + i, " ".join(changed(r, words, len(words) // 100))), (200 + i, " ".join(changed(r, words, len(words) // 12)))]
    rows += [(400, rows[0][1].upper()), (401, None), (402, ""), (403, " \t"), (404, "two words"), (405, "Two  words"), (406, "a long text " * 9000)]
    assert groups(spark, rows) == plain_groups(rows)


def test_recall_at_the_threshold(spark):
    """Pairs of similarities from 0.8 to 0.86."""
    r, rows, pairs = random.Random(8), [], []
    while len(pairs) < 150:
        words = say(r, 300)
        copy = changed(r, words, 6)
        a, b = plain_set(" ".join(words)), plain_set(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.86:
            i = len(pairs)
            rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
            pairs.append((i, 1000 + i))
    got = groups(spark, rows)
    assert sum(got[b] == a for a, b in pairs) >= 0.9 * len(pairs)
    assert len(set(got.values())) >= len(pairs)


def test_unrelated_texts_do_not_meet(spark, monkeypatch):
    """Lists of 24 bits alone gave about 1,700 and 27,000 rows by chance here, 16 times as many for 4 times the texts."""
    met, write = [], similar.stage
    monkeypatch.setattr(similar, "stage", lambda df, label: met.append(write(df, label).count()) or write(df, label) if label == "met" else write(df, label))
    r = random.Random(12)
    for n in (3_000, 12_000):
        rows = [(i, " ".join(say(r, 30))) for i in range(n)]
        assert groups(spark, rows) == {i: i for i in range(n)}
    assert len(met) == 2 and max(met) <= 10


@pytest.mark.parametrize("piece", [8192, 300])
def test_large_group(spark, piece, monkeypatch):
    """900 near copies of one text, of which few are similar to each other, become one group, and the rest stays apart."""
    monkeypatch.setattr(similar, "PIECE", piece)
    r = random.Random(3)
    words = say(r, 300)
    rows = [(0, " ".join(words))] + [(i, " ".join(changed(r, words, 4))) for i in range(1, 901)] + [(i, " ".join(say(r, 200))) for i in range(1000, 1040)]
    got = groups(spark, rows)
    assert sum(got[i] == 0 for i in range(901)) >= 0.98 * 901
    assert all(got[i] == i for i in range(1000, 1040))


@pytest.mark.parametrize("copies", [30, 100, 2_000])
def test_copies_of_one_text_whatever_their_number(spark, copies):
    """Six of 300 words changed: each copy has a similarity of 0.8 or more with the original, hardly any with another copy."""
    r = random.Random(copies)
    words = say(r, 300)
    whole, rows = plain_set(" ".join(words)), [(0, " ".join(words))]
    while len(rows) <= copies:
        text = " ".join(changed(r, words, 6))
        own = plain_set(text)
        if len(whole & own) >= 0.8 * len(whole | own):
            rows.append((len(rows), text))
    got = groups(spark, rows)
    assert sum(got[i] == 0 for i in range(1, copies + 1)) >= 0.95 * copies


def test_spanning_forest():
    r = np.random.default_rng(2)
    for _ in range(50):
        u, v, cost = r.integers(0, 30, 60), r.integers(0, 30, 60), r.integers(0, 9, 60)
        u, v, cost = (x[u != v] for x in (u, v, cost))
        label, total, count = list(range(30)), 0, 0
        for i in np.argsort(cost, kind="stable"):
            a, b = label[u[i]], label[v[i]]
            if a != b:
                label, total, count = [a if x == b else x for x in label], total + cost[i], count + 1
        kept = similar.spanning_forest(u, v, cost)
        assert (len(kept), cost[kept].sum()) == (count, total)


def test_fingerprint():
    hashes = similar.shingle_set("one two three four five six one two three four five")
    assert len(hashes) == 6 and similar.fingerprint(np.zeros(0, np.uint64)) == bytes(64)
    many = np.arange(10_000, dtype=np.uint64)
    part = np.frombuffer(similar.fingerprint(many), np.uint8)
    assert 150 < np.bitwise_count(part).sum() < 362
    assert similar.fingerprint(hashes[:1]) != similar.fingerprint(hashes[1:2])


def test_rows_without_ids_and_with_equal_ids(spark):
    r = random.Random(5)
    one, two = " ".join(say(r, 50)), " ".join(say(r, 50))
    rows = [(None, one), (None, None), (3, one), (3, one), (5, one), (7, two), (7, two), (8, None), (9, "")]
    kept = sorted((x["doc_id"] or 0, x["text"] or "") for x in similar.keep_first(spark.createDataFrame(rows, TEXT)).collect())
    assert kept == sorted([(0, one), (0, ""), (3, one), (3, one), (7, two), (7, two), (8, "")])
    assert similar.keep_first(spark.createDataFrame([], TEXT)).count() == 0


def test_a_pair_whose_forest_leads_through_another_text(spark):
    """By bits a and b are nearer to c than to each other; exactly they are alike, and neither is like c."""
    r = random.Random(17)
    words = say(r, 300)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed(r, words, 2))), (3, " ".join(say(r, 300)))], TEXT)
    c = np.random.default_rng(5).integers(0, 2, 512, dtype=np.uint8)
    a, b = c.copy(), c.copy()
    a[:60] ^= 1
    b[45:105] ^= 1
    least = bytes(range(64))
    nodes = [(n, np.packbits(x).tobytes(), least) for n, x in ((1, a), (2, b), (3, c))]
    found = similar.links(docs, spark.createDataFrame(nodes, "node long, fp binary, least binary")).collect()
    assert {(x["u"], x["v"]) for x in found} == {(1, 2)}


def test_no_pair_of_a_list_is_left_out(spark, monkeypatch):
    """Lists in pieces; copies around the threshold, without their original: as all pairs of all lists that pass the limit of bits, each checked exactly."""
    monkeypatch.setattr(similar, "PIECE", 150)
    r, rows = random.Random(21), []
    for family in range(2):
        words = say(r, 300)
        rows += [(1000 * family + i, " ".join(changed(r, words, 4))) for i in range(200)]
    docs = spark.createDataFrame(rows, TEXT)
    sets, made = {d: plain_set(t) for d, t in rows}, similar.sketches(docs).collect()
    nodes, fps = np.array([x["doc_id"] for x in made]), np.frombuffer(b"".join(x["fp"] for x in made), np.uint8).reshape(-1, 64)
    least = np.frombuffer(b"".join(x["least"] for x in made), np.uint64).reshape(-1, 8)
    most = int(similar.expected_bits(0.8) + 2.5 * similar._spread(0.8))
    group = {d: d for d in sets}
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(nodes)):
        same = fps[i + 1 :] == fps[i]
        both = (least[i + 1 :] == least[i])[:, np.arange(similar.LISTS) % 8] & same[:, similar._CHOICES].all(2)
        near = both.any(1) & (same.sum(1) >= 8) & (np.unpackbits(fps[i + 1 :] ^ fps[i], axis=1).sum(1) <= most)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            x, y = sets[a := int(nodes[i])], sets[b := int(nodes[j])]
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                group[high] = low
    assert groups(spark, rows) == {d: find(d) for d in sets}

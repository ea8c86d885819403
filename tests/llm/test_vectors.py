"""Hard negatives against brute force, neighbours against brute force by recall, and the edges of both."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import hardneg, nearest
from kinfold.llm.vectors import matrix

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims)) / math.sqrt(dims)
    x = centres[rng.integers(0, 5, n)] + rng.standard_normal((n, dims)) / (2 * math.sqrt(dims))
    x[:copies] = x[0]
    return [(i, [float(c) for c in v.astype(np.float32)], int(rng.integers(0, 10))) for i, v in enumerate(x)]


def mined(rows):
    """What the contract says, pair by pair."""
    use = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in v])
        use[i] = min(use.get(i, row), row)
    out = []
    for a, (own, v) in use.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, label) for i, (label, w) in use.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2] == own][:5]:
            fits = [s for s in scored if s[2] != own and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("dims, copies, blocks", [(16, 0, None), (6, 300, (50, 100)), (1, 0, (50, 100)), (3, 40, (7, 7))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dims, copies, blocks):
    if blocks:
        monkeypatch.setattr(hardneg, "CANDIDATES", blocks)
        monkeypatch.setattr(hardneg, "ANCHORS", 2)
    rows = clustered(900, dims, dims, copies)
    got = hardneg.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == mined(rows)


def test_hard_negatives_of_weird_rows(spark):
    rows = clustered(150, 4, 1)
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf")] * 4, 2), (204, [1.0] * 4, None)]
    rows += [(300, [0.0] * 4, 3), (301, [1.0, 1.0], 3), rows[5], (6, [0.25] * 4, 0), (-100, [0.5] * 4, 3), (302, [], 4)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in ("id", "z", "anchor", "windows", "_c", "_a", "rank", "n")))
    got = hardneg.query(df)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined(rows)
    assert hardneg.query(df.limit(0)).collect() == []
    assert hardneg.query(df.filter("vec_id % 100 <> 0")).collect() == []


def test_a_walk_stops_early_and_misses_nothing():
    rng = np.random.default_rng(3)
    z = rng.integers(-20, 20, (4_000, 3))
    z[:30] *= 12
    lists, anchor = hardneg._lists(z), np.array([5, -3, 0])
    met = 0
    for fresh, scores, most in hardneg._walk(z, lists, anchor):
        met += len(fresh)
        assert (scores == z[fresh] @ anchor).all()
        if most is not None and most < np.sort(scores)[-5]:
            break
    assert met < 1_000  # of 4,000


def exact(rows, k=20):
    use = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v):
            use[i] = min(use.get(i, v), v)
    out = {}
    for q, v in use.items():
        if q % 20 == 0:
            out[q] = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in use.items() if i != q)[:k]
    return out


@pytest.mark.parametrize("n, dims, copies, points", [(1_500, 24, 0, None), (1_500, 12, 500, (100, 200)), (300, 2, 0, (20, 40)), (15, 5, 3, None)])
def test_neighbours_have_the_recall(spark, monkeypatch, n, dims, copies, points):
    if points:
        monkeypatch.setattr(nearest, "POINTS", points)
        monkeypatch.setattr(nearest, "QUERIES", 7)
    rows = clustered(n, dims, n + dims, copies)
    rows = [(i, [c * (1 + i % 3) for c in v], label) for i, v, label in rows]  # norms differ
    want = exact(rows)
    got: dict[int, list] = {}
    for r in nearest.query(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = {i: v for i, v, _ in rows}
    hits = total = 0
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, min(20, n - 1) + 1)) and q not in {f[1] for f in found}
        f32 = lambda i: np.array(vectors[i], np.float32).astype(float)
        assert all(abs(s - f32(q) @ f32(i)) < 1e-9 for _, i, s in found)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
        total += len(want[q])
    assert hits / total >= 0.95


def test_few_candidates_are_all_returned(spark, monkeypatch):
    """However far they lie, and over several blocks."""
    monkeypatch.setattr(nearest, "POINTS", (2, 4))
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (-1) ** i * rng.standard_normal(6) * 10.0 ** (i % 4)], 0) for i in range(0, 380, 20)]
    got = nearest.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 19 * 18 and all(len({r["vec_id"] for r in got if r["query_id"] == q}) == 18 for q, *_ in rows)


def test_neighbours_of_weird_rows(spark):
    rows = clustered(60, 4, 9)
    rows += [(None, [1.0] * 4, 1), (100, None, 1), (120, [1.0, None, 0.0, 0.0], 1), (140, [float("nan")] * 4, 1), (160, [float("inf")] * 4, 2), (180, [0.0] * 4, 3)]
    rows += [(200, [1.0, 1.0], 3), rows[5], (6, [0.25] * 4, 0), (-20, [0.5] * 4, None), (302, [], 4), (220, [1e30] * 4, 1)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in ("id", "v", "p", "q", "part", "salt", "bound", "query", "ids", "rank", "score")))
    got = {}
    for r in nearest.query(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = exact([(i, [float(np.float32(c)) if c is not None else None for c in v] if v is not None else None, x) for i, v, x in rows])
    assert set(got) == set(want) >= {-20, 0, 200, 220}
    assert sum(len({*got[q].values()} & {i for _, i in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert nearest.query(df.limit(0)).collect() == [] and nearest.query(df.filter("vec_id % 20 <> 0")).collect() == []


def test_chi_square_and_the_upper_tree():
    assert abs(nearest.chi_square(15.507, 8) - 0.95) < 1e-4 and abs(nearest.stop_at(0.95, 8) - 15.5073) < 1e-3
    points = np.random.default_rng(1).standard_normal((4_000, nearest.PROJECTED))
    parts = nearest.UpperTree(points, 4).part(points)
    assert set(parts) == set(range(16)) and max(np.bincount(parts)) <= 260
    block = nearest.BlockTree(points)
    assert sorted(block.order) == list(range(4_000)) and max(block.ends - block.begins) <= nearest.LEAF
    import pandas as pd

    assert matrix(pd.Series([[1.0], [2.0, 3.0], []]), float, 2).tolist() == [[1, 0], [2, 3], [0, 0]]


def test_projections_are_stable():
    """Squared projected distances over squared distances follow the chi-square distribution, over all projections."""
    gaps = np.random.default_rng(4).standard_normal((500, 30))
    within = [((gaps @ nearest.projection(29, seed=s)) ** 2).sum(1) / (gaps**2).sum(1) < nearest.stop_at(0.9) for s in range(60)]
    assert abs(np.mean(within) - 0.9) < 0.02

"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Candidates and anchors are dealt into blocks, and every block of anchors meets every block of
candidates in a task of its own. There each dimension has the candidates in the order of their
component. An anchor walks down the lists where its own component is positive and up those where
it is negative, all at the same depth; each row met for the first time is scored whole by random
access. The components at that depth, times the anchor's, add up to the threshold: no row that
the walk has not met can score more. The walk ends once the threshold lies strictly below the kth
score of each window (equal scores could still win by a smaller id), below the least score that
the window admits, or when all rows were met. The first rows of the blocks are then merged.

A first pass finds the positives over the lists of the anchor's label, a second the negatives over
the lists of all labels, with one window for each positive.

Edge cases. A row without id, label or vector, or with a null, NaN or infinite component, takes no
part. Rows that repeat an id count once, the one with the smallest label, then vector. A vector
that is shorter than others has zeros for what it lacks. Equal scores rank by the smaller id. A
positive with a score below zero admits no negative (its window is empty). No rows, no anchors or
no positives give an empty result. Columns other than id, vector and label are never read, so
their names don't matter. Components beyond 32 bits and scores beyond 63 are arithmetic errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage
from .vectors import block_of, finite, matrix, n_blocks, one_per_id

POSITIVES = 5
NEGATIVES = 5
#: Percent of the positive's score that a negative must have at least, and may have at most.
WINDOW = (80, 100)
#: Least and most rows of a block of candidates, and most of a block of anchors.
CANDIDATES = (2_048, 65_536)
ANCHORS = 4_096
#: Depth of a walk's first step; each step is as deep as all before it.
FIRST = 64


def _walk(z: np.ndarray, lists: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """Rows met by each step, their scores, and the most that a row not met yet can score (None: all were met).
    ``lists``: of each dimension, the rows in ascending order of the component."""
    n, up, down = len(z), np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
    if not n:
        return
    if not len(up) + len(down):
        yield np.arange(n), np.zeros(n, np.int64), None
        return
    met = np.zeros(n, bool)
    depth = 0
    while depth < n:
        to = min(n, 2 * depth or FIRST)
        before = met.copy()
        met[lists[up, depth:to].ravel()] = True
        met[lists[down, n - to : n - depth].ravel()] = True
        fresh = np.flatnonzero(met != before)
        depth = n if met.all() else to
        most = int(anchor[up] @ z[lists[up, to - 1], up] + anchor[down] @ z[lists[down, n - to], down])
        yield fresh, z[fresh] @ anchor, None if depth == n else most


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _lists(z: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.argsort(z, axis=0, kind="stable").T.astype(np.int32))


def _sides(pdf: pd.DataFrame, dims: int) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]:
    """Candidates and anchors of a cell with their matrices. Scores must fit 63 bits."""
    z = matrix(pdf["z"], np.int64, dims)
    if len(z) and int(np.abs(z).max()) ** 2 * dims >= 1 << 63:
        raise OverflowError("an inner product may not fit 63 bits")
    left = pdf["windows"].isna().to_numpy()
    return pdf[left], z[left], pdf[~left], z[~left]


def _positives(dims: int, k: int):
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, z, anchors, a = _sides(pdf, dims)
        ids, labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        own = anchors["label"].to_numpy(np.int64)
        for label in np.unique(own):
            at = np.flatnonzero(labels == label)
            z_, ids_ = z[at], ids[at]
            lists = _lists(z_)
            for i in np.flatnonzero(own == label):
                anchor_id = int(anchors["id"].iat[i])
                scores, found_ids = np.empty(0, np.int64), np.empty(0, np.int64)
                for fresh, new, most in _walk(z_, lists, a[i]):
                    other = ids_[fresh] != anchor_id
                    scores, found_ids = np.append(scores, new[other]), np.append(found_ids, ids_[fresh[other]])
                    best = _first(scores, found_ids, k)
                    scores, found_ids = scores[best], found_ids[best]
                    if most is not None and len(scores) == k and most < scores[-1]:
                        break
                out.append((np.full(len(scores), anchor_id), found_ids, scores))
        return _frame(out, ["anchor_id", "positive_id", "positive_score"])

    return found


def _negatives(dims: int, k: int, low: int, high: int):
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, z, anchors, a = _sides(pdf, dims)
        ids, labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        lists, out = _lists(z), []
        for i, (anchor_id, own, windows) in enumerate(zip(anchors["id"], anchors["label"], anchors["windows"], strict=True)):
            bounds = [(int(p), -(-low * int(p) // 100), high * int(p) // 100) for p in windows]
            bounds = [b for b in bounds if b[1] <= b[2]]
            if not bounds:
                continue
            least, largest = min(b[1] for b in bounds), max(b[2] for b in bounds)
            scores, at = np.empty(0, np.int64), np.empty(0, np.int64)
            for fresh, new, most in _walk(z, lists, a[i]):
                fits = (new >= least) & (new <= largest) & (labels[fresh] != own)
                scores, at = np.append(scores, new[fits]), np.append(at, fresh[fits])
                if most is not None and all(most < lo or _kth(scores[(scores >= lo) & (scores <= hi)], k, most) for _, lo, hi in bounds):
                    break
            for p, lo, hi in bounds:
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                best = inside[_first(scores[inside], ids[at[inside]], k)]
                out.append((np.full(len(best), anchor_id), np.full(len(best), p), ids[at[best]], scores[best]))
        return _frame(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return found


def _kth(scores: np.ndarray, k: int, most: int) -> bool:
    """Whether what is not met yet stays strictly below the kth score."""
    return len(scores) >= k and most < np.partition(scores, len(scores) - k)[len(scores) - k]


def _frame(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i, n in enumerate(names)})


def _cells(rows: DataFrame, anchors: DataFrame, across: int, down: int, fn, schema: str) -> DataFrame:
    """``fn`` over every cell of blocks of candidates (``across``) and of anchors (``down``)."""
    left = rows.select("id", "label", "z", F.lit(None).cast("array<bigint>").alias("windows"), block_of("id", across).alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_a"))
    right = anchors.select("id", "label", "z", "windows", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_c"), block_of("id", down).alias("_a"))
    return left.unionByName(right).repartition(across * down, "_c", "_a").groupBy("_c", "_a").applyInPandas(fn, schema)


def _ranked(df: DataFrame, key: list[str], score: str, other: str, k: int) -> DataFrame:
    """The first ``k`` of each key; it has ``k`` rows from each block at most."""
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), other)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where ``anchor``
    holds and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels whose score is within ``window`` percent of the positive's. A score is the inner product of the
    vectors times ``scale``, floored."""
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = df.filter(finite(F.col(vector)) & label.isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("z"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stage(one_per_id(rows, "id", ["label", "z", "anchor"]), "vectors")
    n, n_anchors, dims = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("z"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return df.sparkSession.createDataFrame([], schema)
    across, down = n_blocks(df, n, *CANDIDATES), -(-n_anchors // ANCHORS)
    dims = max(1, dims)

    anchors = rows.filter("anchor").withColumn("windows", F.array().cast("array<bigint>"))
    near = _cells(rows, anchors, across, down, _positives(dims, positives), "anchor_id long, positive_id long, positive_score long")
    near = stage(_ranked(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("windows"))  # as many as positives
    anchors = rows.filter("anchor").join(windows, "id")
    found = _cells(rows, anchors, across, down, _negatives(dims, negatives, *window), "anchor_id long, positive_score long, negative_id long, negative_score long")
    found = _ranked(found, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return near.join(found, ["anchor_id", "positive_score"]).select(*(c.split()[0] for c in schema.split(", ")))


def query(embeddings: DataFrame) -> DataFrame:
    """Every hundredth id is an anchor; every seventh id has the label after its own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(embeddings, F.col("vec_id") % 100 == 0, label=label)


SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label AS label, CAST(list_sum(list_transform(list_zip(a.z, b.z), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, own, other_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, other_id) <= 5
"""

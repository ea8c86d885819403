"""Nearest neighbours by inner product, through low-dimensional stable projections and kd-trees.

Every vector is scaled by the largest norm and lengthened by one component to norm 1, queries are
brought to norm 1 with a zero there; the largest inner product is then the smallest distance.
Gaussian projections to ``PROJECTED`` dimensions are 2-stable: for two points at distance d their
projected squared distance is d^2 times a chi-square variable of that many degrees.

The projected points are indexed by a kd-tree in two tiers: the upper levels, fitted on a bounded
sample, deal all points to parts (a part of too many points to several blocks), and each block has
a tree of its own. A query meets its projected neighbours in growing order and verifies them on the
original vectors. It stops where the squared projected radius passes the chi-square quantile
``STOP`` times the squared distance of its kth find: a point that is nearer than that has been met
with probability ``STOP`` at least. The same test, against the box of a part, tells which parts a
query has to visit once its own part has given a first kth distance. So every true neighbour is
found with probability ``STOP`` at least, whatever the number of parts.

Copies of one vector are one point, with its smallest ids (as many as a result can hold), and
queries with one vector are one search.

Edge cases. A row without id or vector, with a null, NaN or infinite component, or with components
that are all zero takes no part. Rows that repeat an id count once, the one with the smallest vector.
A vector that is shorter than others has zeros for what it lacks. Equal scores rank by the smaller id.
Fewer candidates than k: all are returned. No rows or no queries give an empty result. Other columns
are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage
from .vectors import finite, matrix, one_per_id

K = 20
#: Dimensions of the projection (even, so that the chi-square distribution has a closed form), and its seed.
PROJECTED = 8
SEED = 20_260_602
#: Probability with which a true neighbour is met before a query stops.
STOP = 0.97
#: Points that the upper tree is fitted on at most, and its depth at most. Every point is indexed.
SAMPLE = 20_000
DEPTH = 10
#: Least and most points of a block; queries of a task at most; points of a leaf.
POINTS = (2_048, 65_536)
QUERIES = 4_096
LEAF = 32


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for j in range(1, degrees // 2):
        term *= x / 2 / j
        total += term
    return 1.0 - math.exp(-x / 2) * total


def stop_at(probability: float = STOP, degrees: int = PROJECTED) -> float:
    """The quantile, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < probability else (low, mid)
    return high


def projection(dims: int, degrees: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims + 1, degrees))


class UpperTree:
    """Median splits in heap order; a point's part is the leaf that it falls into."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        inside = [np.arange(len(points))]
        for level in range(depth):
            below = []
            for j, at in enumerate(inside):
                node = (1 << level) + j
                if len(at):
                    self.axis[node] = np.argmax(np.ptp(points[at], axis=0))
                    self.cut[node] = np.median(points[at, self.axis[node]])
                right = points[at, self.axis[node]] > self.cut[node]
                below += [at[~right], at[right]]
            inside = below

    def part(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


class BlockTree:
    """kd-tree over the projected points of a block: the rows of its leaves one after the other, and their boxes."""

    def __init__(self, points: np.ndarray):
        ends, order, todo = [], [], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                order.append(at)
                ends.append(len(at))
                continue
            values = points[at, np.argmax(np.ptp(points[at], axis=0))]
            by = np.argpartition(values, len(at) // 2)
            todo += [at[by[len(at) // 2 :]], at[by[: len(at) // 2]]]
        self.order = np.concatenate(order)
        self.ends = np.cumsum(ends)
        self.begins = self.ends - ends
        self.points = points[self.order]
        self.low, self.high = np.minimum.reduceat(self.points, self.begins), np.maximum.reduceat(self.points, self.begins)


def _outside(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    return (np.maximum(low - point, 0.0) ** 2 + np.maximum(point - high, 0.0) ** 2).sum(axis=1)


def search(tree: BlockTree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, point: np.ndarray, k: int, bound: float, scale: float, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of a block's nearest ``k``. ``vectors`` stand in the order of the tree's rows. A score s is at
    the squared distance 2 - 2 s ``scale``; ``bound`` is a squared distance within which k points are known to lie (infinite
    while none is known: the test then stops nothing, so where there are fewer than k points all are found)."""
    box = _outside(point, tree.low, tree.high)
    leaves = np.argsort(box, kind="stable")
    found, scores = np.empty(0, np.int64), np.empty(0)
    waiting, away = np.empty(0, np.int64), np.empty(0)
    begin, many = 0, 4
    while True:
        wave = leaves[begin : begin + many]
        begin, many = begin + len(wave), 2 * many
        sizes = tree.ends[wave] - tree.begins[wave]
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - tree.begins[wave], sizes)
        waiting, away = np.append(waiting, rows), np.append(away, ((tree.points[rows] - point) ** 2).sum(axis=1))
        radius = box[leaves[begin]] if begin < len(leaves) else math.inf
        # Neighbours by growing projected distance: those within the radius that every leaf so far stands for.
        near = (away <= radius) & (away <= quantile * bound + 1e-9)
        new = waiting[near]
        if len(new):
            found = np.append(found, new)
            scores = np.append(scores, np.einsum("ij,j->i", vectors[new], query))
            best = np.lexsort((ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k:
                bound = min(bound, max(0.0, 2.0 - 2.0 * scores[-1] * scale))
        later = ~near
        waiting, away = waiting[later], away[later]
        if radius > quantile * bound + 1e-9 or begin >= len(leaves):
            return found, scores


def _searcher(dims: int, k: int, largest: float, quantile: float):
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["bound"].notna().to_numpy()
        rows, queries = pdf[~asked], pdf[asked]
        out: dict[str, list] = {"query": [], "point": [], "score": [], "ids": []}
        if len(rows) and len(queries):
            tree = BlockTree(matrix(rows["p"], np.float64, PROJECTED))
            rows = rows.iloc[tree.order]
            vectors, ids, members = matrix(rows["v"], np.float64, dims), rows["id"].to_numpy(np.int64), rows["ids"].to_numpy()
            wanted, points = matrix(queries["v"], np.float64, dims), matrix(queries["p"], np.float64, PROJECTED)
            for i, (name, bound) in enumerate(zip(queries["id"], queries["bound"], strict=True)):
                scale = 1.0 / (largest * math.sqrt(float(wanted[i] @ wanted[i])))
                at, scores = search(tree, vectors, ids, wanted[i], points[i], k, bound, scale, quantile)
                out["query"] += [name] * len(at)
                out["point"] += ids[at].tolist()
                out["score"] += scores.tolist()
                out["ids"] += list(members[at])
        return _objects(out, ["ids"])

    return found


def _objects(columns: dict[str, list], arrays: list[str]) -> pd.DataFrame:
    """A frame whose array columns stay arrays where it has no rows."""
    return pd.DataFrame({c: pd.Series(x, dtype=object) if c in arrays else x for c, x in columns.items()})


def _projected(dims: int, largest: float, tree: UpperTree | None):
    """Adds p (projected), q (projected as a query), and, once there is a tree, part and own (the part it falls into as a query)."""
    lines = projection(dims)

    def run(frames):
        for pdf in frames:
            x = matrix(pdf["v"], np.float64, dims)
            x /= largest
            square = np.einsum("ij,ij->i", x, x)
            tail = np.sqrt(np.maximum(0.0, 1.0 - square))
            points, asked = x @ lines[:-1] + tail[:, None] * lines[-1], (x @ lines[:-1]) / np.sqrt(square)[:, None]
            out = pdf.assign(p=pd.Series(list(points), pdf.index, object), q=pd.Series(list(asked), pdf.index, object))
            if tree is not None:
                out["part"], out["own"] = tree.part(points), tree.part(asked)
            yield out

    return run


def nearest(df: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, stop: float = STOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``asked`` holds the ``k`` other rows with the largest
    inner product, nearest first."""
    schema = "query_id long, rank int, vec_id long, score double"
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.filter(finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), wide.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.filter(F.exists("v", lambda x: x != 0.0))
    rows = stage(one_per_id(rows, "id", ["v", "asked"]), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    n, n_asked, dims, largest = rows.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("v")), F.max(norm)).first()
    if not n_asked:
        return df.sparkSession.createDataFrame([], schema)

    # Copies are one point. Its ids are the k + 1 smallest: one more than a result can hold, for the query's own.
    copies = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k + 1)
    points = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids")
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInPandas(_projected(dims, largest, None), "id long, v array<double>, p array<double>, q array<double>").select("p").toPandas()
    size = min(POINTS[1], max(POINTS[0], -(-n // df.sparkSession.sparkContext.defaultParallelism)))
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n / size)))))
    tree = UpperTree(np.unique(matrix(sample["p"], np.float64, PROJECTED), axis=0), depth)
    placed = stage(points.mapInPandas(_projected(dims, largest, tree), "id long, v array<double>, ids array<long>, p array<double>, q array<double>, part long, own long"), "points")

    # Boxes and sizes of the parts, 2^DEPTH rows at most. A part of more points than a block may have goes to several.
    ends = [f(F.col("p")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(PROJECTED)]
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *ends).toPandas().sort_values("part")
    low, high = (parts[[f"{f}{j}" for j in range(PROJECTED)]].to_numpy() for f in ("min", "max"))
    names, salts = parts["part"].to_numpy(), -(-parts["n"].to_numpy() // POINTS[1])
    cuts = F.create_map(*(F.lit(int(x)) for pair in zip(names, salts, strict=True) for x in pair))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.try_element_at(cuts, F.col("part").cast("int"))).cast("int"))

    quantile = stop_at(stop)
    hits = "query long, point long, score double, ids array<long>"
    searcher = _searcher(dims, k + 1, largest, quantile)
    queries = stage(placed.join(_askers(rows), "v", "left_semi").select("id", "v", F.col("q").alias("p"), "own"), "queries")

    def route(frames, home: bool):
        """The blocks to visit: at home the first of the own part (the nearest part, if that is empty); then all others within reach."""
        for pdf in frames:
            out = {c: [] for c in ("id", "v", "p", "bound", "part", "salt")}
            for row in pdf.itertuples(index=False):
                box = _outside(np.asarray(row.p), low, high)
                own = int(np.argmin(box)) if row.own not in known else known[row.own]
                for j in [own] if home else np.flatnonzero(box <= quantile * row.bound + 1e-9):
                    for salt in range(1 if home else salts[j]):
                        if home or (j, salt) != (own, 0):
                            for c, x in zip(out, (row.id, row.v, row.p, row.bound, names[j], salt), strict=True):
                                out[c].append(x)
            yield _objects(out, ["v", "p"])

    known = {int(x): j for j, x in enumerate(names)}
    visits = "id long, v array<double>, p array<double>, bound double, part long, salt int"
    first = queries.withColumn("bound", F.lit(math.inf)).mapInPandas(lambda frames: route(frames, True), visits)
    first = stage(_meet(placed, first, searcher, hits), "home")
    kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") > k)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    away = F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("least") / (length * largest))
    reach = F.when(F.col("least").isNotNull(), away).otherwise(math.inf)
    other = queries.join(kth, queries["id"] == kth["query"], "left").withColumn("bound", reach).mapInPandas(lambda frames: route(frames, False), visits)
    found = first.unionByName(_meet(placed, stage(other, "visits"), searcher, hits))

    # Points to ids, then the best k + 1 of each search, its own id still among them, then each query that has this vector.
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = found.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k + 1).drop("_r")
    named = placed.select(F.col("id").alias("query"), "v").join(_askers(rows), "v").select("query", "query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = named.join(best, "query").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _askers(rows: DataFrame) -> DataFrame:
    return rows.filter("asked").select(F.col("id").alias("query_id"), "v")


def _meet(points: DataFrame, visits: DataFrame, searcher, schema: str) -> DataFrame:
    """Every block that is visited with its visitors; of more than ``QUERIES`` visitors, parts of them with a copy of the block."""
    many = visits.groupBy("part", "salt").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    left = points.join(many, ["part", "salt"]).select("id", "v", "p", "ids", F.lit(None).cast("double").alias("bound"), "part", "salt", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = visits.join(many, ["part", "salt"]).select("id", "v", "p", F.lit(None).cast("array<long>").alias("ids"), "bound", "part", "salt", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    cells = max(2 * points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return left.unionByName(right).repartition(cells, "part", "salt", "chunk").groupBy("part", "salt", "chunk").applyInPandas(searcher, schema)


def query(embeddings: DataFrame) -> DataFrame:
    """Every twentieth id asks."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0)

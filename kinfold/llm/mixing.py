"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). A source's target is met by whole passes over it
and a rest that is less than one pass; the rest is a bounded knapsack over the lengths: take an even
share of each length, then fit what is left exactly by dynamic programming. Within a length the
documents with the smallest seeded hashes are taken.

Null sources are a source of their own, last in order. Null texts have size 0. Rows with equal ids
and texts have equal hashes; they are told apart by their order in the sort, so that the taken words
stay right. Equal hashes within a length rank by the id. Sizes are exact integers, of whole texts whatever their length. An
empty table gives no row. Columns other than doc_id, text and source, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage, unused, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 11
#: Words that the dynamic programming fits at most.
CAPACITY = 1 << 15
#: Documents of a length that are ranked together at most, about.
RANKED = 20_000
#: Sources are a small list (their sums go to the driver).
MAX_SOURCES = 100_000


def targets(sizes: dict[str | None, int], share: float = SHARE, weights=WEIGHTS, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all words by weight, none above ``most`` times its
    source; what is above is shared again among the others."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY) -> np.ndarray:
    """How many of each length to take so that their sum comes as near to ``budget``, from below, as
    a bounded knapsack over what an even share leaves can bring it."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((take * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # one more of the longest first, until the rest fits the table
        if left <= capacity:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            more = int(min(counts[i] - take[i], max(1, (left - capacity) // max(1, lengths[i]))))
            take[i] += more
            left -= more * int(lengths[i])
    size = min(left, capacity)
    bits = np.zeros(size + 1, bool)
    bits[0] = True
    via = np.full(size + 1, -1, np.int64)  # the item that first reached a sum, and the sum before it
    before = np.zeros(size + 1, np.int64)
    for i in order:
        length, free = int(lengths[i]), int(counts[i] - take[i])
        if not length or length > size or not free or bits[size]:
            continue
        step, free = length, min(free, size // length)
        part = 1
        while free > 0:  # binary parts of the free documents
            part = min(part, free)
            step = part * length
            if step <= size:
                new = bits[: size + 1 - step] & ~bits[step:]
                at = np.flatnonzero(new) + step
                via[at], before[at] = i, at - step
                bits[at] = True
            free -= part
            part *= 2
    at = int(np.flatnonzero(bits)[-1])
    while at > 0:
        take[via[at]] += (at - before[at]) // lengths[via[at]]
        at = int(before[at])
    return take


def mix(docs: DataFrame, share: float = SHARE, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs``, and the column ``row`` if one is named."""
    spark = docs.sparkSession
    own = [F.col(row).alias("_row")] if row else []
    base = docs.select("doc_id", F.col("source").alias("_source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_hash"), *own)
    base = stage(base, "mix-sizes")
    counts = base.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("_n"))
    sums = {r["_source"]: int(r["s"]) for r in counts.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("s")).limit(MAX_SOURCES + 1).collect()}
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = targets(sums, share, weights, most)
    table = spark.createDataFrame([(s, sums[s], wanted[s]) for s in sums], "_named string, source_size long, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = int(min(target // size, most)) if size else 0
        rest = int(round(target)) - passes * size
        more = fit(pdf["size"].to_numpy(), pdf["_n"].to_numpy(), rest) if rest > 0 and passes < most else np.zeros(len(pdf), np.int64)
        return pdf.assign(_passes=passes, _quota=more)

    hist = counts.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_named"))).drop("_named")
    hist = hist.groupBy("_source").applyInPandas(plan, "_source string, size long, _n long, source_size long, target double, _passes long, _quota long")
    # A length of many documents is cut by hash into bins; only the bin in which its quota ends is ranked.
    hist = stage(hist.withColumn("_bins", F.ceil(F.col("_n") / RANKED).cast("long")), "mix-plan").withColumnRenamed("_source", "_s").withColumnRenamed("size", "_size")
    rows = base.join(hist, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size"))).drop("_s", "_size")
    rows = rows.withColumn("_bin", F.pmod(F.shiftrightunsigned("_hash", 1), F.col("_bins")))
    within = (F.col("_quota") > 0) & (F.col("_quota") < F.col("_n"))
    bins = rows.filter(within).groupBy("_source", "size", "_bin").agg(F.count(F.lit(1)).alias("_here"))
    before = F.coalesce(F.sum("_here").over(Window.partitionBy("_source", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("_before", before).select(F.col("_source").alias("_s"), F.col("size").alias("_size"), F.col("_bin").alias("_b"), "_before", "_here")
    split = rows.filter(within).join(bins, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")) & (F.col("_bin") == F.col("_b"))).drop("_s", "_size", "_b")
    cut = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_here") > F.col("_quota"))
    rank = F.row_number().over(Window.partitionBy("_source", "size", "_bin").orderBy("_hash", "doc_id"))
    parts = [
        (rows.filter(~within), F.col("_quota") > 0),
        (split.filter(~cut), F.col("_before") < F.col("_quota")),
        (split.filter(cut).withColumn("_rank", rank), F.col("_before") + F.col("_rank") <= F.col("_quota")),
    ]
    out = None
    for part, taken in parts:
        part = part.withColumn("copies", F.col("_passes") + taken.cast("long"))
        part = part.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(F.col("_row").alias(row) for _ in own))
        out = part if out is None else out.unionByName(part)
    return out


def mixture(docs: DataFrame) -> DataFrame:
    """The documents that the mixture takes, with their columns as they are and what ``mix`` says of them (underlined where there
    is a column of that name). Rows are numbered as they are written, so that rows with null or equal ids each get
    their own number of copies; which of equal rows get more makes no difference."""
    row, said = unused(docs.columns, "_row"), ["size", "source_size", "target", "taken", "copies"]
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    taken = mix(rows, row=row).filter("copies > 0").select(F.col(row).alias("_taken_row"), *(F.col(c).alias(f"_mix_{c}") for c in said))
    both = rows.join(taken, rows[f"`{row}`"] == taken["_taken_row"])
    return both.select(*(rows[f"`{c}`"] for c in docs.columns), *(taken[f"_mix_{c}"].alias(unused(docs.columns, c)) for c in said))


def query(docs: DataFrame) -> DataFrame:
    """op2: doc_id, size, source_size, target, taken, copies."""
    return mix(docs)

"""SimHash near-dedup with a byte-position inverted index.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes, each at
its own position. Distinct fingerprints are indexed by every choice of 3 positions with the bytes
there, so that such a pair shares at least 4 of its 56 posting lists. Within a list the shared positional
bytes of every pair are tallied; pairs that share fewer than the guaranteed 4, the bulk of those that meet,
are dropped, the others verified by their differing bits, and of a group of linked ones one link for each
goes on, not all pairs.

Lists of more than ``cap`` fingerprints are not paired. Their members are linked exactly another
way: two fingerprints differ in at most 4 bits if and only if some value is within 2 bits of both,
so each member lists the 2,081 values within 2 bits of it, and members that list the same value are
linked to the smallest of them. That is linear in the members and loses no component.

Exact copies and texts with the same fingerprint are one node. Null texts and texts without a word
have fingerprint zero, which links like any other; an empty table gives no row. Rows with equal ids are
told apart by nothing: a component holds ids, and each row gets its own row. A null id takes part in no
minimum unless its whole component is null. Texts of any length are read whole. A bit set in exactly half
of the hashes is 0. Other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
#: Byte positions of a posting list.
POSTED = 3
CAP = 512

_MASKS = np.array([sum(0xFF << (8 * i) for i in chosen) for chosen in combinations(range(8), POSTED)], np.uint64)
_BALL = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 2000):
            part = fps[at : at + 2000]
            lists = np.repeat(np.arange(len(_MASKS), dtype=np.int32), len(part))
            keys = (part.view(np.uint64)[None, :] & _MASKS[:, None]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(keys), pa.array(np.tile(part, len(_MASKS)))], ["l", "k", "fp"])


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 200):
            part = fps[at : at + 200]
            near = (part.view(np.uint64)[:, None] ^ _BALL[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(part, len(_BALL)))], ["k", "fp"])


def _pairs(runs: list[np.ndarray], fps: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links and the members of lists of more than ``cap``, from rows sorted by list."""
    new = np.ones(len(fps), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in runs], axis=0)
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(fps)))
    large = np.repeat(sizes > cap, sizes)
    run = np.cumsum(new)
    links = []
    at = np.flatnonzero(~large & np.repeat(sizes > 1, sizes))
    lag = 1
    while len(at := at[at + lag < len(fps)]) and len(at := at[run[at] == run[at + lag]]):
        a, b = fps[at].view(np.uint64), fps[at + lag].view(np.uint64)
        differing = a ^ b
        tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        ok = tally >= MIN_BYTES
        ok[ok] = np.bitwise_count(differing[ok]) <= MAX_BITS
        links.append(np.stack([a[ok], b[ok]], 1).view(np.int64))
        lag += 1
    return np.unique(np.concatenate(links), axis=0) if links else np.zeros((0, 2), np.int64), np.unique(fps[large])


def _forest(pairs: np.ndarray) -> np.ndarray:
    """At most one link for each member in place of all pairs: to the first of those that it is linked
    with, over any number of steps."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[other]], nodes[other]], 1)


def _sorted_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], cap: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Whole lists from sorted rows: a batch is cut at its last list, which is carried on. A list
    longer than ``cap`` is handed over in pieces that each are longer than ``cap``."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "fp")]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        same = np.all([x == x[-1] for x in cols[:-1]], axis=0) if len(cols[0]) else np.zeros(0, bool)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        if len(same) - cut > 3 * cap:  # enough to tell that it is long: keep as many as tell it again
            cut = len(same) - cap - 1
        if cut:
            yield [x[:cut] for x in cols[:-1]], cols[-1][:cut]
        rest = [x[cut:] for x in cols]
    if rest is not None and len(rest[0]):
        yield rest[:-1], rest[-1]


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that yield their components: trees over the
    pairs within MAX_BITS that share lists of at most ``cap``, and a chain over the pairs that don't."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, values in _sorted_runs(batches, ("l", "k"), cap):
            found, large = _pairs(runs, values, cap)
            found = _forest(found)
            u, v = np.concatenate([found[:, 0], large]), np.concatenate([found[:, 1], large])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    lists = fps.select("fp").mapInArrow(_postings, "l int, k long, fp long")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.repartition(parts, "l", "k").sortWithinPartitions("l", "k")
    found = stage(lists.mapInArrow(pair, "u long, v long").distinct(), "pairs")
    members = found.filter("u = v").select(F.col("u").alias("fp"))  # of long lists

    near = members.mapInArrow(_balls, "k long, fp long")
    least = near.groupBy("k").agg(F.min("fp").alias("u"), F.max("fp").alias("_most")).filter("u <> _most").select("k", "u")
    chained = near.join(least, "k").filter("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    return found.filter("u <> v").unionByName(chained)


def near_duplicates(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of its component) for every row."""
    rows = stage(fingerprints(docs), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    roots = stage(components(links(nodes, cap)), "roots")
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """op3: doc_id, fingerprint, component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

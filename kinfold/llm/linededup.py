"""Line dedup: exact reference counts of lines, sharded cuckoo filters in front of them.

The state is a table of line keys with the number of documents that hold each (exact), and one
cuckoo filter per shard of the keys that reached the threshold. Documents can be added and taken
away again: the counts are added up with their sign, and a key that crosses the threshold is put
into or deleted from its shard's filter, so the state after a deletion equals the one before the
insertion.

A line's key is the line stripped of ASCII white space with A-Z lower-cased, held as a 128-bit
BLAKE2 digest. Each row is a document of its own: a repeated row counts again, a null or empty
text is one empty line, whose key is too short to be counted. Rows with a null ``doc_id`` are kept, told
apart by their text. An empty table gives no row. Long texts are read whole. Other columns of the input,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage, unused
from .windows import keyed

SLOTS = 4
MAX_KICKS = 500
#: Filters are sent to the executors up to this size; beyond it every line goes to the exact join.
FILTER_LIMIT = 32 << 20
KEYS_PER_SHARD = 50_000


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit keys: 16-bit marks, buckets of four.

    A key sits in bucket b or in b xor hash(mark); a bucket that stays full after MAX_KICKS moves
    doubles the table, which re-adds every key, so no key is ever lost."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.8))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys, np.int64).view(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        marks = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = keys & mask
        return marks, first, first ^ (self._spread(marks) & mask)

    @staticmethod
    def _spread(marks: np.ndarray) -> np.ndarray:
        return (marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def insert(self, key: int) -> bool:
        marks, one, two = self._places(np.array([key]))
        mark, places = marks[0], (int(one[0]), int(two[0]))
        for b in places:
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        b, moves = places[0], []
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            moves.append((b, slot, self.table[b, slot]))
            mark, self.table[b, slot] = self.table[b, slot], mark
            b ^= int(self._spread(np.array([mark]))[0]) & (len(self.table) - 1)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        for b, slot, old in reversed(moves):
            self.table[b, slot] = old
        return False

    def delete(self, key: int) -> bool:
        """Take out one copy of a key that was inserted."""
        marks, one, two = self._places(np.array([key]))
        for b in (int(one[0]), int(two[0])):
            held = np.flatnonzero(self.table[b] == marks[0])
            if len(held):
                self.table[b, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, one, two = self._places(keys)
        return (self.table[one] == marks[:, None]).any(1) | (self.table[two] == marks[:, None]).any(1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while True:
            made = cls(size)
            if all(made.insert(int(k)) for k in keys):
                return made
            size = max(64, size * 2)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys' digests; b"" for keys of no code point."""
    lines = (text or "").encode().split(b"\n")
    return lines, [hashlib.blake2b(k, digest_size=16).digest() if (k := line.strip().lower()) else b"" for line in lines]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = b"".join(d for text in batch.column(0).to_pylist() for d in set(line_keys(text)[1]) if d)
        pairs = np.frombuffer(found, "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["k1", "k2"])


def count_lines(docs: DataFrame) -> DataFrame:
    """Exact reference counts: k1, k2, n_docs, the number of documents that hold the key."""
    keys = docs.select("text").mapInArrow(_key_rows, "k1 long, k2 long")
    return keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"))


def update_counts(counts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Counts after documents came and went; keys that nothing holds any more leave the table."""
    parts = counts.select("k1", "k2", "n_docs")
    if added is not None:
        parts = parts.unionByName(count_lines(added))
    if removed is not None:
        parts = parts.unionByName(count_lines(removed).withColumn("n_docs", -F.col("n_docs")))
    return parts.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs")).filter("n_docs > 0")


def _shard(n: int):
    return F.pmod(F.col("k2"), F.lit(n)).cast("int")


def build_filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """One cuckoo filter per shard of the keys held by ``min_docs`` documents or more."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [CuckooFilter.of(pdf["k1"].to_numpy()).to_bytes()]})

    hot = counts.filter(F.col("n_docs") >= min_docs).withColumn("shard", _shard(shards)).select("shard", "k1")
    return hot.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """The filters after an update of the counts: keys that crossed the threshold are inserted or
    deleted, the other marks stay. A filter that overflows doubles its table and is built anew."""
    now, was = after.withColumnRenamed("n_docs", "now"), before.withColumnRenamed("n_docs", "was")
    both = now.join(was, ["k1", "k2"], "full").select("k1", "k2", *((F.coalesce(F.col(c), F.lit(0)) >= min_docs).alias(c) for c in ("now", "was")))
    both = both.filter("now or was").withColumn("shard", _shard(shards)).select("shard", "k1", "now", "was")

    def apply(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else keys)["shard"].iloc[0])
        change = keys[keys["now"] != keys["was"]]
        made = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(len(keys))
        gone = all([made.delete(int(k)) for k in change.loc[change["was"], "k1"]])
        if not (gone and all(made.insert(int(k)) for k in change.loc[change["now"], "k1"])):
            made = CuckooFilter.of(keys.loc[keys["now"], "k1"].to_numpy())
        return pd.DataFrame({"shard": [shard], "filter": [made.to_bytes()]})

    return filters.groupBy("shard").cogroup(both.groupBy("shard")).applyInPandas(apply, "shard int, filter binary")


def drop_lines(docs: DataFrame, counts: DataFrame, min_docs: int = 10, filter_limit: int = FILTER_LIMIT) -> DataFrame:
    """doc_id, text (null texts as empty), n_lines, n_dropped: each document without the lines
    whose key ``min_docs`` documents hold. The filters spare most lines the shuffle; what passes
    them is held against the exact counts."""
    spark = docs.sparkSession
    hot = counts.filter(F.col("n_docs") >= min_docs)
    n_hot = hot.count()
    shards = max(1, -(-n_hot // KEYS_PER_SHARD))
    filters = build_filters(counts, min_docs, shards)
    held = None
    if n_hot * 2 * 4 <= filter_limit:
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if held is None else {s: CuckooFilter.from_bytes(f) for s, f in held.value.items()}
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [d for d in set(line_keys(text)[1]) if d]
                ids += [doc] * len(own)
                digests += own
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            keep = np.full(len(pairs), filters is None)
            for shard, one in (filters or {}).items():
                at = np.flatnonzero(pairs[:, 1] % shards == shard)
                keep[at] = one.contains(pairs[at, 0])
            ids = pa.array(ids, pa.int64()).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pairs[keep, 0]), pa.array(pairs[keep, 1])], ["key", "k1", "k2"])

    base, _ = keyed(docs)
    found = base.select("key", "text").mapInArrow(passing, "key long, k1 long, k2 long")
    found = found.join(hot.select("k1", "k2"), ["k1", "k2"])
    drops = found.groupBy("key").agg(F.collect_set(F.struct("k1", "k2")).alias("_drop"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, keys = line_keys(text)
                gone = {np.array([d["k1"], d["k2"]], "<i8").tobytes() for d in drop or ()}
                kept = [line for line, k in zip(own, keys, strict=True) if k not in gone]
                texts.append(b"\n".join(kept).decode())
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    both = base.join(drops, "key", "left").select("doc_id", "text", "_drop")
    return both.mapInArrow(cut, "doc_id long, text string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Count the lines of ``docs``, then drop the common ones from every document."""
    return drop_lines(docs, stage(count_lines(docs), "line-counts"), min_docs)


def without_common_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The documents with their common lines dropped and n_chars, where there is one, brought up to
    date; the other columns as they are. Texts without such lines stay as they are, null included."""
    key, kept = unused(docs.columns, "_key"), unused(docs.columns, "_kept")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    cut = dedup_lines(rows.select(F.col(key).alias("doc_id"), "text"), min_docs).filter("n_dropped > 0")
    cut = cut.select(F.col("doc_id").alias(key), F.col("text").alias(kept)).dropDuplicates([key])
    rows = rows.join(cut, key, "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """op7: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.i, u.l, translate(trim(u.l, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d, LATERAL (SELECT unnest(p) AS l, generate_subscripts(p, 1) AS i FROM (SELECT string_split(coalesce(d.text, ''), chr(10)) AS p)) u
), hot AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(h.k) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN h.k IS NULL THEN l END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN hot h ON lines.k = h.k GROUP BY doc_id
"""

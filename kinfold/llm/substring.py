"""Substring dedup of word windows by level-wise doubling.

A window is ``window`` consecutive words of one document. Windows that start alone at one length go no
further; those repeated at 8 words are extended to 16, then 32, and at last to the window itself:

* equal windows have the same anchor, their smallest 8-gram hash, so windows are compared with those of
  their anchor only; one row stands for a stretch of consecutive windows with one anchor (see ``windows``).
* identical stretches are represented once, with the number of times (two stands for more) that they occur.
* the windows of all stretches whose anchor occurs again are counted, with that number, by the hash of
  their first 8 words, the survivors by 16, and so on. Anchors of more than ``cap`` distinct stretches are
  not brought together: the levels are gone through in parts of them, and one of each kind of window of a
  part is dealt out by anchor and hash, so that those of different parts stand side by side.

A word is removed if a window that covers it starts anywhere else too, in the same document or
another. Windows are judged on the input. Texts with fewer words lose nothing; null texts are empty,
and so is the result of an empty table. Every row is a document, so rows repeated as a whole remove
each other; equal ids make no difference. Texts of any length are read whole; a long one costs memory
in proportion in one task. Other columns of the input, whatever their names, are not looked at.
Hashes are 64 bits within 64-bit anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .windows import CAP, all_stretches, by_anchor, covered, grams, keyed, list_columns, window_hashes, window_sums, with_company

WINDOW = 35
GRAM = 8
_MASKS = "a long, s long, mask long, j int, h long"


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), np.uint64)


def _gram_hashes(text: str) -> np.ndarray:
    words = word_hashes(text)
    return grams(words, GRAM) if len(words) >= GRAM else np.zeros(0, np.uint64)


def _levels(window: int) -> list[int]:
    out = [GRAM]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return [*out, window]


def _contents(window: int):
    """a, s, w, data (its gram hashes) of each distinct stretch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, (a, s, w, at) = list_columns(batch.column(1), ["a", "s", "w", "at"])
            for row in range(batch.num_rows):
                hashes, mine = _gram_hashes(batch.column(0)[row].as_py()), slice(offsets[row], offsets[row + 1])
                data = [hashes[x >> 6 : (x >> 6) + (x & 63) + window - GRAM].tobytes() for x in at[mine].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(a[mine]), pa.array(s[mine]), pa.array(w[mine]), pa.array(data, pa.binary())], ["a", "s", "w", "data"])

    return rows


def level_masks(data: list[bytes], anchors: np.ndarray, weights: np.ndarray, levels: list[int]) -> np.ndarray:
    """One mask per stretch: bit j is set if its window j is repeated among those of its anchor. The
    windows are counted at each level's length, each as often as its stretch occurs, and those alone at
    one length go no further."""
    window = levels[-1]
    buffer = np.frombuffer(b"".join(data), np.uint64)
    ends = np.cumsum([len(x) // 8 for x in data])
    begins = np.append(0, ends[:-1])
    row = np.repeat(np.arange(len(data)), ends - begins)
    group = np.cumsum(np.append(True, anchors[1:] != anchors[:-1])).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    alive = np.flatnonzero(np.arange(len(buffer)) + window - GRAM < ends[row])
    for length in levels:
        if len(alive):
            hashes = window_sums(buffer, length, GRAM).view(np.uint64)[alive] + group[row[alive]]
            _, back = np.unique(hashes, return_inverse=True)
            alive = alive[np.bincount(back, weights[row[alive]])[back] > 1]
    masks = np.zeros(len(data), np.int64)
    np.bitwise_or.at(masks, row[alive], np.int64(1) << (alive - begins[row[alive]]))
    return masks


def _rows(a, s, mask=None, j=None, h=None) -> pa.RecordBatch:
    n = len(a)
    cols = [pa.array(a, pa.int64()), pa.array(s, pa.int64())]
    cols += [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((mask, pa.int64()), (j, pa.int32()), (h, pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, ["a", "s", "mask", "j", "h"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, cap: int = CAP) -> DataFrame:
    """key, at, mask: bit j of the mask tells that window j of the stretch ``at`` of the documents (of
    ``keyed``) is repeated."""
    spark, levels = docs.sparkSession, _levels(window)
    found = all_stretches(docs, ["key"], _gram_hashes, window, GRAM, own=True)
    found = stage(found.mapInArrow(with_company(["a"], "own"), found.schema), "stretches")
    kinds = found.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "at")).alias("one"))
    parts = kinds.select("one.key", F.struct("a", "s", F.least("c", F.lit(2)).cast("int").alias("w"), "one.at").alias("part"))
    parts = parts.groupBy("key").agg(F.collect_list("part").alias("parts"))
    # Rows repeated as a whole have one key: their stretches come again here, with the weight of repeated ones.
    contents = docs.join(parts, "key").select("text", "parts").mapInArrow(_contents(window), "a long, s long, w int, data binary")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contents = contents.repartition(parallel, "a").sortWithinPartitions("a", "s")

    def masks_of(table: pa.Table) -> pa.RecordBatch:
        a, s, w = (table.column(c).to_numpy() for c in ("a", "s", "w"))
        masks = level_masks(table.column("data").to_pylist(), a, w, levels)
        some = masks != 0
        return _rows(a[some], s[some], masks[some])

    def windows_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, table.num_rows, 10 * cap):
            part = table.slice(i, 10 * cap)
            yield masks_of(part)  # what the levels tell within the part
            a, s = (part.column(c).to_numpy() for c in ("a", "s"))
            hashes = [np.frombuffer(x, np.uint64) for x in part.column("data").to_pylist()]
            sizes = np.array([len(x) - (window - GRAM) for x in hashes])
            row = np.repeat(np.arange(len(a)), sizes)
            j = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            h = np.concatenate([window_hashes(x, window, GRAM, 0, n) for x, n in zip(hashes, sizes, strict=True)])
            # Of windows that are repeated within the part one stands for all.
            one = np.sort(np.unique(np.stack([a[row], h]), axis=1, return_index=True)[1])
            yield _rows(a[row[one]], s[row[one]], None, j[one], h[one])

    masks = stage(contents.mapInArrow(by_anchor(masks_of, windows_of, cap), _MASKS), "masks")
    large = masks.filter("h is not null").select("a", "h", "s", "j").repartition(parallel, "a", "h").sortWithinPartitions("a", "h")
    large = large.mapInArrow(with_company(["a", "h"]), large.schema).select("a", "s", F.expr("shiftleft(1L, j)").alias("mask"))
    masks = masks.filter("mask is not null").select("a", "s", "mask").unionByName(large).groupBy("a", "s").agg(F.bit_or("mask").alias("mask"))
    return found.select("a", "s", "key", "at").join(masks, ["a", "s"]).select("key", "at", "mask")


def remove_repeats(docs: DataFrame, window: int = WINDOW, cap: int = CAP) -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed."""
    rows, unique = keyed(docs)
    gather = F.collect_list if unique else F.collect_set
    spans = repeated_windows(rows, window, cap).groupBy("key").agg(gather(F.struct("at", "mask")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            offsets, marks = list_columns(batch.column(2), ["at", "mask"])
            for i, text in enumerate(batch.column(1)):
                words = text.as_py().encode().split()
                drop = covered(*(m[offsets[i] : offsets[i + 1]] for m in marks), len(words), window)
                total.append(len(words))
                gone.append(int(drop.sum()))
                texts.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if gone[-1] else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    both = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long")


def query(docs: DataFrame) -> DataFrame:
    """op6: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w
), kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

"""Exact substring dedup of bytes with suffix arrays built by linear grouping.

A byte goes if a ``window``-byte string that covers it also starts in a document with a smaller id.
Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input.

Equal windows have equal anchors, so stretches of windows with the same anchor (see ``windows``) meet.
Identical stretches are represented once, with the smallest id that has them: the rows of larger ids lose
all windows of the stretch. The distinct stretches of an anchor go into suffix arrays (see ``grouping``),
where equal windows are neighbours, compared byte by byte; the smallest id among them is what the
representative is held against. Anchors with more than ``cap`` distinct stretches (the edges of a passage
that stands among ever different neighbours) are not brought together: suffix arrays settle what equal
windows some of them have, and one of each kind of window that is left is dealt out by anchor and bytes, so
that equal ones stand side by side.

Null texts are empty; texts shorter than a window lose nothing; an empty table gives no row. A null id is
smaller than any other; rows with equal ids never remove each other, repeated rows included. Texts of any
length are read whole; a long one costs memory in proportion in one task. Other columns of the input,
whatever their names, are not looked at. Identical stretches are told by 64 bits within 64-bit anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .grouping import suffix_arrays
from .windows import CAP, MOST, all_stretches, by_anchor, byte_grams, covered, keyed, list_columns, mixed, window_sums

WINDOW = 50
GRAM = 16
#: Symbols of one suffix array at most, about; small groups share arrays of about PACK.
BLOCK, PACK = 1500, 500
_LEAST = -(1 << 63)
_MASKS = "a long, s long, mask long, j int, d long, w binary"


def byte_hashes(text: bytes) -> np.ndarray:
    return byte_grams(text, GRAM) if len(text) >= GRAM else np.zeros(0, np.uint64)


#: What becomes of a stretch: all its windows go; it represents its kind among others of its anchor; it
#: goes with its representative, which has the same id.
LATER, LEAD, SAME = 0, 1, 2


def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a, s, doc_id, with a column ``kind``: the first row of a stretch's kind if its anchor
    has other kinds (LEAD), later ones with its id (SAME) or a larger one (LATER). The first row of an
    anchor waits until another kind shows up; nothing else is held. A kind that shares neither hash of a column
    ``near`` (see ``windows.neighbours``) with another of its anchor shares no window and is left out, if all
    rows of the anchor are in one batch."""
    last_a = last_s = first_doc = waiting = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, s, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "s", "doc_id"))
        names = batch.schema.names
        near = batch.column("near").to_numpy() if "near" in names else None
        batch = batch.select([c for c in names if c != "near"])
        new_a, new_s = np.append(True, a[1:] != a[:-1]), np.append(True, s[1:] != s[:-1])
        if last_a is not None:
            new_a[0], new_s[0] = a[0] != last_a, s[0] != last_s
        new = new_a | new_s
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = doc[at]
        if at[0] < 0:
            first[at < 0] = first_doc
        leads = np.flatnonzero(new)
        company = np.zeros(n, bool)
        if len(leads):
            others = ~new_a[leads]
            company[leads] = others | np.append(others[1:], False)
            if waiting is not None and others[0]:
                yield waiting
            waiting = None
            alone = not company[leads[-1]]
            if near is not None:
                company[leads] &= ~_strangers(np.cumsum(new_a[leads]), near[leads], company[leads])
            if alone:
                waiting = _marked(batch.slice(int(leads[-1]), 1), np.array([LEAD], np.int8))
        keep = company | ~new
        if keep.any():
            kind = np.where(new, LEAD, np.where(doc > first, LATER, SAME)).astype(np.int8)
            kept = pa.array(keep)
            yield _marked(batch.filter(kept), kind[keep])
        last_a, last_s, first_doc = a[-1], s[-1], first[-1]


def _strangers(group: np.ndarray, near: np.ndarray, company: np.ndarray) -> np.ndarray:
    """Which kinds, of the groups but the first and the last, share no hash with another of their group."""
    out = np.zeros(len(group), bool)
    some = np.flatnonzero(company & (group > 0) & (group < group[-1]))
    if len(some):
        group, near = group[some].astype(np.int64), near[some]
        known = np.zeros(len(some), bool)
        for half in (near >> 16 & 0xFFFF, near & 0xFFFF):
            _, back, times = np.unique(group << 16 | half, return_inverse=True, return_counts=True)
            known |= (times[back] > 1) & (half > 0)
        out[some] = ~known & ~np.isin(group, group[near == -1])
    return out


def _marked(batch: pa.RecordBatch, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind)], [*batch.schema.names, "kind"])


def _contents(window: int):
    """a, s, d, data (its bytes) of each stretch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, (a, s, d, at) = list_columns(batch.column(1), ["a", "s", "d", "at"])
            low = 0
            while low < batch.num_rows:
                high, size, data = low, 0, []
                while high < batch.num_rows and size < 1 << 20:
                    text = batch.column(0)[high].as_py()
                    more = [text[x >> 6 : (x >> 6) + (x & 63) + window - 1] for x in at[offsets[high] : offsets[high + 1]].tolist()]
                    data += more
                    size += sum(map(len, more))
                    high += 1
                mine = slice(offsets[low], offsets[high])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[mine]) for x in (a, s, d)), pa.array(data, pa.binary())], ["a", "s", "d", "data"])
                low = high

    return rows


def _pieces(group: np.ndarray, hashes: np.ndarray, docs: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of groups that are too large for one suffix array, dealt out by hash: piece and start of
    each. Every piece holds windows of one hash, the one with the smallest id among them."""
    order = np.lexsort((docs, hashes, group))
    new = np.append(True, (group[order][1:] != group[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))
    first = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    most = max(1, BLOCK // (window + 1) - 1)
    later = (nth > 0) & (nth % most == 0)  # a further piece, which holds the first window too
    piece = np.cumsum(new | later)
    lead = order[first[np.cumsum(new) - 1]]
    return np.append(piece, piece[later]), at[np.append(order, lead[later])]


def _packed(group: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Blocks of about PACK symbols for parts sorted by group; those of one group share a block."""
    new = np.append(True, group[1:] != group[:-1])[: len(group)]
    ends = np.cumsum(size + 1)
    nth = np.cumsum(new) - 1
    return ends[np.append(np.flatnonzero(new)[1:], len(group)) - 1][nth] // PACK if len(group) else nth


def _runs(at: np.ndarray, row: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one stretch that come equally often: index of the first, number."""
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]) | (times[1:] != times[:-1]))[: len(at)])
    return first, np.diff(np.append(first, len(at)))


def _alike(first: np.ndarray, n: np.ndarray, at: np.ndarray, hashes: np.ndarray, group: np.ndarray, docs: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """For each run the one with the smallest id among those of its group with equal bytes, or itself."""
    head, tail = at[first], at[first + n - 1]
    key = mixed(hashes[first].view(np.uint64) + np.uint64(3) * hashes[first + n - 1].view(np.uint64) + n.astype(np.uint64))
    order = np.lexsort((docs, key, group))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1]))
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (n[order] == n[lead]) & (n[order] <= strings.shape[1] + 1)  # first and last window hold every byte
    for end in (head, tail):
        for i in range(0, len(order), 100_000):
            here = slice(i, i + 100_000)
            same[here] &= (strings[end[order[here]]] == strings[end[lead[here]]]).all(1)
    out = np.arange(len(first))
    out[order[same]] = lead[same]
    return out


def shared_windows(data: list[bytes], anchors: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """One mask per stretch: bit j is set if its window j is in a stretch of the same anchor with a
    smaller id. Rows are sorted by anchor. Stretches none of whose windows has a hash that comes again in
    their group stay out. The others go into suffix arrays whole, small groups side by side. In groups of more than
    BLOCK bytes only the runs of such windows do, cut where their windows come more or less often; runs of equal bytes are
    represented once, by the smallest id. Where the rest is still too large it goes in window by window. What is equal is told by order there and by bytes."""
    buffer = np.frombuffer(b"".join(data), np.uint8)
    length = np.array([len(x) for x in data])
    ends = np.cumsum(length)
    begins = ends - length
    row = np.repeat(np.arange(len(data)), length)
    masks = np.zeros(len(data), np.int64)
    group = np.cumsum(np.append(True, anchors[1:] != anchors[:-1])) - 1
    inside = np.flatnonzero(np.arange(len(buffer)) + window <= ends[row])  # where a window lies within its stretch
    if not len(inside):
        return masks
    hashes = window_sums(byte_hashes(buffer.tobytes()), window, GRAM)[inside]
    _, back, times = np.unique(mixed(hashes.view(np.uint64) + group[row[inside]].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)), return_inverse=True, return_counts=True)
    keep = times[back] > 1
    inside, hashes, times = inside[keep], hashes[keep], times[back][keep]
    shares = np.zeros(len(data), bool)
    shares[row[inside]] = True
    total = np.bincount(group, np.where(shares, length + 1, 0))
    small = total <= BLOCK
    some = np.flatnonzero(small[group] & shares)
    block, start, size = _packed(group[some], length[some]), begins[some], length[some]
    large = ~small[group[row[inside]]]
    strings = np.lib.stride_tricks.sliding_window_view(buffer, window)
    if large.any():
        inside, hashes = inside[large], hashes[large]
        first, n = _runs(inside, row, times[large])
        lead = _alike(first, n, inside, hashes, group[row[inside[first]]], docs[row[inside[first]]], strings)
        heads, offset = row[inside[first]], inside[first] - begins[row[inside[first]]]
        bits = ((np.int64(1) << n) - 1) << offset
        copy = lead != np.arange(len(lead))
        later = copy & (docs[heads] > docs[heads[lead]])
        np.bitwise_or.at(masks, heads[later], bits[later])
        copies, lead = np.flatnonzero(copy & ~later), lead[copy & ~later]
        kept = np.repeat(~copy, n)
        inside, hashes = inside[kept], hashes[kept]
        _, back, times = np.unique(mixed(hashes.view(np.uint64) + group[row[inside]].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)), return_inverse=True, return_counts=True)
        inside, hashes = inside[times[back] > 1], hashes[times[back] > 1]
        to, m = _runs(inside, row, np.ones(len(inside)))
        size_of = m + window - 1
        whole = np.bincount(group[row[inside[to]]], size_of + 1, len(total)) <= BLOCK
        mine = np.flatnonzero(whole[group[row[inside[to]]]])
        top = block[-1] + 1 if len(block) else 0
        block = np.append(block, top + _packed(group[row[inside[to[mine]]]], size_of[mine]))
        start, size = np.append(start, inside[to[mine]]), np.append(size, size_of[mine])
        one = ~whole[group[row[inside]]]
        if one.any():
            inside, hashes = inside[one], hashes[one]
            piece, at = _pieces(group[row[inside]], hashes, docs[row[inside]], inside, window)
            by = np.argsort(piece, kind="stable")
            top = block[-1] + 1 if len(block) else 0
            block, start, size = np.append(block, top + piece[by]), np.append(start, at[by]), np.append(size, np.full(len(at), window))
    if not len(block):
        return masks
    source = np.repeat(start - np.append(0, np.cumsum(size + 1)[:-1]), size + 1) + np.arange(int((size + 1).sum()))
    last = np.cumsum(size + 1) - 1  # the separator after each part
    symbols = buffer[np.minimum(source, len(buffer) - 1)].astype(np.int16) + 2
    symbols[last] = 1
    final = np.append(block[1:] != block[:-1], True)
    symbols[last[final]] = 0
    room = np.repeat(last, size + 1) - np.arange(len(symbols))  # bytes before the separator
    order = suffix_arrays(symbols, np.append(0, last[final] + 1))
    order = order[room[order] >= window]
    of = np.repeat(block, size + 1)[order]
    source = source[order]
    equal = np.zeros(len(order), bool)
    for i in range(1, len(order), 100_000):
        to = min(len(order), i + 100_000)
        equal[i:to] = (of[i:to] == of[i - 1 : to - 1]) & (strings[source[i:to]] == strings[source[i - 1 : to - 1]]).all(1)
    begin = np.flatnonzero(~equal)
    ids = docs[row[source]]
    least = np.repeat(np.minimum.reduceat(ids, begin), np.diff(np.append(begin, len(ids))))
    gone = source[least < ids]
    np.bitwise_or.at(masks, row[gone], np.int64(1) << (gone - begins[row[gone]]))
    if large.any():  # runs with the id of their representative go with it
        found = (masks[heads[lead]] & bits[lead]) >> offset[lead] << offset[copies]
        np.bitwise_or.at(masks, heads[copies], found)
    return masks


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, s, j of the windows that have one with equal bytes and a smaller id before them, from rows
    sorted by a, w (bytes), d. Only the first row of the last group is held."""
    last = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, d = (batch.column(c).to_numpy() for c in ("a", "d"))
        w = np.array(batch.column("w").to_pylist(), object)
        new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))
        new[0] = last != (a[0], w[0])
        at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        least = np.where(at < 0, first, d[at]) if at[0] < 0 else d[at]
        yield batch.select(["a", "s", "j"]).filter(pa.array(d > least.astype(np.int64)))
        last, first = (a[-1], w[-1]), int(least[-1])


def _rows(a, s, mask=None, j=None, d=None, w=None) -> pa.RecordBatch:
    n = len(a)
    cols = [pa.array(a, pa.int64()), pa.array(s, pa.int64())]
    cols += [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((mask, pa.int64()), (j, pa.int32()), (d, pa.int64()), (w, pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, ["a", "s", "mask", "j", "d", "w"])


def earlier_windows(docs: DataFrame, unique: bool, window: int = WINDOW, cap: int = CAP) -> DataFrame:
    """key, at, mask of the documents (of ``keyed``): bit j tells that window j of the stretch ``at`` also
    starts in a document with a smaller id; mask -1: all of them do."""
    spark = docs.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = docs.select("key", F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = all_stretches(data, ["doc_id"] if unique else ["doc_id", "key"], byte_hashes, window, GRAM, near=True)
    found = stage(found.mapInArrow(kinds, ", ".join(f"{c} long" for c in found.columns if c != "near") + ", kind tinyint"), "stretches")
    if unique:
        found = found.withColumn("key", F.col("doc_id"))
    parts = found.filter(F.col("kind") == LEAD).groupBy("key").agg(F.collect_list(F.struct("a", "s", F.col("doc_id").alias("d"), "at")).alias("parts"))
    # A row repeated as a whole yields its contents again, with the same id: that changes no minimum.
    contents = data.join(parts, "key").select("text", "parts").mapInArrow(_contents(window), "a long, s long, d long, data binary")
    contents = contents.repartition(parallel, "a").sortWithinPartitions("a", "s")

    def masks_of(table: pa.Table) -> pa.RecordBatch:
        a, s, d = (table.column(c).to_numpy() for c in ("a", "s", "d"))
        masks = shared_windows(table.column("data").to_pylist(), a, d, window)
        some = masks != 0
        return _rows(a[some], s[some], masks[some])

    def windows_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, table.num_rows, 10 * cap):
            a, s, d = (table.column(c)[i : i + 10 * cap].to_numpy() for c in ("a", "s", "d"))
            data = table.column("data")[i : i + 10 * cap].to_pylist()
            masks = shared_windows(data, a, d, window)  # what these decide among themselves
            some = masks != 0
            yield _rows(a[some], s[some], masks[some])
            row, j = np.nonzero(~(masks[:, None] >> np.arange(MOST)) & 1 & (np.arange(MOST) <= np.array([len(x) - window for x in data])[:, None]))
            yield _rows(a[row], s[row], None, j, d[row], [data[r][x : x + window] for r, x in zip(row.tolist(), j.tolist(), strict=True)])

    masks = stage(contents.mapInArrow(by_anchor(masks_of, windows_of, cap), _MASKS), "masks")
    large = masks.filter("w is not null").select("a", "s", "j", "d", "w").repartition(parallel, "a", "w").sortWithinPartitions("a", "w", "d")
    large = large.mapInArrow(later_windows, "a long, s long, j int").select("a", "s", F.expr("shiftleft(1L, j)").alias("mask"))
    masks = masks.filter("mask is not null").select("a", "s", "mask").unionByName(large).groupBy("a", "s").agg(F.bit_or("mask").alias("mask"))
    later = found.filter(F.col("kind") == LATER).select("key", "at", F.lit(-1).cast("long").alias("mask"))
    rest = found.filter(F.col("kind") != LATER).select("a", "s", "key", "at").join(masks, ["a", "s"]).select("key", "at", "mask")
    return later.unionByName(rest)


def remove_repeats(docs: DataFrame, window: int = WINDOW, cap: int = CAP) -> DataFrame:
    """doc_id, data (the remaining bytes), n_bytes, n_removed, n_spans."""
    rows, unique = keyed(docs)
    gather = F.collect_list if unique else F.collect_set
    spans = earlier_windows(rows, unique, window, cap).groupBy("key").agg(gather(F.struct("at", "mask")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, total, gone, runs = [], [], [], []
            offsets, marks = list_columns(batch.column(2), ["at", "mask"])
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                drop = covered(*(m[offsets[i] : offsets[i + 1]] for m in marks), len(text), window)
                total.append(len(text))
                gone.append(int(drop.sum()))
                runs.append(int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum()))
                data.append(np.frombuffer(text, np.uint8)[~drop].tobytes() if gone[-1] else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, gone, runs))], ["doc_id", "data", "n_bytes", "n_removed", "n_spans"])

    both = rows.join(spans, "key", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return both.mapInArrow(cut, "doc_id long, data binary, n_bytes long, n_removed long, n_spans long")


def query(docs: DataFrame) -> DataFrame:
    """op8: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT doc_id, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS p, unnest(list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: substr(h, 2 * i + 1, 2))) AS byte FROM t
), w AS (
  SELECT doc_id, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS p, unnest(list_transform(range(0, CAST(length(h) / 2 AS BIGINT) - 49), lambda i: md5(substr(h, 2 * i + 1, 100)))) AS g FROM t
), f AS (
  SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT w.doc_id, w.p FROM w JOIN f ON w.g = f.g WHERE w.doc_id > f.m
), c AS (
  SELECT b.doc_id, b.p, b.byte, coalesce(b.p - max(r.p) OVER (PARTITION BY b.doc_id ORDER BY b.p) < 50, false) AS gone
  FROM b LEFT JOIN r ON b.doc_id = r.doc_id AND b.p = r.p
), s AS (
  SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM c
), k AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM s GROUP BY doc_id
)
SELECT t.doc_id, CAST(length(t.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""

"""Anchored windows: what exact substring dedup of words and of bytes have in common.

A window of W tokens holds W - k + 1 grams of k tokens; the smallest of their hashes is its anchor.
Equal windows have equal anchors wherever they stand, so only windows with equal anchors need be
compared. Consecutive windows with one anchor are a stretch; one row stands for a stretch, about
(W - k) / 2 windows each. Rows are dealt out and sorted by anchor once, and each task streams through
its anchors: a stretch alone with its anchor goes no further, identical ones are told by neighbouring
rows. No filter over all anchors is built and no group is held, however many rows share an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Windows of one stretch at most, so that a long holds a bit for each.
MOST = 60
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text, and of stretches, that a task works on at a time, about.
SLICE, BATCH = 1 << 20, 1 << 20
#: Distinct stretches of one anchor that are compared in one task; beyond it Spark groups their windows.
CAP = 200


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xCA5A826395121157)
    x ^= x >> np.uint64(32)
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two neighbours, in few passes."""
    x = a * np.uint64(0x9FB21C651E98DF25)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def grams(tokens: np.ndarray, k: int, width: int = 1) -> np.ndarray:
    """Hashes of the k-grams of a text by doubling, from those of ``width`` tokens (k / width a power of two)."""
    now = tokens
    while width < k:
        now = _joined(now[:-width], now[width:])
        width *= 2
    return now


def byte_grams(data: bytes, k: int) -> np.ndarray:
    """Hashes of the k-byte strings (k a power of two, 16 at least) of ``data``."""
    eight = np.empty(len(data) - 7, np.uint64)
    for r in range(min(8, len(eight))):
        eight[r::8] = np.frombuffer(data, "<u8", (len(data) - r) // 8, r)
    return grams(eight, k, 8)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    now, width = x, 1
    while 2 * width <= w:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    return np.minimum(now[: len(now) - (w - width)], now[w - width :]) if width < w else now


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_B, _B_INVERSE)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def stretches(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, content hash, first window, number of windows of each stretch, from a text's gram hashes."""
    w = window - k + 1
    n = len(hashes) - w + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    least = sliding_min(hashes, w)
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    sizes = np.diff(np.append(starts, n))
    if (sizes > MOST).any():
        parts = -(-sizes // MOST)
        first = np.repeat(starts, parts)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.minimum(MOST, np.repeat(sizes, parts) - nth * MOST)
        starts = first + nth * MOST
    up, down = _powers_to(len(hashes) + 1)
    sums = np.append(np.uint64(0), np.cumsum(hashes * up[:-1], dtype=np.uint64))
    content = mixed((sums[starts + sizes + w - 1] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
    return least[starts].view(np.int64), content.view(np.int64), starts, sizes


def self_repeats(hashes: np.ndarray, window: int, k: int, anchors: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a stretch holds its anchor twice or more: only then can two of its own windows be equal."""
    out = np.zeros(len(anchors), bool)
    if len(np.unique(hashes)) < len(hashes):
        values = anchors.view(np.uint64)
        for i in range(len(out)):
            out[i] = np.count_nonzero(hashes[starts[i] : starts[i] + sizes[i] + window - k] == values[i]) > 1
    return out


def neighbours(hashes: np.ndarray, window: int, k: int, anchors: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two hashes of 16 bits in one number for each stretch: of the k tokens before its anchor and of the k after it, 0 for those
    that don't lie within it. A window of 3 k - 1 tokens or more holds one or the other, so stretches of one anchor that share
    neither share no window. -1: the anchor may stand in a stretch of the text more than once, which tells nothing."""
    w = window - k + 1
    if window < 3 * k - 1 or not len(anchors):
        return np.full(len(anchors), -1, np.int32)
    # A gram is the smallest of some window if the largest of all windows' smallest hashes around it is its own.
    pad = np.full(w - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.flatnonzero(sliding_min(np.concatenate([pad, ~np.repeat(anchors.view(np.uint64), sizes), pad]), w) == ~hashes)
    once = None
    if len(at) != len(anchors) or sizes.max() > w:  # grams that repeat: each is looked for
        at, once = np.empty_like(starts), np.empty(len(starts), bool)
        padded = np.append(hashes, np.zeros(MOST + window - k, np.uint64))
        for i in range(0, len(anchors), 5000):
            here = slice(i, i + 5000)
            stands = np.lib.stride_tricks.sliding_window_view(padded, MOST + window - k)[starts[here]] == anchors[here, None].view(np.uint64)
            stands &= np.arange(stands.shape[1]) < (sizes[here] + window - k)[:, None]
            at[here], once[here] = starts[here] + stands.argmax(1), stands.sum(1) == 1
    before, after = at - k, at + k
    before = np.where(before >= starts, np.maximum(hashes[np.maximum(before, 0)] >> np.uint64(48), np.uint64(1)), np.uint64(0))
    after = np.where(after < starts + sizes + window - k, np.maximum(hashes[np.minimum(after, len(hashes) - 1)] >> np.uint64(48), np.uint64(1)), np.uint64(0))
    out = (before << np.uint64(16) | after).astype(np.uint32).view(np.int32)
    return out if once is None else np.where(once, out, np.int32(-1))


def window_hashes(hashes: np.ndarray, window: int, k: int, start: int, size: int) -> np.ndarray:
    """Hash of each window of one stretch; with the anchor it stands for the window's content."""
    return window_sums(hashes[start : start + size + window - k], window, k)


def window_sums(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """The same for all windows of a sequence of gram hashes."""
    w = window - k + 1
    up, down = _powers_to(len(hashes) + 1)
    sums = np.append(np.uint64(0), np.cumsum(hashes * up[:-1], dtype=np.uint64))
    return mixed((sums[w:] - sums[:-w]) * down[: len(hashes) - w + 1]).view(np.int64)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id (long), key, text (null as empty), and whether the key is the id, as it is where ids are
    unique and not null; else it is a hash of id and text, so that rows which share an id are not mixed up."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    odd = bool(ids.filter("n > 1 or doc_id is null").limit(1).count())
    return rows.withColumn("key", F.xxhash64("doc_id", "text") if odd else F.col("doc_id")), not odd


def _stretch_rows(hashes_of: Callable, window: int, k: int, more: Callable | None, name: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
            names, texts = [*batch.schema.names[:-1], "a", "s", "at", name], batch.column(batch.num_columns - 1)
            rows, cols, size = [], [], 0
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                if len(h := hashes_of(text)) >= window - k + 1:
                    a, s, start, n = stretches(h, window, k)
                    rows.append((row, len(a)))
                    cols.append((a, s, start << 6 | n, *([more(h, window, k, a, start, n)] if more else [])))
                size += len(text)
                if cols and (size >= SLICE or row == batch.num_rows - 1):
                    found = [np.concatenate(x) for x in zip(*cols, strict=True)]
                    which = np.repeat(*map(np.array, zip(*rows, strict=True)))
                    found = [x[which] for x in ids] + found
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names[: len(found)])
                    rows, cols, size = [], [], 0

    return scan


def all_stretches(docs: DataFrame, ids: list[str], hashes_of: Callable, window: int, k: int, own: bool = False, near: bool = False) -> DataFrame:
    """``ids`` (longs), a, s, at: the stretches of every text, dealt out and sorted by anchor, content
    and ids. ``at`` holds the first window and, in its last six bits, their number. ``own``: whether a
    stretch repeats its anchor itself. ``near``, in its place: the hashes of ``neighbours``."""
    names = [f"{c} long" for c in (*ids, "a", "s", "at")] + (["own boolean"] if own else ["near int"] * near)
    more = self_repeats if own else neighbours if near else None
    rows = docs.select(*ids, "text").mapInArrow(_stretch_rows(hashes_of, window, k, more, "own" if own else "near"), ", ".join(names))
    return rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a").sortWithinPartitions("a", "s", *ids, "at")


def with_company(keys: list[str], marked: str | None = None):
    """A mapInArrow function: of rows sorted by ``keys`` (longs), those whose keys another row has too, and
    those with a true ``marked``. The last row of a batch waits for the next."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            cols = [table.column(k).to_numpy() for k in keys]
            same = np.append(before, np.all([x[1:] == x[:-1] for x in cols], axis=0))
            keep = same | np.append(same[1:], False)
            if marked:
                keep |= table.column(marked).to_numpy()
            yield from table.slice(0, len(same) - 1).filter(pa.array(keep[:-1])).to_batches()
            held, before = table.slice(len(same) - 1).to_batches()[0], bool(same[-1])
        if held is not None and (before or marked and held.column(marked)[0].as_py()):
            yield held

    return rows


def by_anchor(work: Callable, wide: Callable, cap: int):
    """A mapInArrow function over rows sorted by ``a`` (with bytes ``data``): calls ``work`` with tables of
    about BATCH bytes that hold all rows of their anchors, and ``wide`` with rows of anchors of more than
    ``cap`` rows, which are not brought together."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        a = table.column("a").to_numpy()
        new = np.append(True, a[1:] != a[:-1])
        large = (np.diff(np.append(np.flatnonzero(new), len(a))) > cap)[np.cumsum(new) - 1]
        if not large.all():
            yield work(table.filter(pa.array(~large)).combine_chunks())
        if large.any():
            yield from wide(table.filter(pa.array(large)).combine_chunks())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        streamed = None  # the anchor whose rows go on and are more than ``cap``
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                piece = batch.slice(at, 5000)
                if streamed is not None:
                    cut = int(np.searchsorted(piece.column("a").to_numpy(zero_copy_only=False), streamed, "right"))
                    if cut:
                        yield from wide(pa.Table.from_batches([piece.slice(0, cut)]))
                    if cut == piece.num_rows:
                        continue
                    piece, streamed = piece.slice(cut), None
                held.append(piece)
                if sum(x.column("data").nbytes for x in held) < BATCH:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                anchors = table.column("a").to_numpy()
                cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
                if cut:
                    yield from settle(table.slice(0, cut).combine_chunks())
                rest = table.slice(cut).combine_chunks()
                if rest.num_rows > cap:
                    yield from wide(rest)
                    held, streamed = [], anchors[-1]
                else:
                    held = rest.to_batches()
        if sum(x.num_rows for x in held):
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    return rows


def list_columns(column: pa.ListArray, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets, and each named field of a column of lists of structs as one array; cheaper than a dict for each."""
    values = column.values
    return column.offsets.to_numpy(), [values.field(n).to_numpy(zero_copy_only=False) for n in names]


def covered(at: np.ndarray, masks: np.ndarray, n_tokens: int, window: int) -> np.ndarray:
    """Which tokens of a text the marked windows of its stretches cover; mask -1: all of a stretch."""
    starts, sizes = at >> 6, at & 63
    edges = np.zeros(n_tokens + 1, np.int64)
    whole = masks == -1
    np.add.at(edges, starts[whole], 1)
    np.add.at(edges, starts[whole] + sizes[whole] + window - 1, -1)
    starts, masks = starts[~whole], masks[~whole]
    for i in range(0, len(masks), 5000):
        row, bit = np.nonzero((masks[i : i + 5000, None] >> np.arange(MOST)) & 1)
        begin = starts[i : i + 5000][row] + bit
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + window, -1)
    return np.cumsum(edges[:-1]) > 0

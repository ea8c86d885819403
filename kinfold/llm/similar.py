"""SimHash near-dedup at a word-shingle similarity: five words, Jaccard 0.8 and more.

``simhash`` links fingerprints within 4 of 64 bits, which for most texts means a similarity above 0.95. Two
shingle sets of similarity s have an expected share of acos(2 s / (1 + s)) / pi of differing bits, 15 % at 0.8,
so here fingerprints have 512 bits, and the same byte-position index works on their 64 bytes:

* Distinct shingle sets are posted under ``LISTS`` choices of 3 byte positions with the bytes there and one of
  eight least shingle hashes, by orders of their own. Bytes alone have 24 bits, so that unrelated texts would meet by chance in
  a number that grows with the square of the texts; unrelated texts also have different least shingles. Two texts have
  the same one with a chance of their similarity, which twice the lists more than make up for. Lists of one
  member end here. A pair at 0.8 shares 17 of the 64 bytes on average and a list with a chance of about 0.9; at
  0.85 of 0.99. This is a search by chance, not a guarantee; the README has measured recall.
* Within a list the shared positional bytes of every pair are counted; pairs with fewer than ``MIN_BYTES`` are
  dropped, and so are those with more differing bits than 2.5 standard deviations above what 0.8 gives. Of the rest
  a minimum spanning forest by differing bits goes on: to cut it at a threshold gives the same components as to cut
  all pairs there, with at most one link a member. Bits are an estimate, though: a member may have its fewest bits to
  one that the exact check rejects. So each is also linked to the hub of its list, the member nearest to the
  majority of all bits there (the original of many copies), and who has no link to it to the hub of what is left.
* In a list of more than ``WINDOW`` members each is first compared with the next ``WINDOW`` in ``ORDERS`` orders of their
  bytes rather than with all, so that most of a group of any size is found in work linear in its members.
* Verification: links with fewer bits than a similarity of 0.9 gives (three standard deviations from 0.8) are taken.
  For the others the exact Jaccard similarity decides: first for the ``FIRST`` links of each group with the fewest
  bits, then for every link that still leads from one group to another. None is dropped unverified.
* What windows, pieces and forests have left out follows: all pairs of a list whose members are not in one group by then
  are compared, those not looked at yet that pass the count and the limit of bits are verified likewise. So
  no pair of a list that passes them is lost. Members of a list's largest group are compared with the others alone;
  work grows with the square of a list only where its members are no near duplicates of each other.

Equal shingle sets are one node, the smallest of their ids. Null texts and texts without a word are copies of each
other; a text of fewer than five words is one shingle. Texts of any length are read whole. Rows with a null id
neither go nor make others go; rows with equal ids stay or go together. An empty table gives no row. Ties are settled
by the smaller id. Columns of any name pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage, unused
from .components import components

WIDTH = 5
SIMILARITY = 0.8
BYTES = 64
BITS = 8 * BYTES
SEED = 42
#: Shuffles of the byte positions, each cut into choices of three.
SHUFFLES = 20
#: Orders of the shingles; a list's key holds the least shingle by one.
LEAST = 8
MIN_BYTES = 8
WINDOW = 32
ORDERS = 16
PIECE = 8192
#: Times that the hub of a list is looked for, each among those that have no link to one yet.
HUBS = 3
#: Links of a group that are verified before all others.
FIRST = 4

_random = np.random.default_rng(SEED)
_CHOICES = np.concatenate([_random.permutation(BYTES)[: BYTES // 3 * 3].reshape(-1, 3) for _ in range(SHUFFLES)])
_ORDERS = np.stack([_random.permutation(BYTES)[:8] for _ in range(ORDERS)])
LISTS = len(_CHOICES)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def expected_bits(similarity: float) -> float:
    return BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi


def _spread(similarity: float) -> float:
    share = expected_bits(similarity) / BITS
    return math.sqrt(BITS * share * (1 - share))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; none for a text without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= width:
        hashes = digest(joined, SEED)
    else:
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :], strict=False)])
    return np.unique(np.frombuffer(hashes, np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """A bit is 1 if it is set in over half of the hashes, each spread over 512 bits."""
    return sketch(hashes)[0]


def sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The fingerprint, and the least of the hashes by each of ``LEAST`` orders, of 8 bytes each."""
    ones, least = np.zeros(BITS, np.int64), np.full(LEAST, -1).astype(np.uint64)
    for at in range(0, len(hashes), 16 * 255):
        part = hashes[at : at + 16 * 255]
        wide = part[:, None] + _STEP * np.arange(1, BYTES // 8 + 1, dtype=np.uint64)[None, :]
        wide = (wide ^ (wide >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        wide = (wide ^ (wide >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide ^= wide >> np.uint64(31)
        least = np.minimum(least, wide.min(0))
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        for begin in range(0, len(bits), 255):  # 255 ones fit in a byte
            ones += bits[begin : begin + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes(), least.tobytes()


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id (long), digest of the shingle set, fp and least (64 bytes each)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1):  # one text's hashes at a time
                hashes = shingle_set(text.as_py(), width)
                made.append((xxhash.xxh3_128_digest(hashes.tobytes()), *sketch(hashes)))
            columns = [batch.column(0), *(pa.array([m[i] for m in made], pa.binary()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "least"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, digest binary, fp binary, least binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, fps, least = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), _matrix(batch.column(2)).view(np.uint64)
        for at in range(0, len(nodes), 500):
            part = fps[at : at + 500].astype(np.int64)
            keys = np.arange(LISTS)[None, :] << 24
            for place in range(3):
                keys = keys | part[:, _CHOICES[:, place]] << 8 * place
            keys = (keys.view(np.uint64) * _STEP ^ least[at : at + 500, np.arange(LISTS) % LEAST]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(nodes[at : at + 500], LISTS))], ["k", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another row has, from rows sorted by key."""
    rest, paired = None, False
    for batch in batches:
        keys, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        if rest is not None:
            keys, nodes = np.append(rest[0], keys), np.append(rest[1], nodes)
        same = keys[1:] == keys[:-1]
        keep = np.append(same, False) | np.append(False, same)
        keep[0] |= paired
        rest, paired = (keys[-1:], nodes[-1:]), bool(keep[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][keep[:-1]]), pa.array(nodes[:-1][keep[:-1]])], ["k", "node"])
    if paired:
        yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1])], ["k", "node"])


def _compare(order: np.ndarray, run: np.ndarray, eights: np.ndarray, most: int, lags: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and differing bits of the pairs of a run that pass the count of bytes and the limit of bits, from
    fingerprints as numbers of eight bytes."""
    at, lag = np.arange(len(order)), 1
    while (lags is None or lag <= lags) and len(at := at[at + lag < len(order)]) and len(at := at[run[at] == run[at + lag]]):
        for begin in range(0, len(at), PIECE):
            a, b = order[at[begin : begin + PIECE]], order[at[begin : begin + PIECE] + lag]
            differing = eights[a] ^ eights[b]
            shared = np.bitwise_count((differing.view(np.uint8) == 0).view(np.uint64)).sum(1)
            ok = np.flatnonzero(shared >= MIN_BYTES)
            bits = np.bitwise_count(differing[ok]).sum(1, dtype=np.int64)
            near = bits <= most
            yield a[ok[near]], b[ok[near]], bits[near]
        lag += 1


def spanning_forest(u: np.ndarray, v: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indexes of a minimum spanning forest of the links; of equal costs the earlier counts as smaller."""
    by_cost = np.argsort(cost, kind="stable")
    nodes, ends = np.unique(np.concatenate([u[by_cost], v[by_cost]]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label, chosen = np.arange(len(nodes)), []
    while True:
        across = np.flatnonzero(label[a] != label[b])
        if not len(across):
            return by_cost[np.unique(np.concatenate(chosen))] if chosen else np.zeros(0, np.int64)
        best = np.full(len(nodes), len(u))
        np.minimum.at(best, label[a[across]], across)
        np.minimum.at(best, label[b[across]], across)
        taken = np.unique(best[best < len(u)])
        chosen.append(taken)
        while True:
            least = np.minimum(label[a[taken]], label[b[taken]])
            new = label.copy()
            np.minimum.at(new, label[a[taken]], least)
            np.minimum.at(new, label[b[taken]], least)
            new = new[new[label]]
            if (new == label).all():
                break
            label = new


def _hubs(run: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and differing bits of the links of each run's members to its hub, and of the others to theirs."""
    eights, at = fps.view(np.uint64), np.arange(len(run))
    for _ in range(HUBS):
        begins = np.flatnonzero(np.append(True, run[at][1:] != run[at][:-1]))
        sizes = np.diff(np.append(begins, len(at)))
        several = np.repeat(sizes > 2, sizes)  # a pair is compared anyway
        at, sizes = at[several], sizes[sizes > 2]
        if not len(at):
            return
        begins = np.cumsum(sizes) - sizes
        ones = np.add.reduceat(np.unpackbits(fps[at], axis=1), begins, axis=0, dtype=np.int32)
        middle = np.packbits(2 * ones > sizes[:, None], axis=1).view(np.uint64)
        away = np.bitwise_count(eights[at] ^ np.repeat(middle, sizes, axis=0)).sum(1, dtype=np.int64) << 32 | np.arange(len(at))
        hub = np.repeat(at[np.minimum.reduceat(away, begins) & 0xFFFFFFFF], sizes)
        differing = eights[at] ^ eights[hub]
        shared = np.bitwise_count((differing.view(np.uint8) == 0).view(np.uint64)).sum(1)
        bits = np.bitwise_count(differing).sum(1, dtype=np.int64)
        near = (shared >= MIN_BYTES) & (bits <= most)
        linked = near & (at != hub)
        yield at[linked], hub[linked], bits[linked]
        at = at[~near]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole lists from sorted rows; a list longer than PIECE comes in pieces."""
    rest = None
    for batch in batches:
        new = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2)))
        rest = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new, strict=True))
        cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
        if len(rest[0]) - cut > PIECE:
            cut = len(rest[0])
        if cut:
            yield tuple(x[:cut] for x in rest)
            rest = tuple(x[cut:] for x in rest)
    if rest is not None and len(rest[0]):
        yield rest


def _candidates(most: int, sure: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, fps in _lists(batches):
            begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(begins, len(keys)))
            run = np.repeat(np.arange(len(sizes)), sizes)
            long = np.repeat(sizes > WINDOW, sizes)
            whole, rest = np.flatnonzero(~long), np.flatnonzero(long)
            eights = fps.view(np.uint64)
            found = list(_compare(whole, run[whole], eights, most, None))
            for places in _ORDERS if len(rest) else []:
                order = rest[np.lexsort((*fps[rest][:, places].T, run[rest]))]
                found += _compare(order, run[order], eights, most, WINDOW)
            if not found:
                continue
            a, b, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            u, v = np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])
            kept = spanning_forest(u, v, bits)
            u, v, bits = u[kept], v[kept], bits[kept]
            for a, b, more in _hubs(run, fps, most):  # up to ``sure`` the forest holds what they would
                a, b, more = (x[more > sure] for x in (a, b, more))
                u, v = np.append(u, np.minimum(nodes[a], nodes[b])), np.append(v, np.maximum(nodes[a], nodes[b]))
                bits = np.append(bits, more)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(bits)], ["u", "v", "bits"])

    return find


def _sets(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return make


def _name(df: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the root of the node in ``column`` as ``out``."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return df.join(named, column, "left").withColumn(out, F.coalesce("_root", column)).drop("_root")


def _verified(docs: DataFrame, asked: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of the links ``u``, ``v`` those whose shingle sets have the similarity."""
    named = asked.select(F.col("u").alias("node")).unionByName(asked.select(F.col("v").alias("node"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(named, "node", "left_semi")
    sets = stage(texts.mapInArrow(_sets(width), "node long, shingles array<bigint>"), "shingles")
    sides = [sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in ("u", "v")]
    common = F.size(F.array_intersect("u_set", "v_set"))
    alike = common >= F.lit(similarity) * (F.size("u_set") + F.size("v_set") - common)
    return stage(asked.join(sides[0], "u").join(sides[1], "v").filter(alike).select("u", "v").distinct(), "verified")


def links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: links between nodes (node, fp, least) that yield their components at the similarity."""
    most = int(expected_bits(similarity) + 2.5 * _spread(similarity))
    sure = int(expected_bits(similarity) - 3 * _spread(similarity))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = nodes.select("node", "fp", "least").mapInArrow(_postings, "k long, node long").repartition(parts, "k").sortWithinPartitions("k")
    met = stage(lists.mapInArrow(_shared, "k long, node long"), "met").join(nodes.select("node", "fp", "least"), "node")
    dealt = met.select("k", "node", "fp").repartition(parts, "k").sortWithinPartitions("k", F.xxhash64("k", "node"))
    found = dealt.mapInArrow(_candidates(most, sure), "u long, v long, bits long").filter("u <> v")
    found = stage(found.groupBy("u", "v").agg(F.min("bits").alias("bits")), "near-links")
    certain = found.filter(F.col("bits") <= sure).select("u", "v")
    roots = stage(components(certain), "sure-roots")
    across = stage(_name(_name(found.filter(F.col("bits") > sure), roots, "u", "a"), roots, "v", "b").filter("a <> b"), "across")
    true, tried = _decided(docs, across, width, similarity)
    linked = certain.unionByName(true)
    return linked.unionByName(_left(docs, met, stage(components(linked), "near-roots"), tried, most, sure, width, similarity))


def _decided(docs: DataFrame, across: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of the links ``u``, ``v`` between groups ``a``, ``b`` those that have the similarity, but for such as lead from one
    group to another no more once others are known; and all whose similarity was looked at."""
    order = Window.partitionBy("group").orderBy("bits", "u", "v")
    sides = across.select(F.col("a").alias("group"), "u", "v", "bits").unionByName(across.select(F.col("b").alias("group"), "u", "v", "bits"))
    first = stage(sides.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= FIRST).select("u", "v").distinct(), "asked")
    true = _verified(docs, first, width, similarity)
    merged = stage(components(across.join(true, ["u", "v"], "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v"))), "merged-roots")
    rest = across.join(first, ["u", "v"], "left_anti").select("u", "v", "a", "b")
    rest = stage(_name(_name(rest, merged, "a", "a2"), merged, "b", "b2").filter("a2 <> b2").select("u", "v"), "asked")
    return true.unionByName(_verified(docs, rest, width, similarity)), first.unionByName(rest)


def _rest_of_lists(met: DataFrame, roots: DataFrame) -> DataFrame:
    """k, piece, node, root, home, main, fp, least of the members of lists. Lists of up to PIECE members are one piece. In a longer
    one members of its largest group (main) stand in one piece each, the others in every piece, at home in one."""
    named = _name(met, roots, "node", "root")
    long = stage(met.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PIECE), "long-lists")
    rows = named.withColumns({"piece": F.lit(0), "home": F.lit(True), "main": F.lit(None).cast("long")})
    if long.limit(1).count():
        several = named.join(long, "k").groupBy("k", "root", "n").agg(F.count(F.lit(1)).alias("own")).groupBy("k", "n").agg(F.max(F.struct("own", "root"))["root"].alias("main"))
        pieces = F.ceil(F.col("n") / PIECE).cast("int")
        split = named.join(several, "k").withColumn("own", F.pmod(F.xxhash64("node"), pieces).cast("int"))
        every = F.when(F.col("root") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), pieces - 1))
        split = split.withColumn("piece", F.explode(every)).withColumn("home", F.col("own") == F.col("piece"))
        rows = rows.join(long, "k", "left_anti").unionByName(split.select(*rows.columns))
    return rows.select("k", "piece", "node", "root", "home", "main", "fp", "least")


def _first_list(fps: tuple[np.ndarray, np.ndarray], least: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Key of the first list that holds both of each two texts."""
    same, alike = fps[0] == fps[1], least[0] == least[1]
    both = alike[:, np.arange(LISTS) % LEAST]
    for place in range(3):
        both &= same[:, _CHOICES[:, place]]
    first = both.argmax(1)
    keys = first << 24
    for place in range(3):
        keys = keys | fps[0][np.arange(len(first)), _CHOICES[first, place]].astype(np.int64) << 8 * place
    return (keys.view(np.uint64) * _STEP ^ least[0][np.arange(len(first)), first % LEAST]).view(np.int64)


def _across(most: int):
    """u, v, a, b, bits of the pairs that stand in different groups (a, b) and pass the count of bytes and the limit of bits,
    each from the first list that holds both; from rows sorted by list and piece."""

    def pairs(k: int, node: np.ndarray, root: np.ndarray, home: np.ndarray, main: int, fps: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        eights, there, strays = fps.view(np.uint64), np.flatnonzero(home), np.flatnonzero(root != main)
        step = max(1, PIECE * WINDOW // max(1, len(there)))
        for i in range(0, len(strays), step):
            here = strays[i : i + step]
            differing = np.zeros((len(here), len(there)), np.uint16)
            for word in range(BYTES // 8):
                differing += np.bitwise_count(eights[here, word][:, None] ^ eights[there, word][None, :])
            x, y = np.nonzero((differing <= most) & (root[here][:, None] != root[there][None, :]))
            bits, x, y = differing[x, y].astype(np.int64), here[x], there[y]
            for j in range(0, len(x), PIECE):
                one, two = x[j : j + PIECE], y[j : j + PIECE]
                ok = (fps[one] == fps[two]).sum(1) >= MIN_BYTES
                ok &= _first_list((fps[one], fps[two]), (least[one], least[two])) == k
                ok &= (root[two] == main) | (node[one] < node[two]) | ~home[one]  # two strays at home here meet twice
                one, two, own = one[ok], two[ok], bits[j : j + PIECE][ok]
                low, high = np.where(node[one] < node[two], one, two), np.where(node[one] < node[two], two, one)
                yield node[low], node[high], root[low], root[high], own

    def settle(rows: list[np.ndarray], begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(begins) > 1:
            part = rows[3][: begins[-1]]
            mixed = np.minimum.reduceat(part, begins[:-1]) != np.maximum.reduceat(part, begins[:-1])
            for begin, end in zip(begins[:-1][mixed].tolist(), begins[1:][mixed].tolist(), strict=True):
                k, _, node, root, home, main, fps, least, lone = (x[begin:end] for x in rows)
                if lone[0]:
                    names, times = np.unique(root, return_counts=True)
                    main = names[times == times.max()]
                for found in pairs(int(k[0]), node, root, home, int(main[0]), fps, least):
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v", "a", "b", "bits"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            lone = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            new += [batch.column(5).fill_null(0).to_numpy(), _matrix(batch.column(6)), _matrix(batch.column(7)).view(np.uint64), lone]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            begins = np.flatnonzero(np.append(True, (rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])))
            yield from settle(rest, begins)
            rest = [x[begins[-1] :] for x in rest]
        if rest is not None:
            yield from settle(rest, np.array([0, len(rest[0])]))

    return find


def _left(docs: DataFrame, met: DataFrame, roots: DataFrame, tried: DataFrame, most: int, sure: int, width: int, similarity: float) -> DataFrame:
    """u, v: the links between groups that the forests, windows and pieces of the lists have left out."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _rest_of_lists(met, roots).repartition(parts, "k", "piece").sortWithinPartitions("k", "piece")
    found = rows.mapInArrow(_across(most), "u long, v long, a long, b long, bits long").dropDuplicates(["u", "v"])
    found = stage(found.join(tried, ["u", "v"], "left_anti"), "left")
    certain = found.filter(F.col("bits") <= sure).select("u", "v")
    merged = stage(components(found.filter(F.col("bits") <= sure).select(F.col("a").alias("u"), F.col("b").alias("v"))), "left-roots")
    rest = found.filter(F.col("bits") > sure).select("u", "v", "bits", F.col("a").alias("_a"), F.col("b").alias("_b"))
    rest = stage(_name(_name(rest, merged, "_a", "a"), merged, "_b", "b").filter("a <> b").select("u", "v", "a", "b", "bits"), "across")
    return certain.unionByName(_decided(docs, rest, width, similarity)[0])


def similar_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its near duplicates, itself included) for every row with an id."""
    rows = stage(sketches(docs.filter(F.col("doc_id").isNotNull()), width), "sketches")
    nodes = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("least").alias("least")), "sketch-nodes")
    roots = stage(components(links(docs, nodes, width, similarity)), "similar-roots")
    named = _name(nodes.select("digest", "node"), roots, "node", "component_id")
    return rows.join(named, "digest").select("doc_id", "component_id")


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the smallest id of their near duplicates, rows as they are, and rows without an id."""
    key = unused(docs.columns, "_gone")
    gone = similar_groups(docs, width, similarity).filter("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.withColumn(key, F.col("doc_id").cast("long"))
    lone = named.filter(F.col(key).isNull())
    return lone.unionByName(named.filter(F.col(key).isNotNull()).join(gone, key, "left_anti")).select(*(F.col(f"`{c}`") for c in docs.columns))

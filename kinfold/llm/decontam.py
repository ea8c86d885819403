"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of 40 words, each starting 20 words after the one before; a benchmark
item of more than 40 words is cut likewise, a shorter one is one passage. Documents are cut into words
once and written as the numbers of the benchmark's words (0 for all others), which is all that the later
steps read. Benchmark passages fall into blocks of a few hundred, each with a latent space of its own:
passages are TF-IDF vectors over the block's vocabulary, with document frequencies counted over all
documents. A distributed randomised SVD gives the space. Its first step goes over every passage of every
document: each is added, with a random sign, to one of ``SKETCH`` rows (a sparse random test matrix, so that the
rows span what the passages do, and no passage is left out). A seeded Gaussian range finder with power steps, each step one
Spark job, finishes it over those rows and the block's passages. Every passage of every document is compared with every benchmark passage by
cosine there, in blocks of matrix products.

The space holds only a share of a passage's length, so a fixed cosine gives no guarantee. Each
benchmark passage also has postings of its rarest words: what is verified must hold a given share of its
weight, hence a smaller share of that of those words. Each place with that share is a candidate whatever
its cosine, so no leak is lost.

Candidates are verified on their words. A leak holds MIN_SHARE of the benchmark passage's weight (each word
weighs its inverse document frequency, so that common words in common prove little), and common
subsequences with its halves, in either order, of MIN_LCS of its words, or of FULL_LCS whatever they weigh; for
a weaker paraphrase less will do where the answer (column ``answer``, else the last sentence) is found whole.

The blocks of one scan are sent to the executors together; a benchmark of more passages or terms than
a scan takes needs several. Null and empty texts match nothing, as do benchmark items with no word; without
documents, or without items, there is no row. Words are runs of letters and digits, lower-cased. Repeated
rows yield repeated results; of passages of one pair the best values are returned, so ties make no
difference. Long texts are searched whole, at a cost in proportion. Other columns, whatever their names,
are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import stage, unused

PASSAGE, STRIDE = 40, 20
#: Latent dimensions at most.
DIMENSIONS, EXTRA, POWER_STEPS = 224, 16, 2
SEED = 5
#: Benchmark passages with one latent space at most.
BLOCK = 320
#: Benchmark passages, and terms of the benchmark, that one scan takes, about.
SCAN, MAX_TERMS = 4_000, 500_000
#: Rows that all document passages are added up to for a latent space, and the passages that they weigh as much as there, at most.
SKETCH, FITTED_WEIGHT = 512, 1000
#: Words that are added up at once, about.
SLICE = 1 << 16
#: Cosine from which a candidate is verified; less for benchmark passages of less than half a passage's words.
MIN_COSINE = 0.2
#: Shares of a benchmark passage that must be found, of its weight and in common subsequences: enough alone, and with the answer.
MIN_SHARE, MIN_SHARE_ANSWER = 0.55, 0.45
MIN_LCS, MIN_LCS_ANSWER = 0.5, 0.4
#: So much in common subsequences is enough whatever its weight.
FULL_LCS = 0.7
#: Passages of fewer words must be found whole.
SHORT = 8

#: A place that can be verified holds a share of a passage's weight; the search asks for one in POSTED of it among the rarest words.
POSTED = 2.5
#: Chunks of STRIDE words that a benchmark passage's words may reach beyond a document passage.
REACH = -(-PASSAGE // STRIDE)

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def cut(tokens: list) -> list[tuple[int, list]]:
    """(start, words) of the passages of a text."""
    return [(at, tokens[at : at + PASSAGE]) for at in range(0, max(1, len(tokens) - PASSAGE + STRIDE), STRIDE)] if len(tokens) else []


def lcs(pattern: list, text: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for w in text:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(pattern) - row.bit_count()


def within(part: list, text: list) -> bool:
    """Whether a list of words stands in another in one piece."""
    return bool(part) and any(text[i : i + len(part)] == part for i in range(len(text) - len(part) + 1))


def benchmark_passages(benchmark: DataFrame) -> DataFrame:
    """item_id, part, words (array), answer (array) of every passage of the benchmark."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text, said in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if said is None:
                    said = next((s for s in reversed(_SENTENCE.split(text or "")) if words(s)), "")
                out += [(item, i, part, words(said)) for i, (_, part) in enumerate(cut(words(text)))]
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "part", "words", "answer"])

    base = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.cast("string").alias("answer"))
    return base.mapInArrow(rows, "item_id long, part int, words array<string>, answer array<string>")


def numbered(docs: DataFrame, vocabulary, n_terms: int) -> DataFrame:
    """doc_id, ids: the words of each document as numbers of 2 or 4 bytes, 0 for words that ``vocabulary``
    (broadcast) doesn't have."""
    kind = _kind(n_terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            ids = []
            for text in batch.column(1):
                tokens = words(text.as_py())
                ids.append(np.fromiter(map(get, tokens, repeat(0)), kind, len(tokens)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ids binary")


def _kind(n_terms: int) -> str:
    return "<u2" if n_terms < 1 << 16 else "<u4"


def document_frequencies(rows: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, the number of documents with a word, and of all passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for data in batch.column(0):
                ids = np.frombuffer(data.as_py(), _kind(n_terms))
                some = np.unique(ids)
                found[some] += 1
                found[0] += len(some) > 0 and some[0] != 0  # else 0 is among them
                found[-1] += max(-(-len(ids) // STRIDE) - 1, len(ids) > 0)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["c", "n"])

    made = rows.select("ids").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # a scan's terms at most
    out = np.zeros(n_terms + 2, np.int64)
    out[made.column("c").to_numpy()] = made.column("n").to_numpy()
    n, passages, out[0] = int(out[0]), int(out[-1]), 0
    return out[:-1], n, passages


def randomised_svd(rows: DataFrame, columns: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Right singular vectors (columns x dimensions) of the matrix whose rows are (cols from 1, weights).

    Each step multiplies the rows, where they are, with a thin matrix and adds up the thin results;
    the driver only orthogonalises those, which have as many rows as there are columns."""
    spark = rows.sparkSession
    dimensions = min(dimensions, columns)
    width = min(dimensions + EXTRA, columns)

    def product(thin: np.ndarray, gram: bool) -> np.ndarray:
        sent = spark.sparkContext.broadcast(thin)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            total = np.zeros((width if gram else len(q), width))
            for batch in batches:
                for begin in range(0, batch.num_rows, 128):
                    part = batch.slice(begin, 128)
                    sizes = pc.list_value_length(part.column(0)).to_numpy(zero_copy_only=False)
                    x = np.zeros((len(sizes), len(q)))
                    x[np.repeat(np.arange(len(sizes)), sizes), part.column(0).flatten().to_numpy() - 1] = part.column(1).flatten().to_numpy()
                    y = x @ q
                    total += (y if gram else x).T @ y
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], ["i", "v"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(k, np.sum(np.stack(list(g)), axis=0)) for k, g in pdf.groupby("i")["v"]], columns=["i", "v"])

        parts = rows.mapInArrow(multiply, "i int, v array<double>")
        parts = parts.groupBy((F.col("i") % 64).alias("b")).applyInPandas(lambda pdf: add(pdf[["i", "v"]]), "i int, v array<double>")
        out = np.zeros((width if gram else len(thin), width))
        for i, v in parts.toPandas().itertuples(index=False):
            out[int(i)] = v
        return out

    q = np.random.Generator(np.random.PCG64(SEED)).standard_normal((columns, width))
    for _ in range(POWER_STEPS):
        q, _ = np.linalg.qr(product(q, False))
    values, vectors = np.linalg.eigh(product(q, True))
    order = np.argsort(-values)[:dimensions]
    return q @ vectors[:, order]


def _sketch(rows: DataFrame, sent, kind: str) -> DataFrame:
    """v: the unit vectors of all passages (lengths as in the search), each added with a random sign, by its document's id and
    its place there, to one of ``SKETCH`` rows. ``sent``: the column of each term (from 1; 0: none), the weights of the
    columns, squared weights of terms for lengths."""

    def add_texts(total: np.ndarray, names: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> None:
        row_of, weights, square = sent.value
        chunks = -(-sizes // STRIDE)
        first = np.cumsum(chunks) - chunks
        ids = np.zeros(chunks.sum() * STRIDE, np.int64)
        ids[np.arange(len(tokens)) + np.repeat(first * STRIDE - np.cumsum(sizes) + sizes, sizes)] = tokens
        doc = np.repeat(np.arange(len(chunks)), chunks)
        sums = np.add.reduce(square[ids].reshape(-1, STRIDE), axis=1, dtype=np.float64)
        goes_on = np.append(doc[1:] == doc[:-1], False)  # a passage is this chunk and the next, or the only one
        lengths = np.sqrt(np.maximum(sums + goes_on * np.append(sums[1:], 0), 1e-9))
        scale = (goes_on | (chunks[doc] == 1)) / lengths
        x = names[doc] + (np.arange(1, len(doc) + 1) - first[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        scale[x >> np.uint64(63) == 1] *= -1
        begin = (x % np.uint64(SKETCH)).astype(np.int64) * len(weights)
        cols = row_of[ids]
        known = np.flatnonzero(cols)
        chunk, cols = known // STRIDE, cols[known] - 1
        np.add.at(total, begin[chunk] + cols, scale[chunk] * weights[cols])
        second = np.append(False, goes_on[:-1])[chunk]
        chunk, cols = chunk[second] - 1, cols[second]
        np.add.at(total, begin[chunk] + cols, scale[chunk] * weights[cols])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH * len(sent.value[1]))
        for batch in batches:
            names = np.array([(x or 0) & 0xFFFFFFFFFFFFFFFF for x in batch.column(0).to_pylist()], np.uint64)
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
            some = np.flatnonzero(sizes)
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(sizes[some]) // SLICE)) + 1):
                if len(part):
                    add_texts(total, names[part], sizes[part], np.frombuffer(b"".join(batch.column(1).take(pa.array(part)).to_pylist()), kind))
        total = total.reshape(SKETCH, -1).astype(np.float32)
        some = np.flatnonzero(total.any(1))
        for at in range(0, len(some), 64):
            part = some[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([v.tobytes() for v in total[part]], pa.binary())], ["r", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}  # a few rows of the sketch
        for batch in batches:
            for r, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(v.as_py(), np.float32)
                sums[r] = sums[r] + v if r in sums else v.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["v"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(add, "r int, v binary").repartition(parts, "r").mapInArrow(merge, "v binary")


def _fitted(scale: float):
    """The rows of a sketch, scaled, as (cols from 1, weights)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.frombuffer(v.as_py()) * scale for v in batch.column(0)]
            cols = [np.flatnonzero(v).astype(np.int32) + np.int32(1) for v in vectors]
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.list_(pa.int32())), pa.array([v[at - 1] for v, at in zip(vectors, cols, strict=True)], pa.list_(pa.float64()))], ["cols", "weights"])

    return rows


#: A benchmark passage: its item, its words and its answer's as numbers.
Passage = tuple[int, list[int], list[int]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE, max_terms: int = MAX_TERMS, scan: int = SCAN) -> DataFrame:
    """doc_id, item_id, cosine, share, lcs, answer_found: one row per document (row) and item that it leaks,
    with the best values over their passages."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, share double, lcs double, answer_found boolean"
    passages = stage(benchmark_passages(benchmark), "benchmark-passages")
    said = passages.select(F.explode(F.concat("words", "answer")).alias("w"))
    total, n_terms = passages.count(), said.distinct().count()
    if not n_terms or not total:
        return spark.createDataFrame([], schema)
    parts = min(total, -(-n_terms // max_terms))  # of the benchmark, each with a vocabulary and a scan of the texts
    scans = max(1, -(-total // (parts * scan)))  # of each part, over the numbered words
    out = None
    dealt = F.xxhash64("item_id")  # an item's passages share a scan
    for part in range(parts):
        mine = passages.filter(F.pmod(dealt, F.lit(parts)) == part) if parts > 1 else passages
        terms = {r["w"]: i for i, r in enumerate(mine.select(F.explode(F.concat("words", "answer")).alias("w")).distinct().orderBy("w").collect(), 1)}
        rows = stage(numbered(docs, spark.sparkContext.broadcast(terms), len(terms)), "numbered")
        df, n, n_passages = document_frequencies(rows, len(terms))
        idf = np.log((n + 1) / (df + 1)) + 0.1
        for b in range(scans):
            held = mine.filter(F.pmod(F.shiftright(dealt, 20), F.lit(scans)) == b).collect() if scans > 1 else mine.collect()
            held.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["part"], r["words"]))
            items = [(r["item_id"], [terms[w] for w in r["words"]], [terms[w] for w in r["answer"]]) for r in held]
            if not items:
                continue
            size = -(-len(items) // -(-len(items) // BLOCK))
            spaces = [_space(rows, n_passages, items[at : at + size], idf) for at in range(0, len(items), size)]
            sent = spark.sparkContext.broadcast((items, idf, spaces, _postings(items, idf)))
            found = rows.mapInArrow(_search(sent, _kind(len(terms)), min_cosine), schema)
            out = found if out is None else out.unionByName(found)
    return out


def _square(idf: np.ndarray) -> np.ndarray:
    """Squared weights of terms for lengths; words outside the benchmark weigh the most."""
    square = (idf**2).astype(np.float32)
    square[0] = square.max()
    return square


def _space(texts: DataFrame, n_passages: int, items: list[Passage], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The latent space of a block of benchmark passages: the row of each term of the scan (0: none), the
    rows, weighted, and the passages' unit vectors (columns). Fitted on those passages and all of the texts'."""
    spark, kind = texts.sparkSession, _kind(len(idf) - 1)
    held = np.unique(np.concatenate([part for _, part, _ in items]).astype(np.int64))
    row_of = np.zeros(len(idf), np.int32)
    row_of[held] = np.arange(1, len(held) + 1)
    weights = np.concatenate([[0.0], idf[held]])
    sketch = stage(_sketch(texts, spark.sparkContext.broadcast((row_of, weights[1:], _square(idf))), kind), "sketch")
    vectors = []
    for _, part, _ in items:
        some, counts = np.unique(row_of[part], return_counts=True)
        x = counts * weights[some]
        vectors.append((some.tolist(), (x / (np.linalg.norm(x) or 1)).tolist()))
    scale = math.sqrt(min(1.0, FITTED_WEIGHT / max(1, n_passages)))
    schema = "cols array<int>, weights array<double>"
    fitted = sketch.mapInArrow(_fitted(scale), schema).unionByName(spark.createDataFrame(vectors, schema))
    basis = randomised_svd(stage(fitted.coalesce(16), "tfidf"), len(held))  # SKETCH and BLOCK rows at most
    basis = np.vstack([np.zeros((1, basis.shape[1])), basis]) * weights[:, None]
    known = np.array([basis[row_of[part]].sum(0) for _, part, _ in items])
    known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-9)
    return row_of, np.ascontiguousarray(basis, np.float32), known.T.astype(np.float32)


def _word_weights(part: list[int], idf: np.ndarray) -> dict[int, float]:
    """The share of a passage's weight that each of its words has."""
    total = sum(idf[t] for t in part)
    return {t: n * float(idf[t]) / total for t, n in Counter(part).items()}


def _least_share(part: list[int], answer: list[int], weights: dict[int, float]) -> float:
    """The share of a benchmark passage's weight that a place which can be verified holds."""
    if len(part) < SHORT:
        return 1.0
    counts = Counter(part)
    each = sorted(w / counts[t] for t, w in weights.items() for _ in range(counts[t]))
    return min(MIN_SHARE_ANSWER if len(answer) > 2 else MIN_SHARE, sum(each[: math.ceil(FULL_LCS * len(part) - 1e-9)]))


def _postings(items: list[Passage], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by term, passages, weights, least): a place that can be verified for passage i has terms
    whose weights there add up to least[i]. It may lack 1 - share of the weight, so of rarest words with
    1 - share + x it holds x."""
    rows, least = [], np.zeros(len(items))
    for i, (_, part, answer) in enumerate(items):
        weights = _word_weights(part, idf)
        share, posted = _least_share(part, answer, weights), 0.0
        for t, weight in sorted(weights.items(), key=lambda x: (-idf[x[0]], x[0])):
            rows.append((t, i, weight))
            posted += weight
            if posted >= 1 - share + share / POSTED:
                break
        least[i] = posted - (1 - share) - 1e-9
    rows.sort()
    term, passage, weight = (np.array([r[k] for r in rows]) for k in range(3))
    return np.searchsorted(term, np.arange(len(idf) + 1)), passage, weight, least


def _posted(ids: np.ndarray, n_passages: int, postings: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document passage, benchmark passage) pairs with the least weight of postings near the document passage."""
    offsets, passage, weight, least = postings
    counts = offsets[ids + 1] - offsets[ids]
    at = np.flatnonzero(counts)
    counts = counts[at]
    rows = np.repeat(offsets[ids[at]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    i, w, chunk = passage[rows], weight[rows], np.repeat(at // STRIDE, counts)
    enough = np.bincount(i, w, len(least)) >= least
    some = np.flatnonzero(enough)
    if not len(some):
        return some, some
    mine = enough[i]
    i, w, chunk = (np.cumsum(enough) - 1)[i[mine]], w[mine], chunk[mine]
    # A benchmark passage's words reach at most REACH chunks before a document passage's two, or after them.
    wide = n_passages + 2 * REACH + 2
    sums = np.bincount(i * wide + chunk + REACH + 1, w, len(some) * wide).reshape(len(some), wide).cumsum(1)
    near = sums[:, 2 * REACH + 2 :][:, :n_passages] - sums[:, :n_passages]
    i, p = np.nonzero(near >= least[some][:, None] - 1e-9)
    return p, some[i]


def halves(part: list[int], near: list[int]) -> float:
    """Share of a passage's words in the common subsequences of its halves with a text."""
    middle = len(part) // 2
    return (lcs(part[:middle], near) + lcs(part[middle:], near)) / len(part)


def verify(part: list[int], answer: list[int], weights: dict[int, float], least: float, near: list[int]) -> tuple[float, float, bool] | None:
    """(share, lcs, answer found) of a benchmark passage at a place that leaks it; None elsewhere. Words are
    numbers, 0 for one that no benchmark item has."""
    held = set(near)
    share = sum([w for t, w in weights.items() if t in held])
    if share < least - 1e-9:
        return None
    if len(part) < SHORT:
        return (share, 1.0, within(answer, near)) if within(part, near) else None
    common, answered = halves(part, near), within(answer, near)
    enough = common >= FULL_LCS or share >= MIN_SHARE - 1e-9 and common >= MIN_LCS or answered and len(answer) > 2 and share >= MIN_SHARE_ANSWER - 1e-9 and common >= MIN_LCS_ANSWER
    return (share, common, answered) if enough else None


def _chunk_sums(basis: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of a matrix, STRIDE by STRIDE, a few hundred rows at a time so that they stay in the cache."""
    out, held = np.empty((len(at) // STRIDE, basis.shape[1]), basis.dtype), np.empty((20 * STRIDE, basis.shape[1]), basis.dtype)
    for begin in range(0, len(at), len(held)):
        part = at[begin : begin + len(held)]
        rows = np.take(basis, part, axis=0, out=held[: len(part)], mode="clip")  # with another mode numpy copies once more
        np.add.reduce(rows.reshape(-1, STRIDE, basis.shape[1]), axis=1, out=out[begin // STRIDE : begin // STRIDE + len(rows) // STRIDE])
    return out


def _search(sent, kind: str, min_cosine: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, spaces, postings = sent.value
        weights = [_word_weights(part, idf) for _, part, _ in items]
        shares = [_least_share(part, answer, w) for (_, part, answer), w in zip(items, weights, strict=True)]
        least = min_cosine * np.sqrt(np.minimum(1.0, np.array([len(part) for _, part, _ in items]) / STRIDE)).astype(np.float32)
        square = _square(idf)
        for batch in batches:
            found = {}
            for row, data in enumerate(batch.column(1)):
                tokens = np.frombuffer(data.as_py(), kind).astype(np.int32)
                if not len(tokens):
                    continue
                ids = np.zeros(-(-len(tokens) // STRIDE) * STRIDE, np.int32)
                ids[: len(tokens)] = tokens
                squares = np.add.reduce(square[ids].reshape(-1, STRIDE), axis=1)
                if len(squares) > 1:
                    squares = squares[:-1] + squares[1:]
                scale = 1 / np.sqrt(np.maximum(squares, 1e-9))[:, None]
                cosines = []
                for row_of, basis, known in spaces:
                    chunks = _chunk_sums(basis, row_of[ids])
                    if len(chunks) > 1:
                        chunks = chunks[:-1] + chunks[1:]
                    cosines.append((chunks * scale) @ known)
                cosines = cosines[0] if len(cosines) == 1 else np.concatenate(cosines, axis=1)
                near_by = cosines >= least
                near_by[_posted(ids, len(cosines), postings)] = True
                for p, i in np.argwhere(near_by).tolist():
                    item, part, answer = items[i]
                    near = tokens[max(0, p * STRIDE - len(part)) : p * STRIDE + PASSAGE + len(part)].tolist()
                    values = verify(part, answer, weights[i], shares[i], near)
                    if values:
                        values = (float(cosines[p, i]), *values)
                        found[row, item] = tuple(map(max, found.get((row, item), values), values))
            ids = batch.column(0).to_pylist()
            values = list(found.values())
            cols = [pa.array([ids[r] for r, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())]
            cols += [pa.array([v[k] for v in values], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "cosine", "share", "lcs", "answer_found"])

    return scan


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op5: one row per leak: doc_id, item_id, cosine, share, lcs, answer_found."""
    return find_leaks(docs, benchmark)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no benchmark item, with their columns as they are. Rows with a null id that
    leak go by their text."""
    key = unused(docs.columns, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaks = find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

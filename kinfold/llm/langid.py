"""Language ID with hyperdimensional profiles.

Every letter has a fixed random vector of +1/-1; position in an n-gram is coded by permuting
(rotating) the letter's vector, and the n-gram is the product (binding) of its letters' vectors.
A document is the sum (bundle) of its n-grams, a language the sum of its documents' n-grams, and a
document takes the language of the nearest prototype by cosine.

A text is lower-cased, and each run of other characters is one boundary symbol. Null texts and
texts without a letter are ``und`` with score 0, and so is everything if no labelled row was given.
Ties go to the first language in code point order. Rows with equal ids or texts each get their row; an
empty table gives none. Long texts are read whole. Columns other than doc_id, text and (for learning) lang,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_fold, unused

DIMENSIONS = 1024
SEED = 7
#: Most labelled documents that ``query`` bundles prototypes from: those with the smallest hashes of their ids.
MAX_LABELLED = 30_000
#: n-gram vectors that a task keeps at hand.
KEPT_GRAMS = 30_000
#: n-grams of labelled texts that are added up before they are bundled, about, and distinct ones bundled at once.
TOGETHER, AT_ONCE = 1 << 19, 4096


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(4096)
def letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS)
    return (2 * bits - 1).astype(np.float32)


def gram_vector(code: int) -> np.ndarray:
    """Bound vector of a trigram, packed as three 21-bit code points."""
    a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and how often each comes; none for a text without a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letters = _letters()[points]
    if not letters.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.where(letters, points, 0).astype(np.int64)
    points = points[np.append(True, letters[1:] | letters[:-1])]
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)


class GramTable:
    """Vectors of the n-grams met so far; it starts anew when it is full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((4096, DIMENSIONS), np.float32)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(grams) > KEPT_GRAMS and self.rows:
            self.clear()
        at = []
        for g in grams.tolist():
            row = self.rows.get(g)
            if row is None:
                row = self.rows[g] = len(self.rows)
                if row == len(self.vectors):
                    self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[row] = gram_vector(g)
            at.append(row)
        return counts.astype(np.float32) @ self.vectors[at]


def learn_prototypes(docs: DataFrame, max_labelled: int | None = MAX_LABELLED) -> dict[str, np.ndarray]:
    """Prototypes of the languages of ``docs`` (text, lang), bundled in the tasks and summed by
    Spark; what comes to the driver is one vector per language. None: of all labelled rows."""
    labelled = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    if max_labelled is not None and (n := labelled.count()) > max_labelled:
        share = int(max_labelled / n * (1 << 32))
        labelled = labelled.filter(F.xxhash64(F.col("doc_id"), F.lit("fit")).bitwiseAND(F.lit(0xFFFFFFFF)) < share)

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums, held, n = GramTable(), {}, {}, 0

        def add() -> None:
            for lang, found in held.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in found]))
                made = sums.setdefault(lang, np.zeros(DIMENSIONS))
                for begin in range(0, len(grams), AT_ONCE):
                    made += table.bundle(grams[begin : begin + AT_ONCE], counts[begin : begin + AT_ONCE])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                grams, counts = trigrams(text)
                if len(grams):
                    held.setdefault(lang, []).append((grams, counts))
                    n += int(counts.sum())
                    if n >= TOGETHER:
                        add()
                        n = 0
        add()
        for lang, made in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.rint(made).astype(np.int64))], ["lang", "i", "v"])

    parts = labelled.mapInArrow(bundles, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for row in parts.collect():  # DIMENSIONS numbers per language
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["i"]] = row["v"]
    return {lang: found[lang] for lang in sorted(found)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest prototype, 0 at least)."""
    names = list(prototypes)
    matrix = np.array([v / (np.linalg.norm(v) or 1) for v in prototypes.values()], np.float32).reshape(len(names), DIMENSIONS)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GramTable()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                grams, counts = trigrams(text or "")
                if not len(grams) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                made = table.bundle(grams, counts)
                cosines = matrix @ made / (float(np.linalg.norm(made)) or 1.0)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    """op10: doc_id, held_out, lang_pred, score. Rows with a null id are neither learned nor held out."""
    fold = id_fold("doc_id", 4)
    found = identify(docs, learn_prototypes(docs.filter(fold != 2)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose text has a language, with their columns as they are: all but those found ``und``. Every
    labelled row that is not held out is learned from."""
    key = unused(docs.columns, "_key")
    prototypes = learn_prototypes(docs.filter(id_fold("doc_id", 4) != 2), None)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    unknown = identify(keyed.select(F.col(key).alias("doc_id"), "text"), prototypes).filter("lang_pred = 'und'")
    return keyed.join(unknown.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

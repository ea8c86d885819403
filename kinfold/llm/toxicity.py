"""Toxicity from a learned lexicon, misspellings included, weighed by context.

Terms (words and word beginnings) that come far more often in documents labelled toxic are learned
from labelled documents and put into a trie. Words are run through the Levenshtein automaton of the
trie, the set of (trie node, edits so far) made deterministic as words need it, so one pass over a
word's letters tells whether it is within an edit of a term. Every hit is judged in a window of words
around it: inside quotation marks or beside words of reporting it counts as quoted, else as direct.
A logistic regression over the sums, counts and densest window gives the score.

Lexicon and regression are learned from different parts of at most ``max_labelled`` labelled
documents, those with the smallest hashes of their ids. Without both labels the score is 0 everywhere.
Null and empty texts get the score of a text without hits. Repeated rows each get their row; an id with several
labels counts as toxic if one is. Of several terms at one distance of a word the heaviest counts, then the last in code
point order. Texts are read whole, whatever their length. An empty table gives no row. Columns other than doc_id,
text and (for learning) toxic, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_fold

MAX_LABELLED = 12_000
#: A term must be labelled this often, and this far from chance (likelihood ratio).
MIN_TOXIC = 4
MIN_EVIDENCE = 14.0
#: Terms of this length and more are also matched with one edit.
FUZZY_LENGTH = 5
PREFIXES = (4, 5, 6, 7)
WINDOW = 8
QUOTES = "\"“”«»„"
#: Words that report what others said.
REPORTING = frozenset(["said", "says", "called", "calls", "quoted", "wrote", "word", "term", "reported", "dijo", "llamó", "dit", "appelé", "sagte", "nannte"])
#: Words and automaton states that a task keeps at hand.
MEMO = 200_000

_TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES}]")


class LexiconAutomaton:
    """Levenshtein automaton (one edit) of a trie of terms, determinised as it is used."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in terms:
            if not term.endswith("*"):
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                    node = self.children[node][c]
                self.term[node] = term
        self.reset()

    def reset(self) -> None:
        self.states: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        exact = {n for n, e in items if e == 0}
        items |= {(child, 1) for n in exact for child in self.children[n].values()}  # the word lacks a letter
        key = frozenset((n, e) for n, e in items if e == 0 or n not in exact)
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        to = set()
        for n, e in self.states[state]:
            if c in self.children[n]:
                to.add((self.children[n][c], e))
            if e == 0:
                to.add((n, 1))  # a letter too many
                to |= {(child, 1) for child in self.children[n].values()}  # another letter
        self.moves[state][c] = made = self._state(to) if to else -1
        return made

    def match(self, word: str) -> tuple[str | None, int]:
        """The nearest term and its edits (0 or 1); of several the heaviest."""
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return None, 0
            state = to
        best = (None, 0)
        for n, e in self.states[state]:
            t = self.term[n]
            if t is None or e and len(t) < FUZZY_LENGTH:
                continue
            if best[0] is None or (-e, self.terms[t], t) > (-best[1], self.terms[best[0]], best[0]):
                best = (t, e)
        return best


class Scorer:
    """Features of a text under a lexicon."""

    FEATURES = 9

    def __init__(self, terms: dict[str, float]):
        self.terms, self.automaton, self.memo = terms, LexiconAutomaton(terms), {}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}

    def weigh(self, word: str) -> tuple[float, int]:
        """Weight of a word and how it hit: 0 not, 1 exactly, 2 by its beginning, 3 with an edit."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(self.automaton.states) >= MEMO:
                self.automaton.reset()
            term, edits = self.automaton.match(word)
            stem = max((self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) > n), default=0.0)
            if term and not edits:
                found = (self.terms[term], 1)
            elif stem:
                found = (stem, 2)
            else:
                found = (self.terms[term], 3) if term else (0.0, 0)
            self.memo[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        tokens = _TOKEN.findall((text or "").lower())
        weigh, quotes = self.weigh, [i for i, t in enumerate(tokens) if t in QUOTES]
        hits = [(i, w, how) for i, t in enumerate(tokens) if (found := weigh(t))[1] for w, how in (found,)]
        n = max(1, len(tokens) - len(quotes))
        direct = quoted = fuzzy = stems = 0.0
        seen, at, nth = {}, [], 0
        for i, w, how in hits:
            while nth < len(quotes) and quotes[nth] < i:
                nth += 1
            inside = nth % 2 == 1 and nth < len(quotes) and quotes[nth] - quotes[nth - 1] <= 4 * WINDOW
            if inside or not REPORTING.isdisjoint(tokens[max(0, i - WINDOW) : i]):
                quoted += w
                continue
            at.append((i, w))
            seen[tokens[i]] = w
            if how == 1:
                direct += w
            elif how == 2:
                stems += w
            else:
                fuzzy += w
        dense, low, inside = 0.0, 0, 0.0
        for i, w in at:
            inside += w
            while at[low][0] < i - 4 * WINDOW:
                inside -= at[low][1]
                low += 1
            dense = max(dense, inside)
        total = direct + stems + fuzzy
        return [math.log1p(direct), math.log1p(stems), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * direct / n), math.log1p(100 * (stems + fuzzy) / n), math.log1p(dense), math.log1p(sum(seen.values())), float(total > 0)]


def _evidence(n_pos: int, n_neg: int):
    """Likelihood ratio of a term's counts ``pos`` and ``neg`` against one rate for both labels, as a column."""
    rate = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)

    def part(x, n):
        some = F.when(x > 0, x * F.log(x / (n * rate))).otherwise(0.0)
        return some + F.when((n - x > 0) & (rate < 1), (n - x) * F.log((n - x) / (n * (1 - rate)))).otherwise(0.0)

    return part(F.col("pos"), F.lit(float(n_pos))) + part(F.col("neg"), F.lit(float(n_neg)))


def learn_terms(docs: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """The lexicon of ``docs`` (text, toxic): term (a star ends a beginning) and log odds. Documents are
    counted and their evidence is tested by Spark; what comes to the driver are the terms of the lexicon,
    of which a bounded sample of labelled documents yields no more than it has words in toxic ones."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def rows():
            terms = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], ["term", "pos", "neg"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {t for t in _TOKEN.findall(text.lower()) if t not in QUOTES}
                found |= {f"{t[:n]}*" for t in found for n in PREFIXES if len(t) > n}
                (pos if toxic else neg).update(found)
                if len(pos) + len(neg) > 2 * MEMO:
                    yield rows()
                    pos.clear(), neg.clear()
        yield rows()

    counts = docs.select("text", "toxic").mapInArrow(words, "term string, pos long, neg long")
    counts = counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = (F.col("pos") + 0.5) / (n_pos + 1) / ((F.col("neg") + 0.5) / (n_neg + 1))
    counts = counts.filter((F.col("pos") >= MIN_TOXIC) & (lift > 4) & (_evidence(n_pos, n_neg) >= MIN_EVIDENCE))
    return {r["term"]: round(r["weight"], 6) for r in counts.select("term", F.log(lift).alias("weight")).collect()}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], list[float]] | None:
    """Lexicon and regression weights from ``labelled`` (doc_id, text, toxic); None without both labels."""
    rows = labelled.filter("toxic is not null and text is not null").select("doc_id", "text", "toxic")
    n = rows.count()
    if n > max_labelled:
        rows = rows.filter(F.xxhash64("doc_id", F.lit("fit")).bitwiseAND(F.lit(0xFFFFFFFF)) < int(max_labelled / n * (1 << 32)))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    sizes = {(bool(r["first"]), int(r["toxic"] > 0)): r["count"] for r in rows.groupBy((part < 2).alias("first"), "toxic").count().collect()}
    if not all(any(sizes.get((f, y)) for f in (True, False)) for y in (0, 1)):
        return None
    halves = all(sizes.get((f, y), 0) >= 5 for f in (True, False) for y in (0, 1))
    first = rows.filter(part < 2) if halves else rows
    count = lambda y: sum(v for (f, label), v in sizes.items() if label == y and (f or not halves))
    terms = learn_terms(first.withColumn("toxic", F.col("toxic") > 0), count(1), count(0))
    second = rows.filter(part == 2) if halves else rows
    found = score_features(second, terms, ["toxic"]).toPandas()  # max_labelled rows at most
    x = np.array(found["features"].tolist(), float).reshape(len(found), Scorer.FEATURES)
    return terms, _fit(x, (found["toxic"].to_numpy() > 0).astype(float)).tolist()


def score_features(docs: DataFrame, terms: dict[str, float], keep: list[str]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([scorer.features(t) for t in batch.columns[-1].to_pylist()], pa.list_(pa.float64()))], [*keep, "features"])

    base = docs.select(*(F.col(k).cast("long").alias(k) for k in keep), "text")
    return base.mapInArrow(rows, ", ".join(f"{k} long" for k in keep) + ", features array<double>")


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]] | None) -> DataFrame:
    """doc_id, score for every row."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    terms, weights = model
    total = F.expr(" + ".join(f"features[{i}] * {w!r}D" for i, w in enumerate(weights[:-1])) + f" + {weights[-1]!r}D")
    return score_features(docs, terms, ["doc_id"]).select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op9: doc_id, held_out, score, predicted."""
    fold = id_fold("doc_id", 5)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text").filter(fold != 0).join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    found = score(docs, learn(train))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

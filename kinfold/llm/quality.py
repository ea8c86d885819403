"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one long of
failure bits; a policy is a mask of the rules that count, under a version. Keeping a document under
any policy, and the effect of leaving a rule out of a policy (ablation), are bit operations on the
ledger, which is never computed again.

A null or empty text has no words: all measurements are 0. Repeated rows each get their row, and an empty table
gives none. Texts are measured whole, whatever their length; no measurement depends on an order, so there are no ties.
Columns other than doc_id and text, whatever their names, are not looked at. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RE

#: Rules by bit, each true where a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 30 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 40 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Masks of the rules that each version applies.
POLICIES: dict[str, int] = {"base": BASE, "v1": BASE | BIT["many_symbols"], "v2": sum(BIT.values())}


def _repeat_words(words: str) -> Column:
    """Words inside a window of three that comes twice or more. Window hashes are compared first;
    only texts with a repeated one are sorted, so that equal windows stand side by side."""
    return F.expr(f"""
      CASE WHEN size(_hashes) = size(array_distinct(_hashes)) THEN 0L ELSE
        cast(size(array_distinct(flatten(transform(
          filter(transform(array(array_sort(transform(_hashes, (h, i) -> struct(h, i)))), s ->
            transform(s, (x, k) -> CASE WHEN (k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h) THEN x.i END))[0],
            i -> i IS NOT NULL),
          i -> array(i, i + 1, i + 2))))) AS long) END""")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.select(
        "doc_id",
        F.filter(F.split("_text", f"{SPACE_RE}+"), lambda w: w != "").alias("_words"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(F.length("_text") == 0, 0).otherwise(F.size(F.split("_text", "\n"))).cast("long").alias("n_lines"),
    )
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lines",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_words) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END").alias("_hashes"),
    )
    return rows.withColumn("n_repeat_words", _repeat_words("_hashes")).drop("_hashes")


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The measurements and ``fail_bits``, the sum of the bits of the rules that fail."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(rules.values()))
    return measure(docs).withColumn("fail_bits", F.expr(bits))


def apply_policy(ledger_rows: DataFrame, mask: int) -> DataFrame:
    """The ledger with ``kept``: no rule of the mask fails."""
    return ledger_rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablations(ledger_rows: DataFrame, policies: dict[str, int] = POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """policy, left_out, n_kept, n_gained: documents each policy keeps without one of its rules, and
    how many more than with it. The ledger is first added up by bit pattern, of which there are at
    most two to the number of rules."""
    spark = ledger_rows.sparkSession
    counts = ledger_rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p, name, mask, mask & ~(1 << i)) for p, mask in policies.items() for i, name in enumerate(rules) if mask >> i & 1]
    tried = spark.createDataFrame(rows, "policy string, left_out string, mask long, rest long")
    kept = lambda mask: F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col(mask)) == 0, F.col("n")).otherwise(0))
    both = F.broadcast(tried).join(counts, F.col("fail_bits").bitwiseAND(F.col("rest")) == 0, "left")
    return both.groupBy("policy", "left_out").agg(F.coalesce(kept("rest"), F.lit(0)).alias("n_kept"), F.coalesce(kept("rest") - kept("mask"), F.lit(0)).alias("n_gained"))


def query(docs: DataFrame) -> DataFrame:
    """op1: measurements, failure bits, base_failed, and kept under policy v2."""
    return apply_policy(ledger(docs), POLICIES["v2"] | BASE).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "fail_bits",
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    CASE WHEN t = '' THEN [] ELSE string_split(t, chr(10)) END AS lines, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM t
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) u)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), b AS (
  SELECT *, CAST((""" + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values())) + f""") AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES["v2"]}) = 0 AS kept, fail_bits FROM b
"""

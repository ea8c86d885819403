"""Code to label through a dictionary of any size, as rows instead of column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a dictionary that is sent to every executor; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000


def decode_long(df: DataFrame, key: str, dictionary: DataFrame, fields: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key, field, code, label for each field of each row. The dictionary is counted up to the bound first. Beyond it both sides
    are shuffled by field and code; the codes that occur are looked up once each, so that a code that very many rows
    share costs no more than another."""
    long = df.unpivot(key, fields, "field", "code")
    known = dictionary.select("field", "code", "label")
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return long.join(F.broadcast(known), ["field", "code"], "left").select(key, "field", "code", "label")
    occur = long.filter("code IS NOT NULL").select("field", "code").distinct().join(known, ["field", "code"])
    return long.join(occur, ["field", "code"], "left").select(key, "field", "code", "label")


def decode_by_join(df: DataFrame, key: str, dictionary: DataFrame, fields: list[str], suffix: str = "_label", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a label column for each field, regrouped from the rows: one entry for each field of a row. The key must
    be unique."""
    pairs = F.map_from_entries(F.collect_list(F.struct("field", "label")))
    labels = decode_long(df, key, dictionary, fields, broadcast_rows).groupBy(key).agg(pairs.alias("_labels"))
    return df.join(labels, key, "left").select(*df.columns, *(F.try_element_at("_labels", F.lit(f)).alias(f"{f}{suffix}") for f in fields))

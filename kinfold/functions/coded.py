"""Coded answers: missing values, labels, lists and phrases. All are built-in column expressions,
compiled from catalogs into one projection."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every float and double column: comparisons treat NaN as larger than all."""
    names = {f.name for f in df.schema if isinstance(f.dataType, (FloatType, DoubleType))}
    return df.select(*(F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if c in names else F.col(c) for c in df.columns))


def null_missing(df: DataFrame, missing: dict[str, list[int]]) -> DataFrame:
    """Reserved codes to null, field by field; fields that are not listed keep 97 to 99 as numbers."""
    return df.select(*(F.when(~F.col(c).isin(*missing[c]), F.col(c)).alias(c) if missing.get(c) else F.col(c) for c in df.columns))


def label_of(field: str | Column, labels: dict[int, str]) -> Column:
    """Label of a code; null for null and for codes that the dictionary lacks."""
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items()))
    return F.try_element_at(pairs, F.col(field) if isinstance(field, str) else field)


def decode(df: DataFrame, dictionary: dict[str, dict[int, str]], suffix: str = "_label") -> DataFrame:
    """Adds a label column for each field of the dictionary."""
    return df.select("*", *(label_of(f, labels).alias(f"{f}{suffix}") for f, labels in dictionary.items() if f in df.columns))


def unknown_counts(missing: dict[str, list[int]], dictionary: dict[str, dict[int, str]], columns: list[str]) -> list[Column]:
    """For each decoded field how many answers, reserved codes aside, the dictionary lacks: to be aggregated or
    observed while the rows are written."""
    known = {f: labels for f, labels in dictionary.items() if f in columns}
    answered = {f: F.col(f).isNotNull() & (~F.col(f).isin(*missing[f]) if missing.get(f) else F.lit(True)) for f in known}
    return [F.count_if(answered[f] & label_of(f, labels).isNull()).alias(f) for f, labels in known.items()]


def repeated_groups(slots: list[dict[str, str]], number: str, n: int | None = None) -> Column:
    """Repeated column groups (child 1's columns, child 2's, ...) as an array of structs: ``number``, the slot's from 1
    on, and the parts that a slot names its columns by. Slots all of whose columns are missing are left out, and
    the first ``n`` others kept, without a shuffle."""
    each = [F.struct(F.lit(i).alias(number), *(F.col(c).alias(part) for part, c in slot.items())) for i, slot in enumerate(slots, 1)]
    parts = list(dict.fromkeys(part for slot in slots for part in slot))
    answered = F.filter(F.array(*each), lambda x: F.coalesce(*(x[part].cast("string") for part in parts)).isNotNull())
    return answered if n is None else F.slice(answered, 1, n)


def flags_to_list(flags: dict[str, str], none_text: str, yes: int = 1, separator: str = "、") -> Column:
    """Names of the flags that are set; ``none_text`` if none is but some are answered; null if all are missing."""
    names = F.array_compact(F.array(*(F.when(F.col(f) == yes, F.lit(name)) for f, name in flags.items())))
    answered = F.coalesce(*(F.col(f) for f in flags)).isNotNull()
    return F.when(F.size(names) > 0, F.array_join(names, separator)).when(answered, F.lit(none_text))


def numeric_fact(field: str, template: str) -> Column:
    """A number set into a phrase at {}; null for null."""
    before, _, after = template.partition("{}")
    return F.when(F.col(field).isNotNull(), F.concat(F.lit(before), F.col(field).cast("string"), F.lit(after)))


def labelled(title: str, value: Column) -> Column:
    return F.concat(F.lit(f"{title}："), value)


def fact_text(groups: dict[str, list[Column]], separator: str = "；") -> list[Column]:
    """One text per group from its facts; missing facts are left out, a group without any is null."""
    return [F.nullif(F.concat_ws(separator, *facts), F.lit("")).alias(name) for name, facts in groups.items()]

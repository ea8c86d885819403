"""What the catalog tables say, compiled for column expressions. A catalog has a row per survey field, code
or fact, so that it is read on the driver; survey rows never are.

* fields: table, field, kind, missing_codes. Which fields are kept of which table, and the codes that each reserves.
* dictionary: field, code, label.
* groups: group, position, title. The texts of a fact row, in this order.
* facts: group, position, kind, field, title, template. What stands in a group, in this order, by kind:
  ``label``: the dictionary's label of ``field``; ``number``: ``template`` filled from fields; ``flags``: the
  names of the list ``field`` that are set, or ``template`` where none is; ``each``: ``template`` filled from
  every element of the array ``field``. All but numbers are led by the title, where there is one.
* flags: list, position, field, name.
* slots: array, position, part, field. Repeated columns, one slot after the other, that are read as an array.

A template sets values in at ``{field}`` and labels at ``{field:label}``. What stands in brackets is left out where
a value in it is missing; a value missing outside of brackets makes the whole missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .coded import fact_text, flags_to_list, label_of, labelled

#: Rows that a catalog may have. More is no catalog but data: an error.
MAX_ROWS = 100_000

Labels = dict[str, dict[int, str]]


def rows(df: DataFrame) -> list:
    """A catalog's rows, on the driver."""
    found = df.limit(MAX_ROWS + 1).collect()
    if len(found) > MAX_ROWS:
        raise ValueError(f"a catalog of more than {MAX_ROWS} rows")
    return found


def local_table(spark: SparkSession, found: list[tuple], kind: StructType) -> DataFrame:
    """A table whose rows are part of the plan: reading it takes no job."""
    columns = list(zip(*found, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(kind.fields, columns, strict=True)], kind.fieldNames()), kind)


def localised(df: DataFrame) -> DataFrame:
    """A catalog read once, however often it is asked."""
    return local_table(df.sparkSession, [tuple(r) for r in rows(df)], df.schema)


def missing_codes(catalog: DataFrame, default: list[int]) -> dict[tuple[str, str], list[int]]:
    """Reserved codes of each field of each table: its own list, none ("-"), or the default for categories without one.
    A field that is listed twice is an error."""
    out: dict[tuple[str, str], list[int]] = {}
    for r in rows(catalog):
        key, codes = (r["table"], r["field"]), (r["missing_codes"] or "").strip()
        if key in out:
            raise ValueError(f"{key[0]} lists {key[1]} twice")
        out[key] = [] if codes == "-" else [int(c) for c in codes.split()] or (default if r["kind"] == "category" else [])
    return out


def by_column(codes: dict[tuple[str, str], list[int]], keys: list[str] = ()) -> dict[str, list[int]]:
    """The same by the name that a field has in the wide table. Two tables that list one name, other than a
    key, would overwrite each other there: an error."""
    out: dict[str, list[int]] = {}
    for (table, field), own in codes.items():
        if field in out and field not in keys:
            raise ValueError(f"{field} of {table} is a column of another table too")
        out[field] = own
    return out


def dictionary_labels(dictionary: DataFrame) -> Labels:
    """field -> code -> label. A code with two labels is an error."""
    out: Labels = {}
    for r in rows(dictionary):
        if out.setdefault(r["field"], {}).setdefault(r["code"], r["label"]) != r["label"]:
            raise ValueError(f"{r['field']} {r['code']} has two labels")
    return out


def flag_lists(flags: DataFrame) -> dict[str, dict[str, str]]:
    """list -> field -> name, in the order of their positions."""
    out: dict[str, dict[str, str]] = {}
    for r in sorted(rows(flags), key=lambda r: (r["list"], r["position"])):
        out.setdefault(r["list"], {})[r["field"]] = r["name"]
    return out


def repeated_columns(slots: DataFrame) -> dict[str, list[dict[str, str]]]:
    """array -> its slots in order, each part -> column."""
    out: dict[str, dict[int, dict[str, str]]] = {}
    for r in rows(slots):
        out.setdefault(r["array"], {}).setdefault(r["position"], {})[r["part"]] = r["field"]
    return {name: [found[i] for i in sorted(found)] for name, found in out.items()}


def template(text: str, value: Callable[[str], Column], labels: Labels) -> Column:
    """A template as a column; ``value`` gives the column of a name."""

    def filled(part: str) -> Column:
        pieces = []
        for i, x in enumerate(re.split(r"\{([^{}]*)\}", part)):
            if i % 2 == 0:
                pieces.append(F.lit(x))
                continue
            name, _, how = x.partition(":")
            if how not in ("", "label") or how and name not in labels:
                raise ValueError(f"no {how} of {name} for {text}")
            pieces.append(label_of(value(name), labels[name]) if how else value(name).cast("string"))
        return F.concat(*pieces)

    return F.concat(*(F.coalesce(filled(x), F.lit("")) if i % 2 else filled(x) for i, x in enumerate(re.split(r"\[([^\[\]]*)\]", text))))


def _fact(row, labels: Labels, lists: dict[str, dict[str, str]], known: list[str]) -> Column:
    def column(name: str) -> Column:
        if name not in known:
            raise ValueError(f"no column {name} for group {row['group']}")
        return F.col(name)

    field, text = row["field"], row["template"] or ""
    if row["kind"] == "number":
        return template(text, column, labels)
    if row["kind"] == "label":
        value = label_of(column(field), labels[field]) if field in labels else column(field).cast("string")
    elif row["kind"] == "flags":
        if field not in lists:
            raise ValueError(f"no list {field} for group {row['group']}")
        for name in lists[field]:
            column(name)
        value = flags_to_list(lists[field], text)
    elif row["kind"] == "each":
        each = F.transform(column(field), lambda x: template(text, lambda name: x[name], labels))
        value = F.nullif(F.array_join(each, "；"), F.lit(""))
    else:
        raise ValueError(f"unknown kind {row['kind']} in group {row['group']}")
    return labelled(row["title"], value) if row["title"] else value


def group_columns(groups: DataFrame, facts: DataFrame, flags: DataFrame, labels: Labels, known: list[str]) -> list[Column]:
    """One text column per group, in the order of the groups, of its facts in the order of their positions.
    A group without facts is null. A column, list or group that is not there is an error."""
    lists = flag_lists(flags)
    out: dict[str, list[Column]] = {r["group"]: [] for r in sorted(rows(groups), key=lambda r: r["position"])}
    for r in sorted(rows(facts), key=lambda r: r["position"]):
        if r["group"] not in out:
            raise ValueError(f"no group {r['group']}")
        out[r["group"]].append(_fact(r, labels, lists, known))
    return fact_text({g: columns or [F.lit(None).cast("string")] for g, columns in out.items()})

"""Names and types that the jobs agree on."""

from __future__ import annotations

from pyspark.sql import types as T

PERSON_KEY, HOUSEHOLD_KEY = "id", "household_id"
WEIGHT = "indv_weight_ad2"

# The nine groups of fact text, in their order.
GROUPS = ["basic", "education", "marriage", "emotion", "health", "activity", "internet", "children", "work"]

# Codes that stand for a missing answer in categorical fields, where the catalog has no own list.
MISSING_CODES = [97, 98, 99, 997, 998, 999]

# The groups that each generation step reads, in the order of its payload, and the texts before it.
STEPS = {
    "personality": (["basic", "education", "marriage", "emotion", "activity", "internet", "work"], []),
    "experience": (["basic", "education", "marriage", "health", "work", "emotion", "activity", "children", "internet"], ["personality"]),
    "worries": (["basic", "education", "marriage", "health", "work", "emotion", "activity", "children", "internet"], ["personality", "experience"]),
    "anchors": ([], ["personality", "experience", "worries"]),
}


def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


CATALOG = _schema("table string, field string, kind string, missing_codes string")
DICTIONARY = _schema("field string, code int, label string")
GROUP_CATALOG = _schema("group string, position int, title string")
FACT_CATALOG = _schema("group string, position int, kind string, field string, title string, template string")
FLAG_CATALOG = _schema("list string, position int, field string, name string")
SLOT_CATALOG = _schema("array string, position int, part string, field string")
FACTS = T.StructType([T.StructField("sample_pick_order", T.IntegerType()), T.StructField(PERSON_KEY, T.StringType()), *(T.StructField(g, T.StringType()) for g in GROUPS)])
SCORES = _schema("profile string, run_id string, dimension string, score double")

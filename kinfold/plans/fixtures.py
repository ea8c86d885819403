"""Survey-shaped views over the given tables, in SQL that Spark and DuckDB read alike (but for the
access to JSON), and the catalogs that go with them, as rows of the tables that the jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..functions.catalogs import local_table

N_CHRONIC = 15
#: Slots of repeated child columns in the family table.
N_SLOTS = 4

#: table, field, kind, missing codes; "-" means that the field reserves none.
CATALOG = [
    ("s_sample", "crosssection", "flag", "-"),
    ("s_sample", "died", "flag", "-"),
    ("s_demo", "xrage", "number", "-"),
    ("s_demo", "sex", "category", "97 98 99"),
    ("s_demo", "residence", "category", ""),
    ("s_demo", "edu", "category", ""),
    ("s_demo", "marriage", "category", ""),
    ("s_health", "satisfaction", "category", ""),
    *(("s_health", f"c{i}", "flag", "-") for i in range(1, N_CHRONIC + 1)),
    *(("s_health", f"act{i}", "flag", "-") for i in range(1, 4)),
    *(("s_health", f"net{i}", "flag", "-") for i in range(1, 3)),
    ("s_work", "days", "number", "-"),
    ("s_work", "retired", "category", "997 998 999"),
    *(("s_family", f"ch{i}_contact", "code", "-") for i in range(1, N_SLOTS + 1)),
]

#: field, code, label.
LABELS = {
    "sex": {1: "男", 2: "女"},
    "residence": {1: "城镇", 2: "乡村"},
    "edu": {1: "未受过教育", 2: "小学未毕业", 3: "私塾", 4: "小学", 5: "初中", 6: "高中", 9: "本科", 10: "研究生"},
    "marriage": {1: "已婚同住", 2: "已婚分居", 3: "分居", 4: "离异", 5: "丧偶", 6: "未婚"},
    "satisfaction": {1: "极其满意", 2: "非常满意", 3: "比较满意", 4: "不太满意", 5: "一点也不满意"},
    "retired": {1: "已退休", 2: "未退休"},
    "contact": {1: "几乎每天", 2: "每周数次", 3: "每周一次", 4: "每半月一次", 5: "每月一次", 6: "每三月一次", 7: "每半年一次", 8: "每年一次", 9: "几乎没有"},
}
DICTIONARY = [(f, code, label) for f, labels in LABELS.items() for code, label in labels.items()]

#: group, position, title.
GROUPS = [("basic", 1, "基础信息"), ("education", 2, "教育信息"), ("marriage", 3, "婚姻信息"), ("emotion", 4, "情绪信息"), ("health", 5, "健康信息"), ("activity", 6, "活动信息"), ("internet", 7, "上网信息"), ("children", 8, "子女信息"), ("work", 9, "工作信息")]

CHILD = "子女{child_no}[，联系{contact:label}]"
#: group, position, kind, field, title, template.
FACTS = [
    ("basic", 1, "label", "sex", "性别", None),
    ("basic", 2, "number", None, None, "年龄：{xrage}岁"),
    ("basic", 3, "label", "residence", "居住地", None),
    ("education", 1, "label", "edu", "学历", None),
    ("marriage", 1, "label", "marriage", "婚姻", None),
    ("emotion", 1, "label", "satisfaction", "生活满意度", None),
    ("health", 1, "flags", "chronic", "慢性病", "无"),
    ("activity", 1, "flags", "activity", "社会活动", "无"),
    ("internet", 1, "flags", "internet", "上网", "无"),
    ("children", 1, "each", "children", None, CHILD),
    ("work", 1, "label", "retired", "退休", None),
    ("work", 2, "number", None, None, "工作{days}天"),
]

#: list, position, field, name.
FLAGS = [
    *(("chronic", i, f"c{i}", f"慢性病{i}") for i in range(1, N_CHRONIC + 1)),
    *(("activity", i, f"act{i}", name) for i, name in enumerate(("串门", "打牌下棋", "锻炼"), 1)),
    *(("internet", i, f"net{i}", name) for i, name in enumerate(("聊天", "看新闻"), 1)),
]

#: array, position, part, field.
SLOTS = [("children", i, "contact", f"ch{i}_contact") for i in range(1, N_SLOTS + 1)]

#: Profiles of result folders, by type of event: names with blanks, colons, percent and plus signs, brackets and Chinese letters.
PROFILES = {"view": "GLM 4.7", "signup": "glm:4.7", "click": "通义 千问+", "error": "100%{a}", "purchase": "x=y%20z"}


def catalogs(spark: SparkSession) -> dict[str, DataFrame]:
    """The catalog tables by the names of their files."""
    rows = {"fields": (CATALOG, schema.CATALOG), "labels": (DICTIONARY, schema.DICTIONARY), "groups": (GROUPS, schema.GROUP_CATALOG), "facts": (FACTS, schema.FACT_CATALOG), "flags": (FLAGS, schema.FLAG_CATALOG), "slots": (SLOTS, schema.SLOT_CATALOG)}
    return {name: local_table(spark, r, s) for name, (r, s) in rows.items()}


_JSON_K = {"spark": "get_json_object(props, '$.k')", "duckdb": "props->>'k'"}
_LAST = {"spark": "max_by", "duckdb": "arg_max"}


def view_sql(engine: str) -> dict[str, str]:
    """The views by name, each over the tables and the views before it."""
    return {
        "s_sample": """SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS household_id,
          CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS crosssection, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS died FROM orders""",
        "s_weights": "SELECT CAST(l_orderkey AS STRING) AS id, CAST(CAST(sum(l_quantity) AS BIGINT) - 60 AS DOUBLE) AS indv_weight_ad2 FROM lineitem GROUP BY l_orderkey",
        "s_demo": """SELECT CAST(o_orderkey AS STRING) AS id, CAST(30 + o_orderkey % 61 AS INT) AS xrage, CAST(1 + o_orderkey % 2 AS INT) AS sex, CAST(1 + o_orderkey % 3 AS INT) AS residence,
          CAST(CASE o_orderkey % 10 WHEN 7 THEN 97 WHEN 8 THEN 98 WHEN 9 THEN 99 ELSE 1 + o_orderkey % 10 END AS INT) AS edu, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 997 ELSE 1 + o_orderkey % 6 END AS INT) AS marriage FROM orders""",
        "s_health": f"""SELECT CAST(l_orderkey AS STRING) AS id, CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 3 THEN 1 WHEN min(l_linenumber) = 1 THEN 2 END AS proxy_2,
          CASE WHEN sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) >= 5 THEN 1 ELSE 2 END AS proxy_5, CAST(min(l_linenumber) AS INT) AS satisfaction,
          {", ".join(f"min(CASE WHEN l_suppkey % {N_CHRONIC} = {i} THEN 1 ELSE 2 END) AS c{i + 1}" for i in range(N_CHRONIC))},
          {", ".join(f"min(CASE WHEN l_partkey % 7 = {i} THEN 1 ELSE 2 END) AS act{i + 1}" for i in range(3))},
          {", ".join(f"min(CASE WHEN l_partkey % 5 = {i} THEN 1 ELSE 2 END) AS net{i + 1}" for i in range(2))} FROM lineitem GROUP BY l_orderkey""",
        "s_work": f"SELECT CAST(user_id AS STRING) AS id, {_LAST[engine]}(CAST({_JSON_K[engine]} AS INT), event_id) AS days, CAST(1 + max(event_id) % 3 AS INT) AS retired FROM events GROUP BY user_id",
        "s_child": """SELECT CAST(o_custkey AS STRING) AS household_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS child_no,
          CAST(o_orderkey % 10 AS INT) AS contact FROM orders""",
        "s_slots": "SELECT CAST(o_custkey AS STRING) AS household_id, " + ", ".join(f"max(CASE WHEN child_no = {i} AND o_orderkey % 7 <> 0 THEN contact END) AS ch{i}_contact" for i in range(1, N_SLOTS + 1)) + """ FROM (
          SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS child_no, CAST(o_orderkey % 10 AS INT) AS contact FROM orders) GROUP BY o_custkey""",
        "s_family": "SELECT CAST(c_custkey AS STRING) AS household_id, c_mktsegment AS house_segment, CAST(c_nationkey AS INT) AS house_code FROM customer",
        "turns": "SELECT 'tested' AS profile, CAST(conv_id AS STRING) AS run_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE role <> 'system'",
        "user_scores": "SELECT source AS profile, CAST(documents.doc_id AS STRING) AS run_id, CAST(n_chars AS DOUBLE) AS length FROM documents",
        "eval_scores": """SELECT source AS profile, CAST(documents.doc_id AS STRING) AS run_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic
          FROM documents JOIN labels ON documents.doc_id = labels.doc_id WHERE source <> 'src3'""",
        "event_results": "SELECT event_type AS profile, CAST(event_id AS STRING) AS run_id, value, props FROM events",
        "named_results": f"SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PROFILES.items())} ELSE 'manual' END AS profile, CAST(event_id AS STRING) AS run_id, value FROM events",
        "json_results": """SELECT event_type AS profile, CAST(event_id AS STRING) AS run_id, CASE WHEN event_id % 11 = 0 THEN concat('{"user": {"scores": ', substr(props, 1, 4))
          WHEN event_id % 13 = 0 THEN 'no json' WHEN event_id % 17 = 0 THEN '{"user": {"scores": {"k": "high", "m": 3}}}' WHEN event_id % 19 = 0 THEN '{"user": {"scores": {}}, "evaluator": null}'
          WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '{"note": 1}' WHEN event_id % 5 = 0 THEN concat('{"user": {"scores": ', props, '}}')
          ELSE concat('{"user": {"scores": ', props, ', "note": "n"}, "evaluator": {"scores": {"e', CAST(event_id % 3 AS STRING), '": ', CAST(event_id % 10 AS STRING), '.5}}}') END AS result FROM events""",
        "run_list": "SELECT 'tested' AS profile, CAST(conv_id + CASE WHEN conv_id % 7 = 0 THEN 1000000 ELSE 0 END AS STRING) AS run_id, CAST(1 + conv_id % 4 AS INT) AS rounds FROM (SELECT DISTINCT conv_id FROM conversations)",
    }


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; the tables' names are local to it."""
    body = view_sql("spark")[name].replace("{", "{{").replace("}", "}}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "events", "customer", "conversations", "documents", "labels") if t in body}
    for t in frames:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ON", f"JOIN {{{t}}} AS {t} ON").replace(f"FROM {{{t}}} JOIN", f"FROM {{{t}}} AS {t} JOIN")
    body = body.replace("CAST(documents.doc_id", "CAST(doc_id") if "JOIN" not in body else body
    return spark.sql(body, **frames)

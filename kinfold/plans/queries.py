"""The registered queries over the given tables, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import catalogs
from ..functions.coded import flags_to_list, null_missing, numeric_fact, repeated_groups
from ..operators import dialogs, merge, sampling, scores, steps
from ..operators.decoding import decode_by_join
from ..schema import GROUPS, MISSING_CODES, STEPS
from . import files, fixtures, workloads as w
from .fixtures import view

Query = Callable[[SparkSession, str], DataFrame]
DIMENSIONS = ["value", "k", "length", "quality", "toxic"]
EVENT_PATHS = {"k": "$.k"}


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = catalogs.by_column(catalogs.missing_codes(fixtures.catalogs(spark)["fields"], MISSING_CODES))
    return null_missing(view(spark, sf_dir, "s_demo").join(view(spark, sf_dir, "s_work"), "id", "left"), codes)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = catalogs.flag_lists(fixtures.catalogs(spark)["flags"])
    return view(spark, sf_dir, "s_health").select("id", *(flags_to_list(lists[name], "无").alias(name) for name in ("chronic", "activity")))


def _slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = catalogs.repeated_columns(fixtures.catalogs(spark)["slots"])["children"]
    return w.child_text(spark, view(spark, sf_dir, "s_slots").select("household_id", repeated_groups(slots, "child_no", 2).alias("children")))


def queries() -> dict[str, Query]:
    return {
        "profile_columns": lambda s, d: merge.select_profile_columns(view(s, d, "s_demo"), fixtures.catalogs(s)["fields"], "s_demo", ["id"]),
        "skeleton": lambda s, d: merge.skeleton(view(s, d, "s_sample")),
        "person_wide": w.person_wide,
        "analysis_sample": w.analysis,
        "age_filtered": w.aged,
        "draw_probability": lambda s, d: sampling.with_probability(w.aged(s, d)).select("id", F.round("p", 12).alias("p")),
        "weighted_sample": w.sample,
        "missing_codes_nulled": _coded,
        "decoded_categories": w.decoded,
        "decoded_by_join": lambda s, d: decode_by_join(w.coded_demo(s, d), "id", fixtures.catalogs(s)["labels"], list(w.DECODED), broadcast_rows=0),
        "chronic_list": _lists,
        "first_two_children": lambda s, d: w.child_text(s, merge.first_children(view(s, d, "s_child"))).withColumnRenamed("children", "children_text"),
        "repeated_children": _slotted,
        "work_facts": lambda s, d: view(s, d, "s_work").select("id", numeric_fact("days", "工作{}天").alias("work_text")),
        "fact_text": w.facts,
        "unique_ids": lambda s, d: steps.unique_ids(w.sample(s, d)).select("id", "sample_pick_order", "pick_count"),
        "step_inputs": lambda s, d: steps.step_inputs(w.facts(s, d), "personality").select("sample_pick_order", "id", "payload"),
        "persona_chain": lambda s, d: w.personas(s, d)[0],
        "persona_errors": lambda s, d: w.personas(s, d)[1],
        "step_ledger": w.step_ledger,
        "missing_personas": w.missing_personas,
        "sliced_users": lambda s, d: steps.slice_dense(w.sample(s, d), 100, 50).select("sample_pick_order", "id"),
        "sliced_persons": lambda s, d: steps.slice_users(view(s, d, "s_demo").select(F.col("id").cast("long").alias("id"), "xrage"), 1_000, 2_000, "id"),
        "dialog_rounds": w.dialog_rounds,
        "transcripts": lambda s, d: dialogs.transcripts(view(s, d, "turns")),
        "run_status": lambda s, d: dialogs.run_status(dialogs.rounds(view(s, d, "turns")), w.ROUNDS),
        "requested_runs": lambda s, d: dialogs.requested_status(dialogs.rounds(view(s, d, "turns")), view(s, d, "run_list")),
        "event_scores": lambda s, d: scores.extract_scores(view(s, d, "event_results"), EVENT_PATHS, "props"),
        "result_entries": files.result_entries,
        "result_states": files.result_states,
        "combined_scores": w.combined,
        "mean_scores": lambda s, d: scores.mean_scores(w.score_table(s, d)),
        "score_summary": lambda s, d: scores.score_summary(w.score_table(s, d), DIMENSIONS),
        "selected_wide": files.selected_wide,
        "catalog_facts": files.catalog_facts,
        "unknown_codes": files.unknown,
        "rejected_lines": files.rejected,
        "survey_job": files.survey_job,
        "sample_file": files.sample_file,
        "facts_file": files.facts_file,
        "persona_file": files.persona_file,
        "scores_file": files.scores_file,
        "scores_file_without_manual": lambda s, d: scores.mean_scores(files.scores_file(s, d, include_manual=False)),
        "named_profiles": files.named_profiles,
    }


def _label(field: str, left_out: tuple = ()) -> str:
    return f"CASE {field} " + " ".join(f"WHEN {k} THEN '{v}'" for f, k, v in fixtures.DICTIONARY if f == field and (f, k) != left_out) + " END"


_CODES = {f: [] if codes == "-" else [int(c) for c in codes.split()] or (MISSING_CODES if kind == "category" else []) for _, f, kind, codes in fixtures.CATALOG}
_LISTS = {name: {f: text for x, _, f, text in fixtures.FLAGS if x == name} for name in ("chronic", "activity", "internet")}


def _nulled(field: str) -> str:
    codes = _CODES.get(field)
    return f"CASE WHEN {field} NOT IN ({', '.join(map(str, codes))}) THEN {field} END AS {field}" if codes else field


def _flags(name: str) -> str:
    flags = _LISTS[name]
    names = "concat_ws('、', " + ", ".join(f"CASE WHEN {f} = 1 THEN '{n}' END" for f, n in flags.items()) + ")"
    return f"CASE WHEN {names} <> '' THEN {names} WHEN coalesce({', '.join(flags)}) IS NOT NULL THEN '无' END"


def _texts(source: str, left_out: tuple = ()) -> str:
    """The nine texts over the nulled codes of ``source``, which has children_text."""
    label = lambda f: _label(f, left_out)
    return f"""nullif(concat_ws('；', '性别：' || {label("sex")}, '年龄：' || xrage || '岁', '居住地：' || {label("residence")}), '') AS basic,
      '学历：' || {label("edu")} AS education, '婚姻：' || {label("marriage")} AS marriage, '生活满意度：' || {label("satisfaction")} AS emotion,
      '慢性病：' || {_flags("chronic")} AS health, '社会活动：' || {_flags("activity")} AS activity, '上网：' || {_flags("internet")} AS internet,
      children_text AS children, nullif(concat_ws('；', '退休：' || {label("retired")}, '工作' || days || '天'), '') AS work FROM {source}"""


_DEMO = ["xrage", "sex", "residence", "edu", "marriage"]
_HEALTH = ["proxy_2", "proxy_5", "satisfaction", *(f for flags in _LISTS.values() for f in flags)]
_WIDE = ["indv_weight_ad2", *_DEMO, *_HEALTH, "days", "retired", "house_segment", "house_code"]
_CONTACT = "CASE contact " + " ".join(f"WHEN {k} THEN '，联系{v}'" for f, k, v in fixtures.DICTIONARY if f == "contact") + " ELSE '' END"
_PAYLOAD = lambda step: "concat_ws(chr(10), " + ", ".join(f"'[{c}] ' || {c}" for c in (*STEPS[step][0], *STEPS[step][1])) + ")"
_GENERATED = lambda step: f"md5('{step}|' || {_PAYLOAD(step)})"


def _ctes() -> dict[str, str]:
    ctes = dict(fixtures.view_sql("duckdb"))
    ctes["skel"] = "SELECT * FROM s_sample WHERE crosssection = 1 AND died = 0"
    ctes["wide"] = f"""SELECT skel.*, {", ".join(_WIDE)} FROM skel LEFT JOIN s_weights USING (id) LEFT JOIN s_demo USING (id) LEFT JOIN s_health USING (id)
      LEFT JOIN s_work USING (id) LEFT JOIN s_family USING (household_id)"""
    ctes["analysis"] = "SELECT * FROM wide WHERE crosssection = 1 AND died = 0 AND indv_weight_ad2 > 0 AND proxy_2 IS DISTINCT FROM 1 AND proxy_5 IS DISTINCT FROM 1"
    ctes["aged"] = "SELECT * FROM analysis WHERE xrage >= 45"
    ctes["keyed"] = f"""SELECT id, CAST(round(indv_weight_ad2 * {sampling.SCALE}) AS BIGINT) AS wi, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) AS b FROM aged"""
    ctes["cum"] = "SELECT id, wi, sum(wi) OVER (ORDER BY b, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM keyed"
    ctes["draws"] = f"""SELECT k, (CAST(CAST('0x' || substr(md5('{sampling.SEED}:' || k), 1, 13) AS BIGINT) AS HUGEINT) * (SELECT sum(wi) FROM keyed)) // {1 << 52} AS t
      FROM (SELECT unnest(range(1, {sampling.DRAWS + 1})) AS k)"""
    ctes["picks"] = "SELECT CAST(k AS INT) AS sample_pick_order, id FROM draws JOIN cum ON t >= hi - wi AND t < hi"
    ctes["sample"] = "SELECT sample_pick_order, aged.* FROM picks JOIN aged USING (id)"
    ctes["kids"] = f"""SELECT household_id, string_agg('子女' || child_no || {_CONTACT}, '；' ORDER BY child_no) AS children_text FROM s_child WHERE child_no <= 2 GROUP BY household_id"""
    nulled = ", ".join(_nulled(f) for f in ("sample_pick_order", "id", "household_id", *_DEMO, *_HEALTH, "days", "retired"))
    ctes["coded"] = f"SELECT {nulled} FROM sample"
    ctes["facts"] = f"SELECT sample_pick_order, id, {_texts('coded LEFT JOIN kids USING (household_id)')}"
    ctes["firsts"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sample_pick_order) AS r FROM facts) WHERE r = 1"
    before, failed = "firsts", []
    for step in STEPS:
        ctes[f"made_{step}"] = f"SELECT *, {_GENERATED(step)} AS {step} FROM {before}"
        ctes[f"ok_{step}"] = f"SELECT * FROM made_{step} WHERE {step} NOT LIKE '0%'"
        failed.append(f"SELECT id, '{step}' AS step, 'refused' AS error FROM made_{step} WHERE {step} LIKE '0%'")
        before = f"ok_{step}"
    ctes["failed"] = " UNION ALL ".join(failed)
    before, tried = "firsts", []
    for step in STEPS:
        ctes[f"tried_{step}"] = f"SELECT *, {_GENERATED(step)} AS {step} FROM {before}"
        ctes[f"answered_{step}"] = f"SELECT * FROM tried_{step} WHERE substr({step}, 1, 1) NOT IN ('0', 'f')"
        error = f"CASE substr({step}, 1, 1) WHEN '0' THEN 'refused' WHEN 'f' THEN 'ConnectionError: hung up' END"
        tried.append(f"SELECT '{step}' AS step, id, {error} IS NULL AS answered, CASE WHEN {error} IS NULL THEN 1 ELSE 2 END AS attempts, {error} AS error FROM tried_{step}")
        before = f"answered_{step}"
    ctes["tried"] = " UNION ALL ".join(tried)
    ctes["numbered"] = """SELECT profile, run_id, role, turn, text, lead(role) OVER r AS next_role, lead(text) OVER r AS next_text FROM turns WHERE role IN ('user', 'assistant')
      WINDOW r AS (PARTITION BY profile, run_id ORDER BY turn)"""
    ctes["paired"] = """SELECT profile, run_id, CAST(row_number() OVER (PARTITION BY profile, run_id ORDER BY turn) AS INT) AS round_no, text AS user_text,
      CASE WHEN next_role = 'assistant' THEN next_text END AS reply_text FROM numbered WHERE role = 'user'"""
    slots = [f for _, _, _, f in fixtures.SLOTS]
    chosen = [c for c in (*_DEMO, *_HEALTH, "days", "retired")]
    ctes["selected"] = f"""SELECT id, household_id, crosssection, died, nullif(indv_weight_ad2, 0) AS indv_weight_ad2, {", ".join(chosen)}, {", ".join(slots)}
      FROM wide LEFT JOIN s_slots USING (household_id)"""
    ctes["slotted"] = "SELECT household_id, row_number() OVER (PARTITION BY household_id ORDER BY child_no) AS r, child_no, contact FROM (" + " UNION ALL ".join(f"SELECT household_id, {i} AS child_no, {f} AS contact FROM s_slots" for i, f in enumerate(slots, 1)) + ") WHERE contact IS NOT NULL"
    ctes["slot_kids"] = f"""SELECT s_slots.household_id, string_agg('子女' || child_no || {_CONTACT}, '；' ORDER BY child_no) FILTER (r <= 2) AS children_text
      FROM s_slots LEFT JOIN slotted USING (household_id) GROUP BY s_slots.household_id"""
    kept = "indv_weight_ad2 > 0 AND proxy_2 IS DISTINCT FROM 1 AND proxy_5 IS DISTINCT FROM 1"
    coded = ", ".join(_nulled(f) for f in ("id", "household_id", *chosen))
    ctes["selected_coded"] = f"SELECT {coded} FROM selected WHERE {kept}"
    ctes["sample_coded"] = f"SELECT sample_pick_order, {coded} FROM picks JOIN selected USING (id)"
    ctes["read_entries"] = """SELECT profile, run_id, result, side, json_extract(CASE WHEN json_valid(result) THEN result END, '$.' || side || '.scores') AS scores FROM json_results, (VALUES ('user'), ('evaluator')) AS v(side)"""
    ctes["sided"] = "SELECT *, json_keys(scores) AS names FROM read_entries WHERE len(json_keys(scores)) > 0"
    ctes["entries"] = """SELECT profile, run_id, side, name AS dimension, TRY_CAST(scores->>('$."' || name || '"') AS DOUBLE) AS score,
      CASE WHEN TRY_CAST(scores->>('$."' || name || '"') AS DOUBLE) IS NULL THEN 'not a number' END AS reason,
      CASE WHEN TRY_CAST(scores->>('$."' || name || '"') AS DOUBLE) IS NULL THEN scores->>('$."' || name || '"') END AS raw FROM sided, unnest(names) AS u(name)
      UNION ALL SELECT profile, run_id, NULL, NULL, NULL, CASE WHEN result IS NULL THEN 'no result' WHEN NOT json_valid(result) THEN 'not JSON' ELSE 'no scores' END, result
      FROM json_results WHERE (profile, run_id) NOT IN (SELECT (profile, run_id) FROM sided)"""
    ctes["filed"] = """SELECT CASE WHEN CAST(run_id AS BIGINT) % 7 = 0 THEN 'manual' ELSE profile END AS profile, run_id,
      CASE WHEN CAST(run_id AS BIGINT) % 7 <> 0 THEN value END AS value, TRY_CAST(props->>'k' AS DOUBLE) AS k FROM event_results"""
    ctes["filed_scores"] = "SELECT profile, run_id, 'value' AS dimension, value AS score FROM filed UNION ALL SELECT profile, run_id, 'k', k FROM filed"
    ctes["joined"] = "SELECT user_scores.*, quality, toxic FROM user_scores LEFT JOIN eval_scores USING (profile, run_id)"
    ctes["scores"] = "SELECT profile, run_id, 'value' AS dimension, value AS score FROM event_results UNION ALL SELECT profile, run_id, 'k', TRY_CAST(props->>'k' AS DOUBLE) FROM event_results" + "".join(
        f" UNION ALL SELECT profile, run_id, '{x}', {x} FROM joined" for x in ("length", "quality", "toxic")
    )
    return ctes


def _unknown() -> str:
    known = {f: ", ".join(str(code) for g, code, _ in files.dictionary_rows() if g == f) for f in files.DECODED}
    return "SELECT " + ", ".join(f"count(CASE WHEN {f} NOT IN ({codes}) THEN 1 END) AS {f}" for f, codes in known.items()) + f" FROM (SELECT {', '.join(map(_nulled, files.DECODED))} FROM selected)"


def oracle_sql() -> dict[str, str]:
    steps_ = ", ".join(STEPS)
    final = {
        "profile_columns": "SELECT id, xrage, sex, residence, edu, marriage FROM s_demo",
        "skeleton": "SELECT * FROM skel",
        "person_wide": "SELECT * FROM wide",
        "analysis_sample": "SELECT * FROM analysis",
        "age_filtered": "SELECT * FROM aged",
        "draw_probability": "SELECT id, round(CAST(wi AS DOUBLE) / CAST((SELECT sum(wi) FROM keyed) AS DOUBLE), 12) AS p FROM keyed",
        "weighted_sample": "SELECT * FROM sample",
        "missing_codes_nulled": f"SELECT id, {', '.join(_nulled(f) for f in (*_DEMO, 'days', 'retired'))} FROM s_demo LEFT JOIN s_work USING (id)",
        "decoded_categories": "SELECT id, " + ", ".join(_DEMO) + ", " + ", ".join(f"{_label(f)} AS {f}_label" for f in ("sex", "residence", "edu", "marriage")) + f" FROM (SELECT id, {', '.join(map(_nulled, _DEMO))} FROM s_demo)",
        "decoded_by_join": "SELECT id, " + ", ".join(_DEMO) + ", " + ", ".join(f"{_label(f)} AS {f}_label" for f in w.DECODED) + f" FROM (SELECT id, {', '.join(map(_nulled, _DEMO))} FROM s_demo)",
        "chronic_list": f"SELECT id, {_flags('chronic')} AS chronic, {_flags('activity')} AS activity FROM s_health",
        "repeated_children": "SELECT household_id, children_text AS children FROM slot_kids",
        "first_two_children": "SELECT * FROM kids",
        "work_facts": "SELECT id, '工作' || days || '天' AS work_text FROM s_work",
        "fact_text": f"SELECT sample_pick_order, id, {', '.join(GROUPS)} FROM facts",
        "unique_ids": "SELECT id, min(sample_pick_order) AS sample_pick_order, count(*) AS pick_count FROM sample GROUP BY id",
        "step_inputs": f"SELECT sample_pick_order, id, {_PAYLOAD('personality')} AS payload FROM facts",
        "persona_chain": f"SELECT id, {steps_} FROM ok_{list(STEPS)[-1]}",
        "persona_errors": "SELECT * FROM failed",
        "step_ledger": "SELECT * FROM tried",
        "missing_personas": f"SELECT DISTINCT id FROM facts WHERE id NOT IN (SELECT id FROM ok_{list(STEPS)[-1]})",
        "sliced_users": "SELECT sample_pick_order, id FROM sample ORDER BY sample_pick_order LIMIT 50 OFFSET 100",
        "sliced_persons": "SELECT CAST(id AS BIGINT) AS id, xrage FROM s_demo ORDER BY CAST(id AS BIGINT) LIMIT 2000 OFFSET 1000",
        "dialog_rounds": f"SELECT * FROM paired WHERE round_no <= {w.ROUNDS}",
        "transcripts": "SELECT profile, run_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM turns GROUP BY profile, run_id",
        "run_status": f"SELECT profile, run_id, count(*) AS n_rounds, count(reply_text) AS n_answered, count(reply_text) >= {w.ROUNDS} AS complete FROM paired GROUP BY profile, run_id",
        "requested_runs": """SELECT profile, run_id, rounds, coalesce(n_rounds, 0) AS n_rounds, coalesce(n_answered, 0) AS n_answered,
          CASE WHEN rounds IS NULL THEN 'not requested' WHEN coalesce(n_rounds, 0) = 0 THEN 'not run' WHEN n_answered = 0 THEN 'unanswered' WHEN n_answered >= rounds THEN 'complete' ELSE 'incomplete' END AS state
          FROM run_list FULL JOIN (SELECT profile, run_id, count(*) AS n_rounds, count(reply_text) AS n_answered FROM paired GROUP BY profile, run_id) USING (profile, run_id)""",
        "result_entries": "SELECT * FROM entries",
        "result_states": "SELECT reason, count(*) AS n FROM entries GROUP BY reason",
        "event_scores": "SELECT profile, run_id, 'k' AS dimension, TRY_CAST(props->>'k' AS DOUBLE) AS score FROM event_results",
        "combined_scores": "SELECT * FROM joined",
        "mean_scores": "SELECT profile, dimension, round(avg(score), 6) AS mean_score, count(score) AS n, count(*) - count(score) AS n_missing FROM scores GROUP BY profile, dimension",
        "score_summary": "SELECT profile, " + ", ".join(f"round(avg(CASE WHEN dimension = '{x}' THEN score END), 6) AS {x}" for x in DIMENSIONS) + " FROM scores GROUP BY profile",
        "selected_wide": "SELECT * FROM selected",
        "catalog_facts": f"SELECT id, {_texts('selected_coded LEFT JOIN slot_kids USING (household_id)', files.LEFT_OUT)}",
        "unknown_codes": _unknown(),
        "rejected_lines": f"SELECT 's_demo' AS table, CASE WHEN CAST(id AS BIGINT) % {files.BROKEN} = 0 THEN 'rejected' ELSE 'read' END AS state, id FROM s_demo",
        "survey_job": f"SELECT sample_pick_order, id, {_texts('sample_coded LEFT JOIN slot_kids USING (household_id)', files.LEFT_OUT)}",
        "sample_file": "SELECT * FROM sample",
        "facts_file": f"SELECT sample_pick_order, id, {', '.join(GROUPS)} FROM facts",
        "persona_file": f"SELECT id, {steps_} FROM ok_{list(STEPS)[-1]}",
        "scores_file": "SELECT * FROM filed_scores",
        "named_profiles": """SELECT mode, profile, count(*) AS n, round(sum(value), 2) AS total FROM named_results, (VALUES ('all'), ('one')) AS v(mode) WHERE profile <> 'manual' GROUP BY mode, profile""",
        "scores_file_without_manual": "SELECT profile, dimension, round(avg(score), 6) AS mean_score, count(score) AS n, count(*) - count(score) AS n_missing FROM filed_scores WHERE profile <> 'manual' GROUP BY profile, dimension",
    }
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in _ctes().items())
    return {name: f"WITH {ctes}\n{body}" for name, body in final.items()}

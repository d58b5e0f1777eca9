"""A book's stored tables, and batches that come in for them, made of the test tables. Each is one SQL text that Spark and
DuckDB read alike; ``{name}`` is a test table. ``shift`` moves the ids, so that a batch meets known rows and brings new ones;
``tag`` changes what an upsert may take over."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

_BOOK = "'book_' || CAST(({0}) % 5 AS STRING)"
_CONFIDENCE = "CASE WHEN ({0}) % 4 = 0 THEN NULL ELSE CAST(({0}) % 100 AS DOUBLE) / 100 END AS confidence, CASE WHEN ({0}) % 3 = 0 THEN 'confirmed' END AS review_status"
_NAME = "'Customer#' || lpad(CAST({0} AS STRING), 9, '0')"


def _entity(shift: int, tag: str) -> str:
    k = f"c_custkey + {shift}"
    return f"""SELECT 'ent_' || CAST({k} AS STRING) AS entity_id, c_name AS entity_name, CASE WHEN ({k}) % 3 = 0 THEN 'item' ELSE 'human' END AS entity_type,
  '{tag}origin of ' || c_mktsegment AS description, {_BOOK.format(k)} AS book_id, ({k}) % 40 AS first_chapter_index, ({k}) % 40 + 5 AS last_chapter_index, 1 AS is_active, {_CONFIDENCE.format(k)},
  'lead' AS narrative_role, 'rise' AS arc_type, CASE WHEN ({k}) % 2 = 0 THEN '{{{{"personality": "calm", "memory_points": ["a", "b"]}}}}' END AS core_baseline FROM {{customer}}"""


def _alias(shift: int, tag: str) -> str:
    k = f"c_custkey + {shift}"
    return f"""SELECT 'ent_' || CAST({k} AS STRING) AS entity_id, '{tag}' || c_name AS alias_name, 'full_name' AS alias_type, {_BOOK.format(k)} AS book_id FROM {{customer}}
  UNION ALL SELECT 'ent_' || CAST({k} AS STRING), '{tag}the ' || CAST({k} AS STRING), 'nickname', {_BOOK.format(k)} FROM {{customer}} WHERE ({k}) % 2 = 0"""


def _event(shift: int, tag: str) -> str:
    k = f"o_orderkey + {shift}"
    return f"""SELECT 'ev_' || CAST({k} AS STRING) AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'stage' ELSE 'event' END AS event_level, CAST(NULL AS STRING) AS parent_event_id,
  '{tag}title ' || CAST({k} AS STRING) AS event_title, CASE WHEN ({k}) % 6 = 0 THEN 'here is Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') ELSE '{tag}' || o_orderpriority END AS event_content, '{tag}then' AS time_desc,
  ({k}) % 40 * 100000 + ({k}) % 1000 AS global_sort, ({k}) % 40 AS start_chapter, CASE WHEN ({k}) % 3 = 0 THEN ({k}) % 40 + 2 ELSE 0 END AS end_chapter, '{tag}plain' AS narrative_type, '{tag}small' AS plot_impact,
  {_BOOK.format('o_custkey')} AS book_id, {_CONFIDENCE.format(k)} FROM {{orders}}"""


def _event_entity(shift: int, tag: str) -> str:
    k = f"o_orderkey + {shift}"
    return f"""SELECT 'ev_' || CAST({k} AS STRING) AS event_id, 'ent_' || CAST(o_custkey AS STRING) AS entity_id, '{tag}present' AS role, {_BOOK.format('o_custkey')} AS book_id, ({k}) % 40 AS chapter_index FROM {{orders}}"""


def _snapshot(shift: int, tag: str) -> str:
    return f"""SELECT 's_' || entity_id || '_' || CAST(chapter_index AS STRING) AS snapshot_id, entity_id, 'Customer#' || lpad(replace(entity_id, 'ent_', ''), 9, '0') AS entity_name, 'human' AS entity_type,
  '{tag}' || status_desc AS status_desc, '{{{{"mood": "' || status_desc || '", "deep": {{{{"k' || CAST(chapter_index % 3 AS STRING) || '": ' || CAST(chapter_index AS STRING) || '}}}}}}}}' AS attributes, book_id, chapter_index, CAST(0.5 AS DOUBLE) AS confidence, CAST(NULL AS STRING) AS review_status FROM (
  SELECT 'ent_' || CAST(o_custkey AS STRING) AS entity_id, {_BOOK.format('o_custkey')} AS book_id, o_orderkey % 40 + {shift} AS chapter_index, max_by(o_orderpriority, o_orderkey) AS status_desc FROM {{orders}} GROUP BY o_custkey, o_orderkey % 40 + {shift}) g"""


def _relation(shift: int, tag: str) -> str:
    return f"""SELECT 'rel_' || a || '_' || b || '_' || relation_type || '_' || CAST(start_chapter AS STRING) AS relation_id, book_id, 'ent_' || a AS source_entity_id, 'ent_' || b AS target_entity_id, relation_type,
  '{tag}' || d AS relation_desc, w AS relation_weight, 'temporary' AS valid_period, start_chapter, CASE WHEN start_chapter % 4 = 0 THEN start_chapter + 7 ELSE 0 END AS end_chapter, start_chapter AS chapter_index,
  '{tag}calm' AS surface_relation, CASE WHEN start_chapter % 2 = 0 THEN '{tag}deep' ELSE '' END AS inner_relation, '' AS relation_trend, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS STRING) AS review_status FROM (
  SELECT CAST(o_custkey AS STRING) AS a, CAST(o_custkey % 97 + 1 AS STRING) AS b, {_BOOK.format('o_custkey')} AS book_id, CASE o_orderstatus WHEN 'F' THEN 'alliance' WHEN 'O' THEN 'enmity' ELSE 'family' END AS relation_type,
    o_orderkey % 20 + {shift} AS start_chapter, max(o_orderpriority) AS d, max(o_orderkey) % 2 + 1 AS w FROM {{orders}} GROUP BY o_custkey, o_orderstatus, o_orderkey % 20 + {shift}) g"""


def _location(shift: int, tag: str) -> str:
    k = f"n_nationkey + {shift}"
    return f"""SELECT 'loc_' || CAST({k} AS STRING) AS location_id, CAST(n_name AS STRING) AS location_name, 2 AS location_level, '{tag}place' AS description, 'book_' || CAST(n_regionkey AS STRING) AS book_id,
  CAST(({k}) % 30 AS BIGINT) AS first_chapter_index, CAST(({k}) % 30 + 4 AS BIGINT) AS last_chapter_index FROM {{nation}}"""


def _location_snapshot(shift: int, tag: str) -> str:
    return f"""SELECT 'sl_' || CAST(s_suppkey AS STRING) AS snapshot_id, 'loc_' || CAST(s_nationkey AS STRING) AS location_id, book_id, s_suppkey + {shift} AS chapter_index, '{tag}' || s_name AS status_desc, '{tag}none' AS special_rules FROM (
  SELECT s_suppkey, s_nationkey, s_name, {_BOOK.format('s_nationkey')} AS book_id FROM {{supplier}}) g"""


def _foreshadowing(shift: int, tag: str) -> str:
    k = f"p_partkey + {shift}"
    return f"""SELECT 'fs_' || CAST({k} AS STRING) AS foreshadowing_id, {_BOOK.format(k)} AS book_id, '{tag}' || p_name AS title, '{tag}' || p_type AS description, ({k}) % 40 AS setup_chapter, CASE WHEN ({k}) % 3 = 0 THEN ({k}) % 40 + 9 END AS reveal_chapter,
  CASE WHEN ({k}) % 3 = 0 THEN 'revealed' ELSE 'pending' END AS status, '{tag}item' AS foreshadowing_type, p_size % 10 + 1 AS concealment_level, '{tag}no' AS misleading_info, {_NAME.format(k)} AS involved FROM {{part}}"""


def _conflict(shift: int, tag: str) -> str:
    k = f"p_partkey + {shift}"
    return f"""SELECT 'cfl_' || CAST({k} AS STRING) AS conflict_id, {_BOOK.format(k)} AS book_id, 'conflict ' || CAST({k} AS STRING) AS conflict_title, '{tag}' || p_type AS conflict_desc, {_NAME.format(k)} AS side_a, {_NAME.format(f'({k}) % 50 + 5')} || ' and others' AS side_b,
  CASE WHEN ({k}) % 5 = 0 THEN 0 ELSE ({k}) % 40 END AS start_chapter, CASE WHEN ({k}) % 7 < 3 THEN NULL ELSE ({k}) % 40 + 3 END AS end_chapter, CASE WHEN ({k}) % 2 = 0 THEN '解决' ELSE '升级' END AS current_status FROM {{part}}"""


def _rule(shift: int, tag: str) -> str:
    k = f"p_partkey + {shift}"
    return f"""SELECT 'rul_' || CAST({k} AS STRING) AS rule_id, {_BOOK.format(k)} AS book_id, 'rule ' || CAST({k} AS STRING) AS rule_name, CASE WHEN ({k}) % 4 = 0 THEN 'balance_lock' ELSE 'cap' END AS rule_type, '{tag}' || p_type AS rule_content,
  'ent_' || CAST({k} AS STRING) AS subject_entity_id, CAST(p_brand AS STRING) AS subject_ability, ({k}) % 40 AS valid_from_chapter, 0 AS valid_to_chapter, '{tag}fine' AS last_check_result FROM {{part}}"""


def _chapter(shift: int, tag: str) -> str:
    k = f"doc_id + {shift}"
    return f"""SELECT 'nch_' || CAST({k} AS STRING) AS chapter_id, {_BOOK.format(k)} AS book_id, coalesce(source, '') AS file_name, {k} AS chapter_index_in_file, doc_id AS chapter_index, '{tag}chapter ' || CAST({k} AS STRING) AS chapter_title,
  '{tag}' || coalesce(text, '') AS chapter_text, 0 AS char_offset_start, n_chars AS char_offset_end, n_chars % 5 AS scene_count FROM {{documents}}"""


def _issue(shift: int, tag: str) -> str:
    kinds = [("entity", "'ent_'"), ("entity_relation", "'rel_'"), ("timeline_event", "'ev_'"), ("location", "'loc_'"), ("foreshadowing", "'fs_'"), ("story_conflict", "'cfl_'"), ("rule_check", "'rul_'"), ("unknown", "'x_'")]
    record = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(kinds))
    prefix = " ".join(f"WHEN {i} THEN {p}" for i, (_, p) in enumerate(kinds))
    return f"""SELECT 'vis_' || CAST(o_orderkey AS STRING) AS issue_id, {_BOOK.format('o_orderkey % 200')} AS book_id, CASE o_orderkey % 8 {record} END AS record_type, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CASE o_orderkey % 8 {prefix} END || CAST(o_orderkey % 200 AS STRING) END AS target_id,
  CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'confirmed' ELSE 'ignored' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity, 'state_jump' AS issue_type, o_orderpriority AS description,
  CASE WHEN o_orderkey % 5 = 0 THEN 'not json' ELSE '{{{{"rule_name": "' || o_orderpriority || '"}}}}' END AS suggested_value, CAST(NULL AS STRING) AS original_value, 'nch_' || CAST(o_orderkey % 300 AS STRING) AS chapter_id FROM {{orders}}"""


def _job(shift: int, tag: str) -> str:
    return f"""SELECT 'job_' || CAST(o_orderkey AS STRING) AS job_id, 'book_' || CAST(o_custkey % 100 AS STRING) AS book_id, CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status FROM {{orders}}"""


def _state(shift: int, tag: str) -> str:
    return f"""SELECT 'nch_' || CAST(o_orderkey AS STRING) AS chapter_id, 'book_' || CAST(o_orderkey % 120 AS STRING) AS book_id, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'done' END AS status, CAST(o_orderkey % 3 AS INT) AS retry_count, CAST(o_orderkey % 2 AS INT) AS shrink_level FROM {{orders}}"""


def _upload(shift: int, tag: str) -> str:
    return f"""SELECT doc_id AS id, doc_id % 7 AS user_id, 'file' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.exe' ELSE '.txt' END AS file_name, CASE doc_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'ready' ELSE 'failed' END AS status, CAST(NULL AS BIGINT) AS chunk_count, n_chars AS size, 'name ' || lang AS book_name FROM {{documents}}"""


def _chunk(shift: int, tag: str) -> str:
    return f"""SELECT doc_id % 7 AS user_id, 'file' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.exe' ELSE '.txt' END AS file_name, doc_id * 10 + i AS chunk_id, CASE WHEN lang = 'en' THEN '' ELSE 'b_' || lang END AS book_id, 'name ' || lang AS book_name
  FROM {{documents}} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) two WHERE doc_id % 2 = 0"""


def _message(shift: int, tag: str) -> str:
    return f"""SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 9 AS user_id, role, text AS content, CAST(NULL AS STRING) AS intent, CAST(NULL AS STRING) AS source_refs, CAST(NULL AS STRING) AS feedback, CAST(NULL AS STRING) AS feedback_text FROM {{conversations}}"""


TABLES: dict[str, Callable[[int, str], str]] = {
    "entity": _entity, "entity_alias": _alias, "timeline_event": _event, "timeline_event_entity": _event_entity, "entity_snapshot": _snapshot, "entity_relation": _relation, "location": _location, "location_snapshot": _location_snapshot,
    "foreshadowing": _foreshadowing, "story_conflict": _conflict, "rule_check": _rule, "novel_chapter": _chapter, "validation_issue": _issue, "deconstruct_job": _job, "chapter_state": _state, "documents": _upload, "chunk": _chunk, "messages": _message,
}


def story(t, name: str, shift: int = 0, tag: str = "") -> DataFrame:
    """A table as Spark reads it; t(name) is a test table."""
    text = TABLES[name](shift, tag)
    tables = {n: t(n) for n in set(re.findall(r"\{(\w+)\}", text.replace("{{", "").replace("}}", "")))}
    return next(iter(tables.values())).sparkSession.sql(text, **tables)


def sql(name: str, shift: int = 0, tag: str = "") -> str:
    """The same for DuckDB, in brackets."""
    text = TABLES[name](shift, tag)
    return "(" + re.sub(r"\{(\w+)\}", r"\1", text.replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}") + ")"

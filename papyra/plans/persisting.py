"""A chapter of every book, with records that pass and records that each check refuses, brought into the stored tables; and
confirmed issues stored again. The batch is one SQL text a kind, which Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators import persist as ps
from papyra.plans.registry import query
from papyra.plans.story_tables import sql, story
from papyra.session import shared_folder

CHAPTER = 41
_AT = "'book_' || CAST(({0}) % 5 AS STRING) AS book_id, CAST(41 AS BIGINT) AS chapter_index, 'calm' AS source_fragment"
_NAME = "CASE WHEN ({0}) % 10 = 0 THEN 'New #' || CAST({0} AS STRING) ELSE 'Customer#' || lpad(CAST({0} AS STRING), 9, '0') END"
_NO = "CAST(NULL AS STRING)"
BATCH = {
    "entities": f"""SELECT 'book_' || CAST(c_custkey % 5 AS STRING) AS book_id, CAST(41 AS BIGINT) AS chapter_index, CASE WHEN c_custkey % 11 = 0 THEN 'storm' ELSE 'calm' END AS source_fragment,
  {_NAME.format('c_custkey')} AS name, 'also ' || CAST(c_custkey AS STRING) AS other, CASE WHEN c_custkey % 7 = 0 THEN 'ghost' ELSE 'human' END AS type, 'somebody' AS description FROM {{customer}}""",
    "relations": f"""SELECT {_AT.format('o_custkey')}, {_NAME.format('o_custkey')} AS source, {_NAME.format('o_custkey % 97 + 1')} AS target, CASE o_orderstatus WHEN 'F' THEN 'alliance' WHEN 'O' THEN 'enmity' ELSE 'family' END AS relation_type,
  CAST(NULL AS INT) AS weight, {_NO} AS valid_period, CASE WHEN o_custkey % 5 = 3 THEN repeat('x', 600) ELSE 'told ' || max(o_orderpriority) END AS words, {_NO} AS surface_relation, {_NO} AS inner_relation, {_NO} AS relation_trend,
  CAST(0 AS BIGINT) AS start_chapter, CAST(NULL AS BIGINT) AS end_chapter FROM {{orders}} GROUP BY o_custkey, o_orderstatus""",
    "entity_snapshots": f"""SELECT {_AT.format('c_custkey')}, {_NAME.format('c_custkey')} AS entity_name, {_NO} AS entity_type, CASE WHEN c_custkey % 13 = 0 THEN repeat('y', 1200) ELSE 'other' END AS status_desc, {_NO} AS attributes FROM {{customer}}""",
    "timeline_events": f"""SELECT {_AT.format('o_custkey')}, CASE WHEN o_orderkey % 2 = 0 THEN 'title ' ELSE 'fresh ' END || CAST(o_orderkey AS STRING) AS event_title, CASE WHEN o_orderkey % 17 = 0 THEN 'part' ELSE 'event' END AS event_level,
  CASE WHEN o_orderkey % 6 = 0 THEN 'lost' ELSE '' END AS parent_title, CASE WHEN o_orderkey % 5 = 0 AND o_orderpriority = '1-URGENT' THEN 'here is ' || {_NAME.format('o_custkey')} ELSE 'nothing' END AS event_content, {_NO} AS time_desc,
  CAST(o_orderkey % 50 AS BIGINT) AS global_sort, CAST(o_orderkey % 3 AS BIGINT) AS scene, o_orderkey AS ord, CAST(0 AS BIGINT) AS start_chapter, CAST(0 AS BIGINT) AS end_chapter, {_NO} AS narrative_type, {_NO} AS plot_impact,
  CASE WHEN o_orderstatus = 'P' THEN {_NAME.format('o_custkey')} END AS involved FROM {{orders}}""",
    "locations": f"""SELECT 'book_' || CAST(n_regionkey AS STRING) AS book_id, CAST(41 AS BIGINT) AS chapter_index, 'calm' AS source_fragment, CAST(n_name AS STRING) AS name, CAST(NULL AS INT) AS level, {_NO} AS description FROM {{nation}}""",
    "location_snapshots": """SELECT 'book_' || CAST(n_regionkey AS STRING) AS book_id, CAST(41 AS BIGINT) AS chapter_index, CAST(n_name AS STRING) AS location_name, 'open' AS status_desc, CAST(NULL AS STRING) AS special_rules FROM {nation}
  UNION ALL SELECT 'book_0', CAST(41 AS BIGINT), CAST(s_name AS STRING), 'unknown', CAST(NULL AS STRING) FROM {supplier}""",
    "foreshadowings": f"""SELECT {_AT.format('p_partkey')}, 'hint ' || CAST(p_partkey AS STRING) AS title, {_NO} AS description, CAST(0 AS BIGINT) AS setup_chapter, CASE WHEN p_partkey % 3 = 0 THEN 'nowhere' ELSE '' END AS setup_event_title,
  CASE WHEN p_partkey % 8 = 1 THEN 'odd' ELSE 'pending' END AS status, {_NO} AS foreshadowing_type, CAST(NULL AS INT) AS concealment_level, {_NO} AS misleading_info FROM {{part}}""",
    "conflicts": f"""SELECT {_AT.format('p_partkey + 3')}, 'conflict ' || CAST(p_partkey + 3 AS STRING) AS conflict_title, {_NO} AS conflict_type, {_NO} AS conflict_desc, {_NO} AS side_a, {_NO} AS side_b, CAST(0 AS BIGINT) AS start_chapter, CAST(NULL AS BIGINT) AS end_chapter,
  CASE WHEN p_partkey % 2 = 0 THEN '解决' ELSE '升级' END AS current_status FROM {{part}}""",
    "rule_checks": f"""SELECT {_AT.format('p_partkey + 3')}, 'rule ' || CAST(p_partkey + 3 AS STRING) AS rule_name, CASE WHEN p_partkey % 5 = 2 AND p_partkey % 2 = 0 THEN 'odd' WHEN p_partkey % 4 = 0 THEN 'balance_lock' ELSE 'cap' END AS rule_type, 'told ' || CAST(p_partkey AS STRING) AS rule_content,
  CASE WHEN p_partkey % 9 = 0 THEN 'nobody' ELSE '' END AS subject_entity_name, CAST(p_brand AS STRING) AS subject_ability, CAST(0 AS BIGINT) AS valid_from_chapter, CAST(0 AS BIGINT) AS valid_to_chapter FROM {{part}}""",
}
STORED = ("entity", "entity_alias", "location", "entity_snapshot", "entity_relation", "timeline_event", "timeline_event_entity", "location_snapshot", "foreshadowing", "story_conflict", "rule_check")


def batch(t) -> dict[str, DataFrame]:
    spark = t("nation").sparkSession
    out = {name: spark.sql(text, **{n: t(n) for n in set(re.findall(r"\{(\w+)\}", text))}) for name, text in BATCH.items()}
    out["relations"] = out["relations"].withColumnRenamed("words", "desc")
    out["entities"] = out["entities"].withColumn("aliases", F.array("other"))
    out["timeline_events"] = out["timeline_events"].withColumn("involved_entities", F.when(F.col("involved").isNull(), F.array().cast("array<string>")).otherwise(F.array("involved")))
    out["foreshadowings"] = out["foreshadowings"].withColumn("involved_entities", F.array().cast("array<string>"))
    return out


def chapters(t) -> DataFrame:
    return t("region").select(F.concat(F.lit("book_"), F.col("r_regionkey").cast("string")).alias("book_id"), F.lit(CHAPTER).cast("long").alias("chapter_index"), F.lit("a calm text").alias("chapter_text"))


def run(t) -> ps.Persisted:
    shared_folder(t("nation").sparkSession)
    return ps.persisted(batch(t), {name: story(t, name) for name in STORED}, chapters(t), lambda df: df.checkpoint())


def _sql(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", BATCH[name])


_WITH = f"""WITH ents AS ({_sql('entities')}), ids AS (SELECT e.*, coalesce(a.entity_id, 'ent_' || substr(sha1(e.book_id || '|' || e.name), 1, 20)) AS id, a.entity_id IS NULL AS fresh
  FROM ents e LEFT JOIN {sql('entity_alias')} a ON a.book_id = e.book_id AND a.alias_name = e.name WHERE source_fragment = 'calm' AND type <> 'ghost'),
rels AS (SELECT r.*, a.id AS a, b.id AS b FROM ({_sql('relations')}) r LEFT JOIN ids a ON a.book_id = r.book_id AND a.name = r.source LEFT JOIN ids b ON b.book_id = r.book_id AND b.name = r.target),
evs AS (SELECT e.*, coalesce(k.event_id, 'ev_' || substr(sha1(e.book_id || '|' || e.event_title), 1, 20)) AS id, k.event_id IS NULL AS fresh FROM ({_sql('timeline_events')}) e LEFT JOIN {sql('timeline_event')} k ON k.book_id = e.book_id AND k.event_title = e.event_title),
good AS (SELECT *, lag(global_sort, 1, -1) OVER (PARTITION BY book_id, scene ORDER BY ord) AS prior FROM evs WHERE parent_title = ''),
before AS (SELECT book_id, entity_name, max_by(status_desc, chapter_index) AS status FROM {sql('entity_snapshot')} GROUP BY ALL),
told AS (SELECT book_id, involved AS name FROM good WHERE involved IS NOT NULL UNION SELECT book_id, substr(event_content, 9) FROM good WHERE event_content <> 'nothing'),
snaps AS (SELECT s.*, i.id, b.status IS NOT NULL AND b.status <> s.status_desc AND NOT EXISTS (SELECT 1 FROM told WHERE told.book_id = s.book_id AND told.name = s.entity_name) AS jump
  FROM ({_sql('entity_snapshots')}) s LEFT JOIN ids i ON i.book_id = s.book_id AND i.name = s.entity_name LEFT JOIN before b ON b.book_id = s.book_id AND b.entity_name = s.entity_name),
fores AS ({_sql('foreshadowings')}), rules AS ({_sql('rule_checks')}), sound AS (SELECT * FROM rules WHERE subject_entity_name = ''), stored_rules AS (SELECT * FROM sound WHERE book_id NOT IN (SELECT book_id FROM sound WHERE rule_type = 'odd'))"""
_ISSUES = """SELECT book_id, 'entities' AS record_type, 'unsupported_change' AS issue_type FROM ents WHERE source_fragment = 'storm'
UNION ALL SELECT book_id, 'entity', 'persist_error' FROM ents WHERE source_fragment = 'calm' AND type = 'ghost'
UNION ALL SELECT book_id, 'entity_relation', 'rule_violation' FROM rels WHERE a IS NULL OR b IS NULL
UNION ALL SELECT DISTINCT book_id, 'entity_relation', 'persist_error' FROM rels WHERE a IS NOT NULL AND b IS NOT NULL AND length(words) > 500
UNION ALL SELECT book_id, 'entity_snapshot', 'rule_violation' FROM snaps WHERE id IS NULL
UNION ALL SELECT book_id, 'entity_snapshot', 'state_jump' FROM snaps WHERE id IS NOT NULL AND jump
UNION ALL SELECT book_id, 'entity_snapshot', 'persist_error' FROM snaps WHERE id IS NOT NULL AND NOT jump AND length(status_desc) > 1000
UNION ALL SELECT book_id, 'timeline_event', 'rule_violation' FROM evs WHERE parent_title <> ''
UNION ALL SELECT book_id, 'timeline_event', 'timeline_paradox' FROM good WHERE global_sort < prior
UNION ALL SELECT book_id, 'timeline_event', 'persist_error' FROM good WHERE event_level = 'part'
UNION ALL SELECT book_id, 'foreshadowing', 'rule_violation' FROM fores WHERE setup_event_title <> ''
UNION ALL SELECT book_id, 'foreshadowing', 'persist_error' FROM fores WHERE setup_event_title = '' AND status = 'odd'
UNION ALL SELECT book_id, 'rule_check', 'rule_violation' FROM rules WHERE subject_entity_name <> ''
UNION ALL SELECT book_id, 'rule_check', 'rule_violation' FROM sound WHERE rule_type <> 'odd' GROUP BY book_id, subject_ability HAVING count(DISTINCT rule_content) FILTER (rule_type = 'cap') > 1 AND NOT bool_or(rule_type = 'balance_lock')
UNION ALL SELECT DISTINCT book_id, 'rule_check', 'persist_error' FROM sound WHERE rule_type = 'odd'"""


@query("persist_issues", f"{_WITH} SELECT book_id, record_type, issue_type, count(*) AS n FROM ({_ISSUES}) GROUP BY ALL")
def _(t):
    return run(t).issues.groupBy("book_id", "record_type", "issue_type").agg(F.count("*").alias("n"))


@query("persist_outcome", f"""{_WITH}, kept AS (SELECT book_id, 'entity' AS record_type FROM ids UNION ALL SELECT book_id, 'entity_relation' FROM rels WHERE a IS NOT NULL AND b IS NOT NULL AND book_id <> 'book_3'
UNION ALL SELECT book_id, 'entity_snapshot' FROM snaps WHERE id IS NOT NULL AND NOT jump AND length(status_desc) < 1000 UNION ALL SELECT book_id, 'timeline_event' FROM good WHERE event_level = 'event'
UNION ALL SELECT 'book_' || n_regionkey, 'location' FROM nation UNION ALL SELECT 'book_' || n_regionkey, 'location_snapshot' FROM nation UNION ALL SELECT book_id, 'foreshadowing' FROM fores WHERE setup_event_title = '' AND status <> 'odd'
UNION ALL SELECT book_id, 'story_conflict' FROM ({_sql('conflicts')}) UNION ALL SELECT book_id, 'rule_check' FROM stored_rules),
every AS (SELECT book_id, record_type, 1 AS s, 0 AS o FROM kept UNION ALL SELECT book_id, CASE record_type WHEN 'entities' THEN 'entity' ELSE record_type END, 0, 1 FROM ({_ISSUES}))
SELECT book_id, record_type, sum(s)::BIGINT AS stored, sum(o)::BIGINT AS set_aside FROM every GROUP BY ALL""")
def _(t):
    return run(t).outcome.select("book_id", "record_type", "stored", "set_aside")


#: Of each stored table: what names a row, and what is compared of it.
SHOWN = {
    "entity": ("entity_id", "concat_ws(',', entity_name, first_chapter_index, last_chapter_index)"),
    "entity_alias": ("concat(book_id, '/', alias_name)", "entity_id"),
    "location": ("location_id", "concat_ws(',', first_chapter_index, last_chapter_index)"),
    "entity_snapshot": ("concat(entity_id, '@', chapter_index)", "concat_ws(',', snapshot_id, status_desc)"),
    "entity_relation": ("relation_id", "concat_ws(',', relation_desc, start_chapter, end_chapter, chapter_index)"),
    "timeline_event": ("event_id", "concat_ws(',', event_title, event_level, global_sort, start_chapter, end_chapter)"),
    "timeline_event_entity": ("concat(event_id, '/', entity_id)", "role"),
    "location_snapshot": ("concat(location_id, '@', chapter_index)", "status_desc"),
    "foreshadowing": ("foreshadowing_id", "concat_ws(',', title, status, setup_chapter)"),
    "story_conflict": ("concat(book_id, '/', conflict_title)", "concat_ws(',', current_status, start_chapter, end_chapter)"),
    "rule_check": ("concat(book_id, '/', rule_name)", "concat_ws(',', rule_content, rule_type, valid_from_chapter)"),
}


def shown(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, (key, value) in SHOWN.items():
        one = tables[name].select(F.lit(name).alias("tab"), F.expr(key).alias("k"), F.expr(value).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def _old(name: str) -> str:
    return f"SELECT '{name}' AS tab, {SHOWN[name][0]} AS k, {SHOWN[name][1]} AS v FROM {sql(name)}"


def _over(name: str, fresh: str) -> str:
    """Stored rows, but those with a key of ``fresh`` (k, v) as there."""
    return f"SELECT '{name}' AS tab, coalesce(f.k, o.k) AS k, coalesce(f.v, o.v) AS v FROM ({_old(name)}) o FULL JOIN ({fresh}) f ON f.k = o.k"


_OPEN = "s.book_id, source_entity_id, target_entity_id"
_TABLES = f"""{_WITH},
ok_rels AS (SELECT * FROM rels WHERE a IS NOT NULL AND b IS NOT NULL AND length(words) <= 500),
pairs AS (SELECT DISTINCT book_id, a, b FROM ok_rels),
st AS (SELECT s.*, row_number() OVER (PARTITION BY {_OPEN}, s.relation_type, s.end_chapter = 0 ORDER BY s.start_chapter, relation_id) AS nth, p.a IS NOT NULL AS seen, r.words AS new
  FROM {sql('entity_relation')} s LEFT JOIN pairs p ON p.book_id = s.book_id AND p.a = source_entity_id AND p.b = target_entity_id
  LEFT JOIN ok_rels r ON r.book_id = s.book_id AND r.a = source_entity_id AND r.b = target_entity_id AND r.relation_type = s.relation_type)
{_over('entity', "SELECT id AS k, concat_ws(',', name, least(coalesce(first_chapter_index, 41), 41), greatest(coalesce(last_chapter_index, 41), 41)) AS v FROM ids LEFT JOIN " + sql('entity') + " e ON e.entity_id = id")}
UNION ALL {_old('entity_alias')} UNION ALL SELECT 'entity_alias', concat(book_id, '/', x), id FROM (SELECT book_id, id, unnest([name, other]) AS x FROM ids WHERE fresh)
UNION ALL {_over('location', "SELECT location_id AS k, concat_ws(',', least(first_chapter_index, 41), greatest(last_chapter_index, 41)) AS v FROM " + sql('location'))}
UNION ALL {_over('entity_snapshot', "SELECT concat(id, '@', 41) AS k, concat_ws(',', concat('s_', id, '_', 41), status_desc) AS v FROM snaps WHERE id IS NOT NULL AND NOT jump AND length(status_desc) < 1000")}
UNION ALL SELECT 'entity_relation', relation_id, CASE WHEN end_chapter = 0 AND new IS NOT NULL AND nth = 1 THEN concat_ws(',', new, start_chapter, 0, 41) WHEN end_chapter = 0 AND seen THEN concat_ws(',', relation_desc, start_chapter, 40, chapter_index) ELSE concat_ws(',', relation_desc, start_chapter, end_chapter, chapter_index) END FROM st
UNION ALL SELECT 'entity_relation', 'rel_' || substr(sha1(concat_ws('|', book_id, a, b, relation_type, 41)), 1, 20), concat_ws(',', words, 41, 0, 41) FROM ok_rels r WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.book_id = r.book_id AND source_entity_id = a AND target_entity_id = b AND st.relation_type = r.relation_type AND end_chapter = 0)
UNION ALL {_over('timeline_event', "SELECT id AS k, CASE WHEN parent_title = '' AND event_level <> 'part' THEN concat_ws(',', event_title, coalesce(k.level, event_level), 4100000 + scene * 1000 + global_sort, 41, 0) ELSE concat_ws(',', event_title, event_level, 0, 0, 0) END AS v FROM evs e LEFT JOIN (SELECT event_id, event_level AS level FROM " + sql('timeline_event') + ") k ON k.event_id = id WHERE fresh OR (parent_title = '' AND event_level <> 'part')")}
UNION ALL {_over('timeline_event_entity', "SELECT concat(e.id, '/', i.id) AS k, '在场' AS v FROM good e JOIN ids i ON i.book_id = e.book_id AND i.name = e.involved WHERE event_level <> 'part'")}
UNION ALL {_over('location_snapshot', "SELECT concat(location_id, '@', 41) AS k, 'open' AS v FROM " + sql('location'))}
UNION ALL {_over('foreshadowing', "SELECT 'fs_' || substr(sha1(concat_ws('|', book_id, title, 41)), 1, 20) AS k, concat_ws(',', title, status, 41) AS v FROM fores WHERE setup_event_title = '' AND status <> 'odd'")}
UNION ALL {_over('story_conflict', "SELECT concat(c.book_id, '/', c.conflict_title) AS k, CASE WHEN o.conflict_id IS NULL THEN concat_ws(',', c.current_status, 41, NULL) ELSE concat_ws(',', c.current_status, o.start_chapter, CASE WHEN c.current_status = '解决' THEN 41 ELSE 0 END) END AS v FROM (" + _sql('conflicts') + ") c LEFT JOIN " + sql('story_conflict') + " o USING (book_id, conflict_title)")}
UNION ALL {_over('rule_check', "SELECT concat(r.book_id, '/', r.rule_name) AS k, concat_ws(',', r.rule_content, r.rule_type, coalesce(o.valid_from_chapter, 41)) AS v FROM stored_rules r LEFT JOIN " + sql('rule_check') + " o USING (book_id, rule_name)")}"""


@query("persist_tables", _TABLES)
def _(t):
    return shown(run(t).tables)


# Issues stored again --------------------------------------------------------------------------------------------------

_KINDS = ["entity", "entity_relation", "entity_snapshot", "timeline_event", "location_snapshot", "foreshadowing", "story_conflict", "rule_check", "unknown"]
_K = "CAST(o_orderkey AS STRING)"
_C = "'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0')"
_VALUES = {
    "entity": f"""'{{{{"name": "Again ' || {_K} || '", "type": "' || CASE WHEN o_orderkey % 5 = 1 THEN 'ghost' ELSE 'item' END || '"}}}}'""",
    "entity_relation": f"""'{{{{"source": "' || {_C} || '", "target": "Somebody ' || CAST(o_custkey AS STRING) || '", "relation_type": "family", "relation_desc": "' || CASE WHEN o_orderkey % 5 = 1 THEN repeat('z', 501) ELSE {_K} END || '", "start_chapter": ' || {_K} || '}}}}'""",
    "entity_snapshot": f"""'{{{{"entity_name": "' || {_C} || '", "status_desc": "again", "chapter_index": ' || {_K} || '}}}}'""",
    "timeline_event": f"""'{{{{"event_title": "title again ' || {_K} || '", "event_level": "' || CASE WHEN o_orderkey % 5 = 1 THEN 'part' ELSE 'stage' END || '", "event_content": "again"}}}}'""",
    "location_snapshot": f"""'{{{{"location_id": "loc_' || CAST(o_orderkey % 25 AS STRING) || '", "status_desc": "again", "chapter_index": ' || CAST(1000 + o_orderkey AS STRING) || '}}}}'""",
    "foreshadowing": f"""'{{{{"title": "again ' || {_K} || '"}}}}'""",
    "story_conflict": f"""'{{{{"conflict_title": "conflict ' || {_K} || '", "current_status": "again"}}}}'""",
    "rule_check": f"""'{{{{"rule_name": "rule ' || {_K} || '", "rule_content": "again", "rule_type": "' || CASE WHEN o_orderkey % 5 = 1 THEN 'odd' ELSE 'cap' END || '"}}}}'""",
    "unknown": "'{{}}'",
}
ISSUES = f"""SELECT 'vis_' || lpad({_K}, 9, '0') AS issue_id, 'book_' || CAST(o_custkey % 5 AS STRING) AS book_id, CASE o_orderkey % 9 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS record_type,
  CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'confirmed' ELSE 'ignored' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN '[1' ELSE CASE o_orderkey % 9 {' '.join(f"WHEN {i} THEN {_VALUES[k]}" for i, k in enumerate(_KINDS))} END END AS suggested_value FROM {{orders}}"""


def issues(t) -> DataFrame:
    return t("orders").sparkSession.sql(ISSUES, orders=t("orders"))


_ASKED = f"""WITH asked AS (SELECT *, CAST(substr(issue_id, 5) AS BIGINT) AS ok, CASE WHEN status = 'ignored' THEN 'not open' WHEN record_type = 'unknown' THEN 'unknown type' WHEN suggested_value = '[1' THEN 'not read'
  WHEN CAST(substr(issue_id, 5) AS BIGINT) % 5 = 1 AND record_type IN ('entity', 'entity_relation', 'timeline_event', 'rule_check') THEN 'not stored' ELSE 'fixed' END AS outcome
  FROM ({ISSUES.replace('{orders}', 'orders').replace('{{', '{').replace('}}', '}')}) AS i),
o AS (SELECT a.*, o_custkey AS ck, 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS cname, 'ent_' || o_custkey AS cid, 'Somebody ' || o_custkey AS other, 'ent_' || substr(sha1(book_id || '|Somebody ' || o_custkey), 1, 20) AS oid FROM asked a JOIN orders ON o_orderkey = ok),
tried AS (SELECT * FROM o WHERE outcome IN ('fixed', 'not stored')), done AS (SELECT * FROM o WHERE outcome = 'fixed')"""


@query("repersist_outcome", f"{_ASKED} SELECT issue_id, record_type, CASE WHEN outcome = 'fixed' THEN 'fixed' ELSE status END AS status, outcome FROM asked")
def _(t):
    out = again(t)
    return out.issues.join(out.outcome, "issue_id").select("issue_id", "record_type", "status", "outcome")


@query("repersist_totals", f"{_ASKED} SELECT book_id, count(*) AS total, count(*) FILTER (outcome = 'fixed') AS succeeded FROM asked GROUP BY ALL")
def _(t):
    return again(t).totals


def again(t) -> ps.Repersisted:
    shared_folder(t("orders").sparkSession)
    return ps.repersisted(issues(t), {name: story(t, name) for name in STORED}, checkpoint=lambda df: df.checkpoint())


_AGAIN = f"""{_ASKED},
seen AS (SELECT DISTINCT book_id, cname AS x, cid AS id FROM tried WHERE record_type IN ('entity_relation', 'entity_snapshot')
  UNION SELECT DISTINCT book_id, other, oid FROM tried WHERE record_type = 'entity_relation' UNION SELECT book_id, 'Again ' || ok, 'ent_' || substr(sha1(book_id || '|Again ' || ok), 1, 20) FROM done WHERE record_type = 'entity')
{_over('entity', "SELECT id AS k, concat_ws(',', x, 0, coalesce(last_chapter_index, 0)) AS v FROM seen LEFT JOIN " + sql('entity') + " e ON e.entity_id = id")}
UNION ALL {_over('entity_alias', "SELECT concat(book_id, '/', x) AS k, id AS v FROM seen")}
UNION ALL {_old('location')} UNION ALL {_old('timeline_event_entity')}
UNION ALL {_over('entity_snapshot', "SELECT concat(cid, '@', ok) AS k, concat_ws(',', concat('s_', cid, '_', ok), 'again') AS v FROM done WHERE record_type = 'entity_snapshot'")}
UNION ALL {_over('entity_relation', "SELECT 'rel_re_' || right(issue_id, 8) AS k, concat_ws(',', ok, ok, 0, 0) AS v FROM done WHERE record_type = 'entity_relation'")}
UNION ALL {_over('timeline_event', "SELECT 'ev_' || substr(sha1(book_id || '|title again ' || ok), 1, 20) AS k, concat_ws(',', 'title again ' || ok, CASE outcome WHEN 'fixed' THEN 'stage' ELSE 'part' END, 0, 0, 0) AS v FROM tried WHERE record_type = 'timeline_event'")}
UNION ALL {_over('location_snapshot', "SELECT concat('loc_', ok % 25, '@', 1000 + ok) AS k, 'again' AS v FROM done WHERE record_type = 'location_snapshot'")}
UNION ALL {_over('foreshadowing', "SELECT 'fs_re_' || right(issue_id, 8) AS k, concat_ws(',', 'again ' || ok, 'pending', 0) AS v FROM done WHERE record_type = 'foreshadowing'")}
UNION ALL {_over('story_conflict', "SELECT concat(book_id, '/conflict ', ok) AS k, concat_ws(',', 'again', coalesce(c.start_chapter, 0), NULL) AS v FROM done LEFT JOIN (SELECT book_id AS cb, conflict_title, start_chapter FROM " + sql('story_conflict') + ") c ON cb = book_id AND conflict_title = 'conflict ' || ok WHERE record_type = 'story_conflict'")}
UNION ALL {_over('rule_check', "SELECT concat(book_id, '/rule ', ok) AS k, concat_ws(',', 'again', 'cap', coalesce(r.valid_from_chapter, 1)) AS v FROM done LEFT JOIN (SELECT book_id AS rb, rule_name, valid_from_chapter FROM " + sql('rule_check') + ") r ON rb = book_id AND rule_name = 'rule ' || ok WHERE record_type = 'rule_check'")}"""


@query("repersist_tables", _AGAIN)
def _(t):
    return shown(again(t).tables)

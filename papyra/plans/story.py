"""Stored tables, checks, reviews, guards and cards over the tables of ``story_tables``."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions.embed import HashedGrams
from papyra.operators import agents as ag
from papyra.operators import cards as cd
from papyra.operators import checks as ck
from papyra.operators import review as rv
from papyra.operators import stored as st
from papyra.operators.intervals import valid_rows
from papyra.plans.registry import query
from papyra.plans.story_tables import sql, story

SHIFT, TAG = 3, "new "


def _upsert_sql(name: str) -> str:
    """Rows that the batch doesn't meet; those it does, with what it may change; those that are new."""
    keys, update = st.UPSERTS[name]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    changed = ", ".join(f"b.{c} AS {c}" for c in update)
    a, b = sql(name), sql(name, SHIFT, TAG)
    return f"SELECT a.* FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE {on}) UNION ALL SELECT a.* REPLACE ({changed}) FROM {a} a JOIN {b} b ON {on} UNION ALL SELECT b.* FROM {b} b WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE {on})"


def _register_upserts() -> None:
    for name in st.UPSERTS:

        def run(t, name=name):
            return st.upsert_table(name, story(t, name), story(t, name, SHIFT, TAG))

        query(f"upsert_{name}", _upsert_sql(name))(run)


_register_upserts()


@query("register_locations", f"WITH a AS {sql('location')}, i AS (SELECT DISTINCT * FROM (SELECT 'book_' || CAST(n_regionkey AS STRING) AS book_id, n_name AS nm, CAST(n_nationkey AS BIGINT) AS ch FROM nation UNION ALL SELECT 'book_0', s_name, s_suppkey FROM supplier) WHERE trim(nm) <> ''), g AS (SELECT book_id, nm, min(ch) AS f, max(ch) AS l FROM i GROUP BY ALL) SELECT coalesce(a.location_name, g.nm) AS location_name, coalesce(a.book_id, g.book_id) AS book_id, coalesce(a.location_level, 4) AS location_level, least(coalesce(first_chapter_index, f), coalesce(f, first_chapter_index)) AS first_chapter_index, greatest(coalesce(last_chapter_index, l), coalesce(l, last_chapter_index)) AS last_chapter_index FROM a FULL JOIN g ON a.book_id = g.book_id AND a.location_name = g.nm")
def _(t):
    n = t("nation").select(F.concat(F.lit("book_"), F.col("n_regionkey").cast("string")).alias("book_id"), F.col("n_name").alias("location_name"), F.col("n_nationkey").cast("long").alias("chapter_index"))
    seen = n.unionByName(t("supplier").select(F.lit("book_0").alias("book_id"), F.col("s_name").alias("location_name"), F.col("s_suppkey").alias("chapter_index")))
    seen = seen.withColumns({"location_level": F.lit(None).cast("int"), "description": F.lit(None).cast("string")})
    return st.registered_locations(seen, story(t, "location"))[0].select("location_name", "book_id", "location_level", "first_chapter_index", "last_chapter_index")


@query("resolve_titles", f"WITH a AS {sql('timeline_event')}, b AS {sql('timeline_event', 40, '')}, w AS (SELECT book_id, event_title, min(event_level) AS event_level FROM b WHERE trim(event_title) <> '' GROUP BY ALL), k AS (SELECT book_id, event_title, min(event_id) AS event_id FROM a GROUP BY ALL) SELECT w.book_id, w.event_title, k.event_id AS known_id, k.event_id IS NULL AS fresh FROM w LEFT JOIN k USING (book_id, event_title)")
def _(t):
    fresh, every = st.resolved_titles(story(t, "timeline_event", 40), story(t, "timeline_event"))
    new = fresh.select("event_id", F.lit(True).alias("__new"))
    out = every.join(new, "event_id", "left").withColumn("fresh", F.coalesce("__new", F.lit(False)))
    return out.select("book_id", "event_title", F.when(~F.col("fresh"), F.col("event_id")).alias("known_id"), "fresh")


@query("merge_rules", f"WITH a AS {sql('rule_check')}, b AS {sql('rule_check', SHIFT, TAG)} SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.rule_name, b.rule_name) AS rule_name, coalesce(b.rule_content, a.rule_content) AS rule_content, coalesce(b.rule_type, a.rule_type) AS rule_type, coalesce(a.valid_from_chapter, b.valid_from_chapter) AS valid_from_chapter FROM a FULL JOIN b ON a.book_id = b.book_id AND a.rule_name = b.rule_name")
def _(t):
    return st.merged_rules(story(t, "rule_check"), story(t, "rule_check", SHIFT, TAG)).select("rule_id", "rule_name", "rule_content", "rule_type", "valid_from_chapter")


@query("merge_conflicts", f"WITH a AS {sql('story_conflict')}, b AS {sql('story_conflict', SHIFT, TAG)} SELECT coalesce(a.conflict_id, b.conflict_id) AS conflict_id, coalesce(b.conflict_desc, a.conflict_desc) AS conflict_desc, CASE WHEN a.conflict_id IS NOT NULL THEN a.start_chapter WHEN b.start_chapter = 0 THEN 30 ELSE b.start_chapter END AS start_chapter, CASE WHEN b.conflict_id IS NULL THEN a.end_chapter WHEN a.conflict_id IS NULL THEN b.end_chapter WHEN b.end_chapter IS NOT NULL THEN b.end_chapter WHEN b.current_status = '解决' THEN 30 ELSE 0 END AS end_chapter FROM a FULL JOIN b ON a.book_id = b.book_id AND a.conflict_title = b.conflict_title")
def _(t):
    batch = story(t, "story_conflict", SHIFT, TAG).withColumn("chapter_index", F.lit(30).cast("long"))
    return st.merged_conflicts(story(t, "story_conflict"), batch).select("conflict_id", "conflict_desc", "start_chapter", "end_chapter")


@query("consolidate_relations", f"WITH a AS {sql('entity_relation')}, o AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY book_id, source_entity_id, target_entity_id, relation_type) AS c, last_value(relation_desc) OVER (PARTITION BY book_id, source_entity_id, target_entity_id, relation_type ORDER BY start_chapter, relation_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d, last_value(relation_weight) OVER (PARTITION BY book_id, source_entity_id, target_entity_id, relation_type ORDER BY start_chapter, relation_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM a WHERE end_chapter = 0 WINDOW w AS (PARTITION BY book_id, source_entity_id, target_entity_id, relation_type ORDER BY start_chapter, relation_id)) SELECT relation_id, d AS relation_desc, w AS relation_weight FROM o WHERE n = 1 UNION ALL SELECT relation_id, relation_desc, relation_weight FROM a WHERE end_chapter <> 0")
def _(t):
    return st.consolidated(story(t, "entity_relation"))[0].select("relation_id", "relation_desc", "relation_weight")


@query("backfill_entity_ranges", f"WITH s AS (SELECT entity_id, min(chapter_index) AS f, max(chapter_index) AS l FROM {sql('entity_snapshot')} GROUP BY ALL) SELECT a.entity_id, coalesce(f, first_chapter_index) AS first_chapter_index, coalesce(l, last_chapter_index) AS last_chapter_index FROM {sql('entity')} a LEFT JOIN s USING (entity_id)")
def _(t):
    out = st.filled_ranges(story(t, "entity"), "entity_id", story(t, "entity_snapshot"), {"first_chapter_index": "min", "last_chapter_index": "max"})
    return out.select("entity_id", "first_chapter_index", "last_chapter_index")


@query("backfill_zero_starts", f"SELECT 'rule_check' AS tab, count(*) AS n, (SELECT count(*) FROM {sql('rule_check')} WHERE valid_from_chapter IN (0, 1)) AS ones FROM {sql('rule_check')} WHERE valid_from_chapter = 0 UNION ALL SELECT 'foreshadowing', count(*), (SELECT count(*) FROM {sql('foreshadowing')} WHERE setup_chapter IN (0, 1)) FROM {sql('foreshadowing')} WHERE setup_chapter = 0")
def _(t):
    out = []
    for name, column in (("rule_check", "valid_from_chapter"), ("foreshadowing", "setup_chapter")):
        table, dry = st.without_zero(story(t, name), column, 1)
        ones = table.agg(F.count_if(F.col(column) == 1).alias("ones"))
        out.append(dry.join(F.broadcast(ones)).select(F.lit(name).alias("tab"), "n", "ones"))  # one row each
    return out[0].unionByName(out[1])


_SIDES = f"""WITH c AS {sql('story_conflict')}, s AS {sql('entity_snapshot')}, p AS (SELECT e.book_id, e.chapter_index, n.entity_name FROM {sql('timeline_event_entity')} e JOIN {sql('entity')} n USING (entity_id)),
x AS (SELECT conflict_id, book_id, unnest([side_a, side_b]) AS nm FROM c),
sr AS (SELECT conflict_id, min(chapter_index) AS f, max(chapter_index) AS l FROM x JOIN s ON s.book_id = x.book_id AND s.entity_name = x.nm GROUP BY ALL), pr AS (SELECT conflict_id, min(chapter_index) AS f FROM x JOIN p ON p.book_id = x.book_id AND p.entity_name = x.nm GROUP BY ALL)"""


@query("conflict_ranges", f"{_SIDES} SELECT c.conflict_id, CASE WHEN c.start_chapter = 0 THEN coalesce(sr.f, pr.f, 0) ELSE c.start_chapter END AS start_chapter, CASE WHEN c.end_chapter IS NULL AND current_status = '解决' THEN sr.l ELSE c.end_chapter END AS end_chapter FROM c LEFT JOIN sr USING (conflict_id) LEFT JOIN pr USING (conflict_id)")
def _(t):
    part = story(t, "timeline_event_entity").join(story(t, "entity").select("entity_id", "entity_name"), "entity_id").select("book_id", "entity_name", "chapter_index")
    return st.conflict_ranges(story(t, "story_conflict"), story(t, "entity_snapshot"), part).select("conflict_id", "start_chapter", "end_chapter")


@query("book_ids", f"WITH k AS (SELECT book_name, min(book_id) AS old FROM {sql('chunk')} WHERE book_id <> '' GROUP BY ALL) SELECT DISTINCT d.book_name, k.old IS NOT NULL AS known, k.old AS known_id FROM {sql('documents')} d LEFT JOIN k USING (book_name)")
def _(t):
    out = st.book_ids(story(t, "documents"), story(t, "chunk"))
    return out.select("book_name", "known", F.when(F.col("known"), F.col("book_id")).alias("known_id"))


@query("message_update", f"SELECT id, CASE WHEN role = 'assistant' THEN 'answer' END AS intent, CASE WHEN role = 'assistant' THEN '[' || id || ']' END AS source_refs FROM {sql('messages')}")
def _(t):
    m = story(t, "messages")
    changes = m.filter("role = 'assistant'").select("id", F.lit("answer").alias("intent"), F.format_string("[%d]", "id").alias("source_refs"))
    return st.updated_by_id(m, changes, "id", ["intent", "source_refs"]).select("id", "intent", "source_refs")


@query("interval_valid_per_row", f"SELECT s.snapshot_id, s.chapter_index, r.relation_id FROM {sql('entity_snapshot')} s JOIN {sql('entity_relation')} r ON r.book_id = s.book_id AND r.source_entity_id = s.entity_id AND r.start_chapter <= s.chapter_index AND (r.end_chapter = 0 OR r.end_chapter >= s.chapter_index)")
def _(t):
    """Each snapshot with the relations of its entity that hold in its chapter."""
    relations = story(t, "entity_relation").withColumn("entity_id", F.col("source_entity_id"))
    met = valid_rows(story(t, "entity_snapshot"), relations, ["book_id", "entity_id"], "chapter_index")
    return met.select("point.snapshot_id", "point.chapter_index", "interval.relation_id")


# Checks ---------------------------------------------------------------------------------------------------------------

_CHAPTERS = "SELECT DISTINCT book_id, chapter_index, 'a calm text' AS chapter_text FROM b"


def _snapshot_batch(t):
    s = story(t, "entity_snapshot", 0, "").withColumn("source_fragment", F.when(F.col("chapter_index") % 4 == 0, "storm").when(F.col("chapter_index") % 4 == 1, "").otherwise("calm"))
    return s.withColumn("entity_name", F.when(F.col("chapter_index") % 11 == 0, "nobody").otherwise(F.col("entity_name")))


_SNAPSHOTS = f"b AS (SELECT * REPLACE (CASE WHEN chapter_index % 11 = 0 THEN 'nobody' ELSE entity_name END AS entity_name), CASE WHEN chapter_index % 4 = 0 THEN 'storm' WHEN chapter_index % 4 = 1 THEN '' ELSE 'calm' END AS source_fragment FROM {sql('entity_snapshot')})"
_EVENTS = f"ev AS (SELECT book_id, start_chapter AS chapter_index, 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS nm, event_content FROM (SELECT e.*, o_custkey FROM {sql('timeline_event')} e JOIN orders ON event_id = 'ev_' || o_orderkey) WHERE event_level = 'stage' OR event_content LIKE 'here is%')"


def _events(t):
    """Events with those who take part, for stages only; others have them in their content, at times."""
    e = story(t, "timeline_event").join(story(t, "timeline_event_entity").select("event_id", "entity_id"), "event_id").join(story(t, "entity").select("entity_id", "entity_name"), "entity_id")
    involved = F.when(F.col("event_level") == "stage", F.array("entity_name")).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", "book_id", F.col("start_chapter").alias("chapter_index"), "event_content", involved.alias("involved_entities"), "event_title", "event_level")


@query("fk_checks", f"WITH {_SNAPSHOTS}, n AS (SELECT book_id, entity_name FROM {sql('entity')}) SELECT snapshot_id, n.entity_name IS NULL AS refused FROM b LEFT JOIN n USING (book_id, entity_name)")
def _(t):
    names = {"entity": story(t, "entity").select("book_id", F.col("entity_name").alias("name"))}
    good, bad = ck.referred("entity_snapshots", _snapshot_batch(t), names)
    return good.select("snapshot_id", F.lit(False).alias("refused")).unionByName(bad.select(F.col("target_id").alias("snapshot_id"), F.lit(True).alias("refused")))


@query("event_supports", f"WITH {_EVENTS}, p AS (SELECT DISTINCT book_id, chapter_index, entity_name FROM {sql('entity_snapshot')}) SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM ev WHERE ev.book_id = p.book_id AND ev.chapter_index = p.chapter_index AND (ev.nm = p.entity_name AND ev.event_content NOT LIKE 'here is%' OR contains(ev.event_content, p.entity_name) OR ev.nm = p.entity_name))")
def _(t):
    pairs = story(t, "entity_snapshot").select("book_id", "chapter_index", "entity_name").distinct()
    return ck.supported(pairs, _events(t))


@query("state_continuity", f"WITH {_EVENTS}, s AS {sql('entity_snapshot')}, p AS (SELECT book_id, entity_name, max(status_desc) AS before FROM s WHERE chapter_index < 10 GROUP BY ALL), f AS (SELECT s.*, p.before FROM s JOIN p USING (book_id, entity_name) WHERE chapter_index = 10 AND before <> status_desc) SELECT snapshot_id, before, status_desc FROM f WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.book_id = f.book_id AND ev.chapter_index = 10 AND (ev.nm = f.entity_name OR contains(ev.event_content, f.entity_name)))")
def _(t):
    s = story(t, "entity_snapshot")
    before = s.filter("chapter_index < 10").groupBy("book_id", "entity_name").agg(F.max("status_desc").alias("status_desc"))
    _, bad = ck.continuous(before, s.filter("chapter_index = 10"), _events(t))
    return bad.select(F.col("target_id").alias("snapshot_id"), F.col("original_value").alias("before"), F.col("suggested_value").alias("status_desc"))


@query("validation_plan", f"""WITH {_SNAPSHOTS}, n AS (SELECT book_id, entity_name FROM {sql('entity')}), r AS (SELECT *, subject_ability || '!' AS source_fragment FROM {sql('rule_check')}),
good AS (SELECT b.* FROM b JOIN n USING (book_id, entity_name)), caps AS (SELECT book_id, valid_from_chapter, subject_ability FROM r GROUP BY ALL HAVING count(DISTINCT rule_content) FILTER (rule_type = 'cap') > 1 AND NOT bool_or(rule_type = 'balance_lock'))
SELECT 'entity_snapshot' AS record_type, 'rule_violation' AS issue_type, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.book_id = b.book_id AND n.entity_name = b.entity_name) HAVING count(*) > 0
UNION ALL SELECT 'rule_check', 'rule_violation', count(*) FROM caps HAVING count(*) > 0
UNION ALL SELECT 'entity_snapshots', 'unsupported_change', count(*) FROM good WHERE source_fragment = 'storm' HAVING count(*) > 0
UNION ALL SELECT 'rule_checks', 'unsupported_change', count(*) FROM r HAVING count(*) > 0""")
def _(t):
    batch = {
        "entity_snapshots": _snapshot_batch(t),
        "rule_checks": story(t, "rule_check").withColumns({"chapter_index": F.col("valid_from_chapter"), "source_fragment": F.concat("subject_ability", F.lit("!")), "subject_entity_name": F.lit("")}),
    }
    names = {k: story(t, "entity").select("book_id", F.col("entity_name").alias("name")) for k in ("entity", "event")}
    chapters = story(t, "entity_snapshot").select("book_id", "chapter_index", F.lit("a calm text").alias("chapter_text")).distinct()
    before = story(t, "entity_snapshot").limit(0)
    _, found = ck.validated(batch, names, before, chapters)
    return found.groupBy("record_type", "issue_type").agg(F.count("*").alias("n"))


@query("target_ids", f"SELECT issue_id, CASE WHEN record_type = 'rule_check' THEN 'rul_' || replace(issue_id, 'vis_', '') WHEN record_type = 'timeline_event' THEN 'ev_' || replace(issue_id, 'vis_', '') END AS target FROM {sql('validation_issue')}")
def _(t):
    i = story(t, "validation_issue").withColumn("n", F.replace("issue_id", F.lit("vis_"), F.lit("")))
    one = F.format_string('{"rule_id": "rul_%s", "event_id": "ev_%s"}', "n", "n")
    record = F.when(F.substring("n", -1, 1) > "4", F.concat(F.lit('[{"x": 1}, '), one, F.lit("]"))).otherwise(one)
    return i.select("issue_id", ck.target_id(F.col("record_type"), record).alias("target"))


# Reviews --------------------------------------------------------------------------------------------------------------

_KINDS = ("entity", "entity_relation", "timeline_event", "story_conflict", "foreshadowing", "rule_check")


def _reviewed(t):
    null = {"confidence": F.lit(None).cast("double"), "review_status": F.lit(None).cast("string")}
    tables = {k: story(t, k) for k in _KINDS}
    return {k: df if "confidence" in df.columns else df.withColumns(null) for k, df in tables.items()}


_CONF = "con AS (" + " UNION ALL ".join(f"SELECT '{k}' AS record_type, {rv.REVIEWED[k]} AS target_id, book_id, {'confidence' if k in ('entity', 'timeline_event', 'entity_relation') else 'NULL::DOUBLE'} AS confidence FROM {sql(k)}" for k in _KINDS) + ")"


@query("pending_issues", f"WITH {_CONF} SELECT i.issue_id, c.chapter_title, con.confidence FROM {sql('validation_issue')} i LEFT JOIN {sql('novel_chapter')} c USING (chapter_id) LEFT JOIN con ON con.record_type = i.record_type AND con.target_id = i.target_id AND con.book_id = i.book_id WHERE i.status = 'pending'")
def _(t):
    return rv.pending(story(t, "validation_issue"), _reviewed(t), story(t, "novel_chapter")).select("issue_id", "chapter_title", "confidence")


@query("pending_summary", f"SELECT book_id, issue_type, severity, count(*) AS n FROM {sql('validation_issue')} WHERE status = 'pending' GROUP BY ALL")
def _(t):
    return rv.summary(story(t, "validation_issue"))


_DECIDED = f"d AS (SELECT *, CASE WHEN o % 5 = 4 THEN NULL ELSE CASE o % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'fixed' ELSE 'ignored' END END AS decision FROM (SELECT *, CAST(replace(issue_id, 'vis_', '') AS BIGINT) AS o FROM {sql('validation_issue')})), r AS (SELECT *, coalesce((status = 'pending' AND decision IS NOT NULL) OR (status = 'confirmed' AND decision IN ('fixed', 'ignored')), false) AS changed FROM d)"


def _decisions(t):
    o = F.replace("issue_id", F.lit("vis_"), F.lit("")).cast("long")
    d = story(t, "validation_issue").withColumn("o", o).filter("o % 5 <> 4")
    kind = F.when(F.col("o") % 3 == 0, "confirmed").when(F.col("o") % 3 == 1, "fixed").otherwise("ignored")
    return d.select("issue_id", kind.alias("decision"), F.lit("me").alias("resolved_by"), F.lit("{}").alias("corrected"))


@query("review_decisions", f"WITH {_DECIDED} SELECT issue_id, CASE WHEN changed THEN decision ELSE status END AS status, CASE WHEN changed AND decision = 'fixed' THEN '{{}}' ELSE suggested_value END AS suggested_value, changed FROM r")
def _(t):
    return rv.decided(story(t, "validation_issue"), _decisions(t)).select("issue_id", "status", "suggested_value", "changed")


@query("review_write_back", f"WITH {_DECIDED}, k AS (SELECT target_id, book_id, max(decision) AS dec FROM r WHERE changed AND record_type = 'timeline_event' GROUP BY ALL) SELECT e.event_id, coalesce(k.dec, e.review_status) AS review_status, CASE WHEN k.dec IS NOT NULL THEN 1.0 ELSE e.confidence END AS confidence FROM {sql('timeline_event')} e LEFT JOIN k ON k.target_id = e.event_id AND k.book_id = e.book_id")
def _(t):
    changed = rv.decided(story(t, "validation_issue"), _decisions(t))
    return rv.written_back("timeline_event", story(t, "timeline_event"), changed).select("event_id", "review_status", "confidence")


@query("repersist_rejects", f"SELECT issue_id, CASE WHEN status NOT IN ('pending', 'confirmed') THEN 'not open' WHEN record_type <> 'rule_check' THEN 'unknown type' WHEN suggested_value = 'not json' THEN 'not read' ELSE 'again' END AS outcome FROM {sql('validation_issue')}")
def _(t):
    again, refused = rv.correctable(story(t, "validation_issue"), {"rule_check": "rule_name string, rule_content string"})
    return refused.select("issue_id", F.col("reason").alias("outcome")).unionByName(again["rule_check"].select("issue_id", F.lit("again").alias("outcome")))


_FIRST = "SELECT i.issue_id, i.description AS term, instr(c.chapter_text, i.description) - 1 AS pos, length(c.chapter_text) AS n, c.chapter_text AS txt"


@query("issue_evidence", f"WITH i AS (SELECT issue_id, book_id, chapter_id, (['the', 'der', 'quantity', 'of', 'xyzzy'])[CAST(replace(issue_id, 'vis_', '') AS BIGINT) % 5 + 1] AS description FROM {sql('validation_issue')}), h AS ({_FIRST} FROM i JOIN {sql('novel_chapter')} c ON c.chapter_id = i.chapter_id AND c.book_id = i.book_id WHERE contains(c.chapter_text, i.description)) SELECT issue_id, term, greatest(pos - 200, 0) AS start, least(pos + 200, n) AS stop FROM h")
def _(t):
    words = F.array(*map(F.lit, ("the", "der", "quantity", "of", "xyzzy")))
    o = F.replace("issue_id", F.lit("vis_"), F.lit("")).cast("long")
    issues = story(t, "validation_issue").withColumns({"description": F.element_at(words, (o % 5 + 1).cast("int")), "suggested_value": F.lit('{"a": ["?"], "b": 3}'), "original_value": F.lit(None).cast("string")})
    return rv.evidence(issues, story(t, "novel_chapter")).select("issue_id", "term", F.col("window.start").alias("start"), F.col("window.end").alias("stop"))


@query("rerun_guard", f"WITH j AS (SELECT book_id, count(*) FILTER (status = 'running') AS r FROM {sql('deconstruct_job')} GROUP BY ALL), c AS (SELECT book_id, count(*) AS n FROM {sql('chapter_state')} GROUP BY ALL) SELECT coalesce(j.book_id, c.book_id) AS book_id, CASE WHEN coalesce(n, 0) = 0 THEN 'no chapters' WHEN coalesce(r, 0) > 0 THEN 'running' END AS refused FROM j FULL JOIN c ON j.book_id = c.book_id")
def _(t):
    return rv.restarted(story(t, "chapter_state"), story(t, "deconstruct_job"))[1]


@query("rerun_reset", f"WITH ok AS (SELECT s.book_id FROM {sql('chapter_state')} s GROUP BY 1 HAVING NOT EXISTS (SELECT 1 FROM {sql('deconstruct_job')} j WHERE j.book_id = s.book_id AND j.status = 'running')) SELECT chapter_id, CASE WHEN book_id IN (SELECT book_id FROM ok) THEN 'pending' ELSE status END AS status, CASE WHEN book_id IN (SELECT book_id FROM ok) THEN 0 ELSE retry_count END AS retry_count FROM {sql('chapter_state')}")
def _(t):
    return rv.restarted(story(t, "chapter_state"), story(t, "deconstruct_job"))[0].select("chapter_id", "status", "retry_count")


@query("retry_guard", f"WITH r AS (SELECT DISTINCT book_id FROM {sql('deconstruct_job')} WHERE status = 'running'), s AS (SELECT *, status = 'failed' AND book_id NOT IN (SELECT book_id FROM r) AS take FROM {sql('chapter_state')}) SELECT chapter_id, CASE WHEN take THEN 'pending' ELSE status END AS status, retry_count + take::INT AS retry_count, CASE WHEN take THEN 0 ELSE shrink_level END AS shrink_level FROM s")
def _(t):
    busy = story(t, "deconstruct_job").filter("status = 'running'")
    return rv.retried(story(t, "chapter_state"), busy)[0].select("chapter_id", "status", "retry_count", "shrink_level")


@query("group_status", f"SELECT id, CASE WHEN status = 'processing' AND size > 500 THEN 'failed' ELSE status END AS status FROM {sql('documents')}")
def _(t):
    d = story(t, "documents")
    return rv.group_status(d, d.filter("size > 500"), "failed").select("id", "status")


@query("upload_states", f"WITH n AS (SELECT user_id, file_name, count(*) AS n FROM {sql('chunk')} GROUP BY ALL) SELECT d.id, CASE WHEN d.status = 'processing' THEN 'ready' ELSE d.status END AS status, CASE WHEN d.status = 'processing' THEN n.n END AS chunk_count FROM {sql('documents')} d LEFT JOIN n USING (user_id, file_name) WHERE NOT (d.status = 'processing' AND n.n IS NULL)")
def _(t):
    return rv.uploaded(story(t, "documents"), story(t, "chunk"))[0].select("id", "status", "chunk_count")


@query("upload_rejects", f"SELECT id, CASE WHEN file_name LIKE '%.exe' THEN 'extension' WHEN coalesce(size, 0) = 0 THEN 'empty' END AS refused FROM {sql('documents')}")
def _(t):
    return story(t, "documents").select("id", rv.upload_refusal(F.col("file_name"), F.col("size")).alias("refused"))


# Cards ----------------------------------------------------------------------------------------------------------------


def _tables(t):
    names = ("entity", "entity_alias", "timeline_event", "timeline_event_entity", "entity_snapshot", "entity_relation", "foreshadowing", "story_conflict", "rule_check")
    out = {k: story(t, k) for k in names}
    out["foreshadowing"] = out["foreshadowing"].withColumn("involved_entity_ids", F.array("involved"))
    out["novel_chapter"] = story(t, "novel_chapter").select("book_id", "chapter_index", "chapter_title", F.concat(F.lit("And then Customer#00000000"), F.col("chapter_index").cast("string"), F.lit(" came.")).alias("chapter_text"))
    return out


_CARD = f"""WITH e AS {sql('entity')}, s AS (SELECT * FROM {sql('entity_snapshot')} WHERE chapter_index <= 20), r AS (SELECT * FROM {sql('entity_relation')} WHERE start_chapter <= 20 AND (end_chapter = 0 OR end_chapter >= 20)),
al AS (SELECT entity_id, count(DISTINCT alias_name) AS n FROM {sql('entity_alias')} GROUP BY ALL), st AS (SELECT entity_id, max_by(status_desc, chapter_index) AS status, count(*) AS n FROM s GROUP BY ALL),
rl AS (SELECT entity_id, count(*) AS n, count(*) FILTER (inner_relation <> '') AS deep FROM (SELECT source_entity_id AS entity_id, inner_relation FROM r UNION ALL SELECT target_entity_id, inner_relation FROM r WHERE source_entity_id <> target_entity_id) GROUP BY ALL),
ev AS (SELECT entity_id, count(DISTINCT event_id) AS n FROM {sql('timeline_event_entity')} GROUP BY ALL), fs AS (SELECT e.entity_id, count(*) AS n, count(*) FILTER (f.status = 'pending') AS secret FROM {sql('foreshadowing')} f JOIN e ON e.book_id = f.book_id AND e.entity_name = f.involved GROUP BY ALL),
cf AS (SELECT e.entity_id, count(*) AS n FROM {sql('story_conflict')} c JOIN e ON e.book_id = c.book_id AND (contains(side_a, e.entity_name) OR contains(side_b, e.entity_name)) GROUP BY ALL), ru AS (SELECT subject_entity_id AS entity_id, count(*) AS n FROM {sql('rule_check')} GROUP BY ALL)
SELECT e.entity_id, entity_name AS name, coalesce(al.n, 0) AS aliases, st.status, coalesce(st.n, 0) AS snapshots, coalesce(rl.n, 0) AS relations, coalesce(deep, 0) AS inferred, coalesce(ev.n, 0) AS events, coalesce(secret, 0) AS secrets, coalesce(cf.n, 0) AS conflicts, coalesce(ru.n, 0) AS rules, CASE WHEN core_baseline IS NULL THEN '' ELSE 'calm' END AS personality
FROM e LEFT JOIN al USING (entity_id) LEFT JOIN st USING (entity_id) LEFT JOIN rl USING (entity_id) LEFT JOIN ev USING (entity_id) LEFT JOIN fs USING (entity_id) LEFT JOIN cf USING (entity_id) LEFT JOIN ru USING (entity_id)"""


@query("entity_card_layers", _CARD)
def _(t):
    c = cd.cards(_tables(t), 20)
    n = lambda x, name: F.size(x).cast("long").alias(name)
    return c.select("entity_id", "name", n("aliases", "aliases"), "status", n("L3_arc.snapshots", "snapshots"), n("relations", "relations"), n(F.filter("relations", lambda x: x["three_state"] == "inference"), "inferred"), n("events", "events"),
                    n("L4_narrative.unresolved_secrets", "secrets"), n("L4_narrative.conflicts", "conflicts"), n("L4_narrative.rules", "rules"), F.col("L1_baseline.personality").alias("personality"))


@query("entity_rules", f"SELECT rule_id, row_number() OVER (PARTITION BY subject_entity_id ORDER BY valid_from_chapter, rule_id) AS nth FROM {sql('rule_check')}")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("subject_entity_id").orderBy("valid_from_chapter", "rule_id")
    return story(t, "rule_check").select("rule_id", F.row_number().over(w).cast("long").alias("nth"))


@query("snapshot_evolution", f"SELECT entity_id, chapter_index, status_desc, json_extract_string(attributes, '$.mood') AS mood FROM {sql('entity_snapshot')} WHERE chapter_index BETWEEN 5 AND 15")
def _(t):
    s = story(t, "entity_snapshot").filter(F.col("chapter_index").between(5, 15))
    return s.select("entity_id", "chapter_index", "status_desc", F.from_json("attributes", "mood string")["mood"].alias("mood"))


@query("default_chapter", f"SELECT book_id, coalesce(max(chapter_index), 0) AS n FROM {sql('novel_chapter')} GROUP BY ALL")
def _(t):
    return cd.default_chapter(story(t, "novel_chapter"))


@query("attribute_summary", "SELECT s_suppkey, 'name: ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' · x: 1' END AS summary FROM supplier")
def _(t):
    json = F.format_string('{"name": "%s", "x": %s, "y": "", "z": null}', "s_name", F.when(F.col("s_suppkey") % 2 == 0, "null").otherwise("1"))
    return t("supplier").select("s_suppkey", cd.attribute_summary(json).alias("summary"))


@query("timeline_blocks", f"SELECT event_id, start_chapter / 40.0 * 100 AS lft, CASE WHEN end_chapter < start_chapter THEN 0 ELSE end_chapter - start_chapter END / 40.0 * 100 AS wid, CASE WHEN end_chapter <= start_chapter THEN '第 ' || start_chapter || ' 章' WHEN start_chapter = 0 THEN '第 ' || end_chapter || ' 章起' ELSE '第 ' || start_chapter || '~' || end_chapter || ' 章' END AS label FROM {sql('timeline_event')}")
def _(t):
    b = cd.block(F.col("start_chapter"), F.col("end_chapter"), F.lit(40))
    e = story(t, "timeline_event").withColumn("b", b)
    return e.select("event_id", F.col("b.left").alias("lft"), F.col("b.width").alias("wid"), cd.chapter_label(F.col("start_chapter"), F.col("end_chapter")).alias("label"))


@query("three_states", f"SELECT event_id, CASE WHEN review_status IS NULL THEN '待复核' ELSE '原文直证' END AS shown FROM {sql('timeline_event')}")
def _(t):
    state = F.when(F.col("review_status").isNull(), "review").otherwise("fact")
    return story(t, "timeline_event").select("event_id", cd.three_state(state).alias("shown"))


@query("book_query", f"SELECT relation_id FROM {sql('entity_relation')} WHERE book_id = 'book_2' AND 'ent_7' IN (source_entity_id, target_entity_id) AND start_chapter BETWEEN 2 AND 18")
def _(t):
    return cd.book_query(_tables(t), "book_2", "Customer#000000007", start=2, end=18)["relations"].select("relation_id")


# Models ---------------------------------------------------------------------------------------------------------------


def _scenes(t):
    return t("documents").select(F.lit("b").alias("book_id"), F.col("doc_id").alias("chapter_index"), F.lit(0).cast("long").alias("scene"), "text", F.lit(0).alias("level"), F.array().cast("array<string>").alias("names"))


def words(text: str, level: int, names) -> list[dict]:
    """An extractor to try jobs with: each word is a record; a text without one fails."""
    if not text.split(" ")[0]:
        raise ValueError("no word")
    return [{"name": w} for w in text.split(" ")]


@query("extract_with_errors", "SELECT doc_id AS chapter_index, CASE WHEN coalesce(split_part(text, ' ', 1), '') = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS records, (coalesce(split_part(text, ' ', 1), '') = '')::INT AS errors FROM documents")
def _(t):
    kinds = ag.Extractors()
    kinds.register("entity", words)
    good, bad = ag.extracted(_scenes(t), "entity", kinds)
    every = t("documents").select(F.col("doc_id").alias("chapter_index"))
    n, e = good.groupBy("chapter_index").agg(F.count("*").alias("records")), bad.groupBy("chapter_index").agg(F.count("*").cast("int").alias("errors"))
    return every.join(n, "chapter_index", "left").join(e, "chapter_index", "left").fillna(0)


class CountsRelations:
    """A model to try jobs with: finds fault with every other relation of a batch."""

    def answer(self, prompt: str) -> str:
        import json

        found = json.loads(prompt).get("relations", [])
        return "Here: " + json.dumps({"items": [{"record_type": "entity_relation", "target": r["relation_id"], "conflict_desc": "odd", "severity": "info"} for r in found[::2]]})


@query("model_findings", f"SELECT book_id, CAST(ceil(least(50, count(*)) / 2.0) AS BIGINT) AS n FROM {sql('entity_relation')} GROUP BY ALL")
def _(t):
    batches = ag.review_batches(story(t, "entity_relation"), story(t, "entity_snapshot"), story(t, "timeline_event"))
    return ag.model_findings(batches, CountsRelations()).groupBy("book_id").agg(F.count("*").alias("n"))


@query("intent_of_answer", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '投诉' ELSE '其他' END AS intent FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, '```json\n{"intent": "投诉"}\n``` ok').when(k == 1, 'so {"intent": "x"} it is').otherwise("no idea {")
    return t("documents").select("doc_id", ag.intent_of(answer, [n for n, _ in tx.INTENTS], tx.DEFAULT_INTENT).alias("intent"))


class Echo:
    def answer(self, prompt: str) -> str:
        return f'Sure: ["{len(prompt)}", " more ", "", "why?", "five"]'


@query("suggestion_answers", "SELECT conv_id, turn, CAST(least(length(text), 200) + least(length(text), 500) + 1 AS VARCHAR) || '|more|why?' AS said FROM conversations")
def _(t):
    prompt = ag.suggestion_prompt(F.col("text"), F.col("text"))
    return t("conversations").withColumn("said", F.array_join(ag.suggestions_of(prompt, Echo()), "|")).select("conv_id", "turn", "said")


@query("collection_keys", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN source ELSE 'src1' END AS collection FROM documents")
def _(t):
    return t("documents").select("doc_id", ag.collection_of(F.col("source"), ["src1", "src2"]).alias("collection"))


@query("embed_batches", "SELECT doc_id, coalesce(trim(text), '') = '' AS blank FROM documents")
def _(t):
    e = ag.embedded(t("documents"), HashedGrams(8), key="doc_id", query="for: ")
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return e.select("doc_id", (size < 0.5).alias("blank"))


class Backwards:
    def scores(self, question: str, texts: list[str]) -> list[float]:
        if question == "0":
            raise RuntimeError("down")
        return [-float(x) for x in texts][: None if question != "1" else 1]


@query("rerank_scores", "WITH h AS (SELECT label % 4 AS query_id, vec_id, vec_id / 1000.0 AS score FROM embeddings WHERE label IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id < 2 THEN score ELSE -vec_id END DESC, vec_id) AS rank FROM h) SELECT query_id, vec_id, rank FROM r WHERE rank <= 5")
def _(t):
    h = t("embeddings").filter("label is not null").select((F.col("label") % 4).cast("long").alias("query_id"), "vec_id", (F.col("vec_id") / 1000.0).alias("score"))
    h = h.withColumns({"question": F.col("query_id").cast("string"), "text": F.col("vec_id").cast("string")})
    return ag.rescored(h, Backwards(), 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))

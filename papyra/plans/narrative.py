"""Temporal state, upserts, lifecycles, review and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import graph as g
from papyra.operators import relational as r
from papyra.operators import review as rv
from papyra.operators import temporal as tm
from papyra.operators import upsert as up
from papyra.plans.analogues import EDGES, SNAPSHOTS, edges, observations, snapshots
from papyra.plans.registry import query
from papyra.plans.story_tables import sql as story_sql
from papyra.plans.story_tables import story
from papyra.session import shared_folder

count = lambda: F.count("*").cast("long")
#: Intervals: an edge of some kind runs from its first to its last chapter; those of the last chapter are open.
INTERVALS = f"""{EDGES}, iv AS (
  SELECT source, target, kind, min(chapter) AS start_chapter, CASE WHEN max(chapter) >= 23980 THEN 0 ELSE max(chapter) END::BIGINT AS end_chapter
  FROM edge GROUP BY source, target, kind)"""


def intervals(t):
    e = observations(t).groupBy("source", "target", "kind").agg(F.min("chapter").alias("start_chapter"), F.max("chapter").alias("last"))
    return e.select("source", "target", "kind", "start_chapter", F.when(F.col("last") >= 23980, F.lit(0)).otherwise(F.col("last")).cast("long").alias("end_chapter"))


@query("asof_latest", f"WITH {SNAPSHOTS} SELECT entity, max(chapter) AS chapter, max_by(status, chapter) AS status FROM snap WHERE chapter <= 12 GROUP BY entity")
def _(t):
    return tm.as_of(snapshots(t), ["entity"], "chapter", 12, ["status"])


@query("latest_before_n", f"WITH {SNAPSHOTS} SELECT entity, chapter, status FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY chapter DESC) AS r FROM snap WHERE chapter < 12) WHERE r = 1")
def _(t):
    return r.first_per_key(snapshots(t).filter("chapter < 12"), ["entity"], [F.desc("chapter")]).select("entity", "chapter", "status")


@query("asof_per_row", f"WITH {SNAPSHOTS} SELECT e.event_id, s.status AS asof_status FROM (SELECT event_id, user_id AS entity, date_diff('day', DATE '2024-01-01', ts::DATE) AS chapter FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN snap s ON e.entity = s.entity AND e.chapter > s.chapter")
def _(t):
    left = t("events").filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("chapter"))
    return tm.as_of_rows(left, snapshots(t).select("entity", "chapter", "status"), "entity", "chapter", "status", strict=True).select("event_id", "asof_status")


@query("interval_valid_at", f"WITH {INTERVALS} SELECT source, target, kind, start_chapter, end_chapter FROM iv WHERE start_chapter <= 23985 AND (end_chapter IS NULL OR end_chapter = 0 OR end_chapter >= 23985)")
def _(t):
    return intervals(t).filter(tm.valid_at(23985))


@query("event_support_anti", f"WITH {SNAPSHOTS}, f AS (SELECT entity, chapter, status FROM (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY chapter) AS before FROM snap) WHERE before <> status) SELECT f.entity, f.chapter FROM f WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.entity AND date_diff('day', DATE '2024-01-01', e.ts::DATE) = f.chapter AND (e.event_type = 'purchase' OR contains(e.props, '7')))")
def _(t):
    changed = tm.flips(snapshots(t), ["entity"], ["chapter"], "status").select("entity", "chapter")
    support = t("events").filter((F.col("event_type") == "purchase") | F.contains(F.col("props"), F.lit("7")))
    support = support.select(F.col("user_id").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("chapter"))
    return changed.join(support, ["entity", "chapter"], "left_anti")


@query("global_sort_key", "SELECT l_orderkey, l_linenumber, (l_orderkey::BIGINT * 100000 + l_linenumber * 1000 + l_quantity::BIGINT) AS sort_key FROM lineitem")
def _(t):
    key = F.col("l_orderkey").cast("long") * 100_000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long")
    return t("lineitem").select("l_orderkey", "l_linenumber", key.alias("sort_key"))


@query("upsert_keep_columns", "SELECT coalesce(a.c_custkey, b.k) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN b.name ELSE a.c_name END AS c_name, CASE WHEN b.k IS NULL THEN a.c_acctbal ELSE b.bal END AS c_acctbal FROM customer a FULL JOIN (SELECT s_suppkey + 50 AS k, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_suppkey <= 5) b ON a.c_custkey = b.k")
def _(t):
    s = t("supplier")
    row = lambda k: s.select(k.cast("long").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    source = row(F.col("s_suppkey") + 50).unionByName(row(F.col("s_suppkey") + 1_000_000).filter("c_custkey <= 1000005"))
    return up.upsert(t("customer").select("c_custkey", "c_name", "c_acctbal"), source, ["c_custkey"], ["c_acctbal"])


LIFECYCLE = f"""WITH {EDGES}, o AS (SELECT DISTINCT source, target, kind, chapter FROM edge),
c AS (SELECT source, target, chapter, row_number() OVER w AS nth, lead(chapter) OVER w AS nxt FROM (SELECT DISTINCT source, target, chapter FROM o) WINDOW w AS (PARTITION BY source, target ORDER BY chapter)),
k AS (SELECT o.*, c.nth, c.nxt, c.nth - row_number() OVER (PARTITION BY o.source, o.target, o.kind ORDER BY c.nth) AS run FROM o JOIN c USING (source, target, chapter))
SELECT source, target, kind, min(chapter) AS start_chapter, coalesce(max_by(nxt, nth) - 1, 0)::BIGINT AS end_chapter, count(*) AS observations
FROM k GROUP BY source, target, kind, run"""


# DuckDB's max_by passes over null values, so the open end is asked for by itself.
LIFECYCLE = LIFECYCLE.replace("coalesce(max_by(nxt, nth) - 1, 0)", "CASE WHEN bool_or(nxt IS NULL) THEN 0 ELSE max(nxt) - 1 END")


@query("relation_lifecycle", LIFECYCLE)
def _(t):
    return tm.relation_intervals(observations(t), ["source", "target"], "kind", "chapter", rows=t("lineitem").count())


@query("relation_merge_step", f"WITH {INTERVALS}, ob AS (SELECT source, target, kind FROM edge WHERE chapter = 23982 GROUP BY ALL), p AS (SELECT DISTINCT source, target FROM ob) SELECT i.source, i.target, i.kind, i.start_chapter, CASE WHEN i.end_chapter = 0 AND p.source IS NOT NULL AND ob.kind IS NULL THEN 23981 ELSE i.end_chapter END::BIGINT AS end_chapter FROM iv i LEFT JOIN p USING (source, target) LEFT JOIN ob ON i.source = ob.source AND i.target = ob.target AND i.kind = ob.kind UNION ALL SELECT ob.source, ob.target, ob.kind, 23982, 0 FROM ob LEFT JOIN iv ON ob.source = iv.source AND ob.target = iv.target AND ob.kind = iv.kind AND iv.end_chapter = 0 WHERE iv.source IS NULL")
def _(t):
    stored = intervals(t)
    seen = edges(t).filter("chapter = 23982").select("source", "target", "kind")
    out = tm.merge_relations(stored, seen, 23982, ["source", "target"], "kind", [])
    return out.select("source", "target", "kind", F.col("start_chapter").cast("long").alias("start_chapter"), F.col("end_chapter").cast("long").alias("end_chapter"))


@query("conflict_lifecycle", "SELECT o_custkey AS conflict, min(year(o_orderdate)) AS start_chapter, CASE WHEN max_by(o_orderstatus, (o_orderdate, o_orderkey)) = 'F' THEN max(year(o_orderdate)) ELSE 0 END::BIGINT AS end_chapter FROM orders GROUP BY o_custkey")
def _(t):
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    o = t("orders").groupBy(F.col("o_custkey").alias("conflict")).agg(F.min(F.year("o_orderdate")).cast("long").alias("start_chapter"), F.max(F.year("o_orderdate")).alias("y"), last.alias("status"))
    return o.select("conflict", "start_chapter", F.when(F.col("status") == "F", F.col("y")).otherwise(F.lit(0)).cast("long").alias("end_chapter"))


@query("rule_lifecycle", "SELECT p_brand AS rule, min_by(p_partkey, p_partkey) AS valid_from, max_by(p_type, p_partkey) AS content FROM part GROUP BY p_brand")
def _(t):
    return t("part").groupBy(F.col("p_brand").alias("rule")).agg(F.min("p_partkey").alias("valid_from"), F.max_by("p_type", "p_partkey").alias("content"))


@query("duplicate_consolidation", f"WITH {EDGES} SELECT source, target, kind, min(chapter) AS start_chapter, max_by(weight, chapter) AS weight FROM edge GROUP BY source, target, kind HAVING count(*) > 1")
def _(t):
    e = edges(t).groupBy("source", "target", "kind").agg(F.min("chapter").alias("start_chapter"), F.max_by("weight", "chapter").alias("weight"), count().alias("n"))
    return e.filter("n > 1").drop("n")


@query("review_transition", "SELECT doc_id, status, CASE WHEN status IN ('pending', 'confirmed') THEN 'fixed' ELSE status END AS new_status, status IN ('pending', 'confirmed') AS changed FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'fixed' ELSE 'ignored' END AS status FROM labels)")
def _(t):
    states = F.array(*map(F.lit, ("pending", "confirmed", "fixed", "ignored")))
    issues = t("labels").select("doc_id", F.element_at(states, (F.col("doc_id") % 4 + 1).cast("int")).alias("status"))
    new, changed = up.transition(F.col("status"), "fixed", up.REVIEW)
    return issues.select("doc_id", "status", new.alias("new_status"), changed.alias("changed"))


@query("lease_reaper", "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1800 SECOND THEN 'pending' WHEN event_type = 'view' THEN 'processing' ELSE 'done' END AS status FROM events")
def _(t):
    states = t("events").select("event_id", F.when(F.col("event_type") == "view", "processing").otherwise("done").alias("status"), F.col("ts").alias("started_at"))
    return up.reap(states, F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")), 1800).select("event_id", "status")


@query("retry_reset", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE o_orderstatus END AS status, (o_orderstatus = 'F')::INT AS retry_count FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 7, 11)")
def _(t):
    failed = F.col("o_orderstatus") == "F"
    return t("orders").filter(F.col("o_orderkey").isin(1, 2, 3, 5, 7, 11)).select("o_orderkey", F.when(failed, "pending").otherwise(F.col("o_orderstatus")).alias("status"), failed.cast("int").alias("retry_count"))


@query("job_finalise", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'running' WHEN count(*) = count(*) FILTER (o_orderstatus = 'F') THEN 'done' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'failed' ELSE 'done' END AS job FROM orders GROUP BY o_custkey")
def _(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s)
    j = t("orders").groupBy("o_custkey").agg(count().alias("total"), n("F"), n("O"), n("P"))
    return j.select("o_custkey", up.job_status(F.col("total"), F.col("F"), F.col("O"), F.lit(0), F.col("P")).alias("job"))


@query("resume_summary", "SELECT event_type AS status, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM events GROUP BY event_type")
def _(t):
    n = t("events").groupBy(F.col("event_type").alias("status")).agg(count().alias("n"))
    return n.join(F.broadcast(t("events").agg(count().alias("total"))))


@query("session_get_or_create", "SELECT DISTINCT conv_id, 'user_1_' || conv_id AS session_key, conv_id % 2 = 0 AS existed FROM conversations")
def _(t):
    c = t("conversations").select("conv_id").distinct()
    known = c.filter("conv_id % 2 = 0")
    new = up.new_keys(c, known, ["conv_id"])
    both = known.withColumn("existed", F.lit(True)).unionByName(new.withColumn("existed", F.lit(False)))
    return both.select("conv_id", F.concat_ws("_", F.lit("user"), F.lit("1"), F.col("conv_id").cast("string")).alias("session_key"), "existed")


@query("double_delete", "SELECT doc_id FROM documents WHERE NOT (source = 'src3' AND lang = 'en')")
def _(t):
    return up.delete_where(t("documents").select("doc_id", "source", "lang"), (F.col("source") == "src3") & (F.col("lang") == "en"))[0].select("doc_id")


@query("fk_check_split", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown customer' WHEN o_totalprice <= 0 THEN 'no price' ELSE 'ok' END AS finding FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) c ON o_custkey = c_custkey")
def _(t):
    known = t("customer").filter("c_custkey % 7 <> 0").select("c_custkey")
    o = t("orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", F.when(F.col("c_custkey").isNull(), "unknown customer").when(F.col("o_totalprice") <= 0, "no price").otherwise("ok").alias("finding"))


@query("anchor_check", "SELECT doc_id, frag = '' OR contains(text, frag) AS anchored FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN substr(text, 3, 12) ELSE upper(substr(text, 3, 12)) || '~' END AS frag FROM documents)")
def _(t):
    part = F.substring("text", 3, 12)
    d = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 2 == 0, part).otherwise(F.concat(F.upper(part), F.lit("~"))).alias("frag"))
    return d.select("doc_id", ((F.col("frag") == "") | F.contains("text", "frag")).alias("anchored"))


def _hop_sql(n: int) -> str:
    """Edges in their order, as long as fewer than n nodes and n edges stand before."""
    return f"""WITH {INTERVALS}, o AS (SELECT source, target, kind, start_chapter, CASE WHEN source = 7 THEN target ELSE source END AS other, row_number() OVER (ORDER BY start_chapter, source, target, kind) AS r FROM iv
      WHERE (source = 7 OR target = 7) AND start_chapter <= 23990 AND (end_chapter = 0 OR end_chapter >= 23990)), f AS (SELECT *, (other <> 7 AND row_number() OVER (PARTITION BY other ORDER BY r) = 1)::INT AS fresh FROM o),
      s AS (SELECT *, 1 + coalesce(sum(fresh) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM f) SELECT source, target, kind, start_chapter FROM s WHERE r <= {n} AND seen < {n}"""


@query("graph_one_hop", _hop_sql(100))
def _(t):
    return g.one_hop(intervals(t), 7, 23990)[1].select("source", "target", "kind", "start_chapter")


@query("graph_one_hop_capped", _hop_sql(6))
def _(t):
    return g.one_hop(intervals(t), 7, 23990, 6)[1].select("source", "target", "kind", "start_chapter")


@query("layer_filter", f"WITH {EDGES}, n AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING') SELECT source, target, kind, chapter FROM edge WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)")
def _(t):
    nodes = t("customer").select(F.col("c_custkey").alias("node"), "c_mktsegment")
    return g.layer(nodes, edges(t).select("source", "target", "kind", "chapter"), F.col("c_mktsegment") == "BUILDING")[1].select("source", "target", "kind", "chapter")


@query("alias_components", "WITH RECURSIVE r AS (SELECT s_suppkey AS record, s_nationkey::VARCHAR AS name FROM supplier UNION ALL SELECT s_suppkey, 'b' || (s_suppkey // 7) FROM supplier), e AS (SELECT DISTINCT a.record AS a, b.record AS b FROM r a JOIN r b USING (name)), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS record, min(b) AS root FROM c GROUP BY a")
def _(t):
    s = t("supplier").select("s_suppkey", "s_nationkey")
    names = s.select(F.col("s_suppkey").alias("record"), F.col("s_nationkey").cast("string").alias("name"))
    names = names.unionByName(s.select(F.col("s_suppkey").alias("record"), F.concat(F.lit("b"), F.floor(F.col("s_suppkey") / 7).cast("string")).alias("name")))
    shared_folder(names.sparkSession)
    return g.alias_groups(names, lambda df: df.checkpoint())


@query("entity_card", f"WITH {SNAPSHOTS}, {INTERVALS}, st AS (SELECT entity, max(chapter) AS chapter, max_by(status, chapter) AS status FROM snap WHERE chapter <= 20 GROUP BY entity), rel AS (SELECT source, count(*) AS relations, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM iv WHERE start_chapter <= 23950 AND (end_chapter = 0 OR end_chapter >= 23950) GROUP BY source) SELECT c_custkey AS entity, c_name AS name, status, chapter::BIGINT AS chapter, coalesce(relations, 0) AS relations, coalesce(kinds, '') AS kinds, status IS NULL AS unknown FROM customer LEFT JOIN st ON c_custkey = st.entity LEFT JOIN rel ON c_custkey = rel.source")
def _(t):
    state = tm.as_of(snapshots(t), ["entity"], "chapter", 20, ["status"])
    rel = intervals(t).filter(tm.valid_at(23950)).groupBy(F.col("source").alias("entity")).agg(count().alias("relations"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    c = t("customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")).join(state, "entity", "left").join(rel, "entity", "left")
    return c.select("entity", "name", "status", "chapter", F.coalesce("relations", F.lit(0)).alias("relations"), F.coalesce("kinds", F.lit("")).alias("kinds"), F.col("status").isNull().alias("unknown"))


@query("location_tree", "WITH RECURSIVE x AS (SELECT r_regionkey AS id, r_name AS name, NULL::INT AS parent, 1 AS level FROM region UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, 2 FROM nation), p(id, path, level) AS (SELECT id, name, level FROM x WHERE parent IS NULL UNION ALL SELECT x.id, p.path || '/' || x.name, x.level FROM x JOIN p ON x.parent = p.id) SELECT id, path, level FROM p")
def _(t):
    top = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("path"), F.lit(1).alias("level"))
    below = t("nation").join(top.select(F.col("id").alias("n_regionkey"), F.col("path").alias("above")), "n_regionkey")
    return top.unionByName(below.select((F.col("n_nationkey") + 100).alias("id"), F.concat_ws("/", "above", "n_name").alias("path"), F.lit(2).alias("level")))


@query("feedback_overwrite", f"WITH m AS {story_sql('messages')}, q AS (SELECT id + CASE WHEN id % 13 = 0 THEN 500 ELSE 0 END AS id, CASE WHEN id % 7 = 0 THEN 99 ELSE user_id END AS user_id, CASE WHEN id % 11 = 0 THEN 'maybe' WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS feedback, repeat('x', CAST(id % 520 AS INT)) AS tx FROM m) SELECT q.id, CASE WHEN m.id IS NULL THEN 404 WHEN m.user_id <> q.user_id THEN 403 WHEN q.feedback = 'maybe' OR length(tx) > 500 THEN 400 ELSE 200 END AS code FROM q LEFT JOIN m ON m.id = q.id")
def _(t):
    m = story(t, "messages")
    k = F.col("id")
    asked = m.select(
        (k + F.when(k % 13 == 0, 500).otherwise(0)).alias("id"), F.when(k % 7 == 0, 99).otherwise(F.col("user_id")).alias("user_id"),
        F.when(k % 11 == 0, "maybe").when(k % 2 == 0, "up").otherwise("down").alias("feedback"), F.repeat(F.lit("x"), (k % 520).cast("int")).alias("feedback_text"),
    )
    return rv.with_feedback(m, asked)[1].select("id", "code")


@query("coalesced_channels", "SELECT user_id, min_by(event_type, event_id) FILTER (value > 40) AS first_set, count(*) AS n FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.min_by(F.when(F.col("value") > 40, F.col("event_type")), F.when(F.col("value") > 40, F.col("event_id"))).alias("first_set"), count().alias("n"))

"""Browsing, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import relational as r
from papyra.operators import temporal as tm
from papyra.plans.analogues import EDGES, SNAPSHOTS, edges, snapshots
from papyra.plans.registry import query
from papyra.plans.story_tables import sql, story

count = lambda: F.count("*").cast("long")


@query("projection", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 AND o_custkey IS NOT NULL")
def _(t):
    return t("orders").filter((F.col("o_orderkey") == 7) & F.col("o_custkey").isNotNull()).select("o_orderkey", "o_totalprice")


PART = {"name": ("like", ["p_name"]), "kw": ("like", ["p_brand", "p_type"]), "kind": ("eq", ["p_type"]), "least": ("ge", ["p_size"]), "most": ("le", ["p_size"])}


@query("browse_page", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def _(t):
    return r.browse(t("customer"), {}, {}, [F.desc("c_acctbal"), F.col("c_custkey")], offset=40)[1].select("c_custkey", "c_name", "c_acctbal")


@query("browse_total", "SELECT count(*) AS total FROM part WHERE p_size >= 10 AND p_size <= 20")
def _(t):
    return r.browse(t("part"), PART, {"least": 10, "most": 20}, [F.col("p_partkey")])[0]


@query("browse_like_kw", "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_brand LIKE '%1%' OR p_type LIKE '%1%' ORDER BY p_partkey LIMIT 100")
def _(t):
    return r.browse(t("part"), PART, {"kw": "1", "name": ""}, [F.col("p_partkey")], limit=500)[1].select("p_partkey", "p_name", "p_brand", "p_type")


@query("browse_wildcard", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' ORDER BY p_partkey LIMIT 20")
def _(t):
    return r.browse(t("part"), PART, {"name": "a_e"}, [F.col("p_partkey")], limit="x")[1].select("p_partkey")


@query("browse_range", "SELECT p_partkey, p_size FROM part WHERE p_size >= 5 AND p_size <= 9 ORDER BY p_partkey LIMIT 50")
def _(t):
    return r.browse(t("part"), PART, {"least": 5, "most": 9}, [F.col("p_partkey")], limit=50)[1].select("p_partkey", "p_size")


@query("optional_predicates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(t):
    return r.optional(t("orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(t):
    return t("orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("names_or_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%bolt%' OR p_name LIKE '%PROMO%' OR p_type LIKE '%bolt%' OR p_type LIKE '%PROMO%'")
def _(t):
    return t("part").filter(r.any_name(["bolt", "PROMO"], "p_name", "p_type")).select("p_partkey")


@query("default_for_falsy", "SELECT doc_id, CASE WHEN toxic IS NULL OR toxic = 0 THEN 9 ELSE toxic END AS level FROM labels")
def _(t):
    return t("labels").select("doc_id", r.or_default(F.col("toxic"), 9).alias("level"))


@query("history_roles", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'ai' END AS speaker FROM conversations WHERE role <> 'system'")
def _(t):
    return t("conversations").filter("role <> 'system'").select("conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("ai").alias("speaker"))


_USERS = """u AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '138' || lpad(c_custkey::VARCHAR, 8, '0') WHEN 1 THEN '12345' END AS phone, CASE c_custkey % 3 WHEN 0 THEN 'c' || c_custkey || '@example.org' WHEN 1 THEN 'c@' END AS email FROM customer)"""


@query("identity_check", f"WITH {_USERS}, o AS (SELECT * FROM u WHERE k % 5 = 0), c AS (SELECT k, CASE WHEN phone IS NULL AND email IS NULL THEN 'none' WHEN phone = '12345' THEN 'phone' WHEN email = 'c@' THEN 'email' END AS bad FROM u) SELECT k, coalesce(bad, CASE WHEN k % 5 = 0 THEN 'taken' END) AS refused FROM c")
def _(t):
    k = F.col("c_custkey")
    phone = F.when(k % 4 == 0, F.concat(F.lit("138"), F.lpad(k.cast("string"), 8, "0"))).when(k % 4 == 1, "12345")
    email = F.when(k % 3 == 0, F.format_string("c%d@example.org", k)).when(k % 3 == 1, "c@")
    u = t("customer").select(k.alias("k"), phone.alias("phone"), email.alias("email"))
    return r.registered(u, u.filter("k % 5 = 0")).select("k", "refused")


@query("empty_results", "SELECT event_id, event_id % 6 < 4 AS nothing FROM events")
def _(t):
    k = F.col("event_id") % 6
    found = F.when(k == 1, "").when(k == 2, " [] ").when(k == 3, "[]").when(k == 4, "[1]").when(k == 5, F.col("props"))
    return t("events").select("event_id", r.is_empty(found).alias("nothing"))


@query("inner_join_chapter_state", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def _(t):
    lines = t("lineitem").filter("l_quantity > 45")
    return lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("edge_names_double_left", "SELECT c_custkey, s_suppkey, a.n_name AS source_name, b.n_name AS target_name FROM customer JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey")
def _(t):
    a, b = (t("nation").select(F.col("n_nationkey").alias(f"{s}_key"), F.col("n_name").alias(f"{s}_name")) for s in ("source", "target"))
    pairs = t("customer").join(t("supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return pairs.join(a, F.col("c_nationkey") == F.col("source_key"), "left").join(b, F.col("s_nationkey") == F.col("target_key"), "left").select("c_custkey", "s_suppkey", "source_name", "target_name")


@query("or_of_in_semi", f"WITH {EDGES} SELECT source, target, kind, chapter FROM edge WHERE source IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR target IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(t):
    # One pass over the edges: each side's ids tell, by a left join, whether they are among those wanted.
    e = edges(t).select("source", "target", "kind", "chapter")
    c = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source"), F.lit(True).alias("by_source"))
    s = t("supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("target"), F.lit(True).alias("by_target"))
    return e.join(c, "source", "left").join(s, "target", "left").filter("by_source or by_target").select("source", "target", "kind", "chapter")


@query("bridge_collect_names", "SELECT o_orderkey, coalesce(string_agg(DISTINCT p_name, '|' ORDER BY p_name), '') AS names FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey")
def _(t):
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("names"))
    return t("orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("names", F.lit("")).alias("names"))


@query("polymorphic_lookup", "SELECT doc_id, l.kind, amount FROM (SELECT doc_id, ['customer', 'supplier', 'part'][(doc_id % 3 + 1)::INT] AS kind FROM labels) l LEFT JOIN (SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part) x ON x.kind = l.kind AND x.id = l.doc_id")
def _(t):
    issues = t("labels").select("doc_id", F.element_at(F.array(*map(F.lit, ("customer", "supplier", "part"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"))
    of = lambda name, key, value: t(name).select(F.lit(name).alias("kind"), F.col(key).alias("doc_id"), F.col(value).alias("amount"))
    every = of("customer", "c_custkey", "c_acctbal").unionByName(of("supplier", "s_suppkey", "s_acctbal")).unionByName(of("part", "p_partkey", "p_retailprice"))
    return issues.join(every, ["kind", "doc_id"], "left").select("doc_id", "kind", "amount")


@query("alias_resolve", f"WITH w AS (SELECT o_orderkey, 'book_' || CAST(o_custkey % 5 AS VARCHAR) AS book_id, CASE WHEN o_orderkey % 2 = 0 THEN 'the ' || o_custkey ELSE 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS alias_name FROM orders), a AS (SELECT book_id, alias_name, min(entity_id) AS entity_id FROM {sql('entity_alias')} GROUP BY ALL) SELECT o_orderkey, entity_id FROM w LEFT JOIN a USING (book_id, alias_name)")
def _(t):
    k = F.col("o_custkey")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("the %d", k)).otherwise(F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")))
    wanted = t("orders").select("o_orderkey", F.concat(F.lit("book_"), (k % 5).cast("string")).alias("book_id"), name.alias("alias_name"))
    known = story(t, "entity_alias").groupBy("book_id", "alias_name").agg(F.min("entity_id").alias("entity_id"))
    return wanted.join(known, ["book_id", "alias_name"], "left").select("o_orderkey", "entity_id")


@query("new_ids_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


TERMS = ("the", "und", "que", "les", "worthless")


@query("contains_theta_earliest", "WITH t(term, ord) AS (VALUES ('the', 0), ('und', 1), ('que', 2), ('les', 3), ('worthless', 4)), h AS (SELECT doc_id, strpos(text, term) - 1 AS position, term, row_number() OVER (PARTITION BY doc_id ORDER BY strpos(text, term), ord) AS r FROM documents, t WHERE contains(text, term)) SELECT doc_id, position::BIGINT AS position, term FROM h WHERE r = 1")
def _(t):
    d = t("documents").select("doc_id", r.earliest_term(F.col("text"), TERMS).alias("hit")).filter("hit is not null")
    return d.select("doc_id", F.col("hit.position").cast("long").alias("position"), F.col("hit.term").alias("term"))


@query("longest_term_first", "SELECT doc_id, CASE WHEN contains(text, 'worthless') THEN 'worthless' WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'und') THEN 'und' WHEN contains(text, 'que') THEN 'que' WHEN contains(text, 'les') THEN 'les' END AS term FROM documents")
def _(t):
    return t("documents").select("doc_id", r.longest_term(F.col("text"), TERMS).alias("term"))


@query("evidence_window", "SELECT doc_id, greatest(p - 200, 0)::BIGINT AS char_start, least(p + 200, length(text))::BIGINT AS char_end, substr(text, greatest(p - 200, 0) + 1, least(p + 200, length(text)) - greatest(p - 200, 0)) AS snippet FROM (SELECT doc_id, text, strpos(text, 'worthless') - 1 AS p FROM documents) WHERE p >= 0")
def _(t):
    d = t("documents").withColumn("p", F.instr("text", "worthless") - 1).filter("p >= 0")
    d = d.select("doc_id", r.window_around(F.col("text"), F.col("p")).alias("w"))
    return d.select("doc_id", F.col("w.start").alias("char_start"), F.col("w.end").alias("char_end"), F.col("w.text").alias("snippet"))


@query("exact_hash_dedup", "SELECT doc_id, md5(text) AS content_hash FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 2 = 0 AND s.source = d.source AND md5(s.text) = md5(d.text))")
def _(t):
    d = t("documents").select("doc_id", "source", F.md5("text").alias("content_hash"))
    stored = d.filter("doc_id % 2 = 0").select("source", "content_hash")
    return d.filter("doc_id % 2 = 1").join(stored, ["source", "content_hash"], "left_anti").select("doc_id", "content_hash")


@query("ordered_dedup_keep_first", "SELECT min(doc_id) AS doc_id, md5(text) AS content_hash FROM documents GROUP BY md5(text)")
def _(t):
    d = t("documents").select("doc_id", F.md5("text").alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")


@query("status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(count().alias("n"))


@query("issue_summary", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY GROUPING SETS ((quality, toxic), ())")
def _(t):
    by = t("labels").groupBy("quality", "toxic").agg(count().alias("n"))
    return by.unionByName(t("labels").agg(F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), count().alias("n")))


@query("conditional_counts", "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("large"))


@query("max_or_minus_one", "SELECT coalesce(max(doc_id), -1) AS last FROM labels WHERE quality = 7")
def _(t):
    return t("labels").filter("quality = 7").agg(F.coalesce(F.max("doc_id"), F.lit(-1)).cast("long").alias("last"))


@query("group_book_list", "SELECT source, count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS chars, max(doc_id) AS newest, min(doc_id) AS first_id, 'doc_1_' || min(doc_id) AS book_id FROM documents GROUP BY source")
def _(t):
    g = t("documents").groupBy("source").agg(count().alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.max("doc_id").alias("newest"), F.min("doc_id").alias("first_id"))
    return g.withColumn("book_id", F.concat_ws("_", F.lit("doc"), F.lit("1"), F.col("first_id").cast("string")))


@query("per_key_count_zero_fill", "SELECT d.doc_id, count(l.doc_id) AS n, CASE WHEN count(l.doc_id) > 0 THEN 'ready' ELSE 'removed' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def _(t):
    n = r.counts_with_zeros(t("documents"), t("labels"), "doc_id")
    return n.withColumn("status", F.when(F.col("n") > 0, "ready").otherwise("removed"))


@query("having_duplicates", f"WITH {EDGES} SELECT source, target, kind, count(*) AS n FROM edge GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return r.repeated(edges(t), ["source", "target", "kind"])


@query("range_min_max_backfill", f"WITH {SNAPSHOTS}, m AS (SELECT entity, min(chapter) AS first_chapter, max(chapter) AS last_chapter FROM snap GROUP BY entity) SELECT c_custkey, coalesce(first_chapter, 0)::BIGINT AS first_chapter, coalesce(last_chapter, 0)::BIGINT AS last_chapter FROM customer LEFT JOIN m ON c_custkey = entity")
def _(t):
    m = snapshots(t).groupBy("entity").agg(F.min("chapter").alias("a"), F.max("chapter").alias("b"))
    c = t("customer").join(m, F.col("c_custkey") == F.col("entity"), "left")
    return c.select("c_custkey", F.coalesce("a", F.lit(0)).cast("long").alias("first_chapter"), F.coalesce("b", F.lit(0)).cast("long").alias("last_chapter"))


@query("progress_pct", "SELECT o_custkey, count(*) AS total, CASE WHEN count(*) > 0 THEN least(round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100), 100) ELSE 0 END::BIGINT AS pct FROM orders GROUP BY o_custkey")
def _(t):
    return t("orders").groupBy("o_custkey").agg(count().alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).select("o_custkey", "total", r.percent(F.col("done"), F.col("total")).alias("pct"))


@query("quota_per_day", "SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type <> 'view') AS used, count(*) FILTER (event_type <> 'view') >= 3 AS over FROM events GROUP BY ALL")
def _(t):
    g = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") != "view").alias("used"))
    return g.withColumn("over", F.col("used") >= 3)


@query("names_by_type", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def _(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("rule_ladder_conflict", "SELECT p_brand, count(DISTINCT p_size) AS caps FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1 AND NOT bool_or(p_retailprice > 2090)")
def _(t):
    g = t("part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("caps"), F.bool_or(F.col("p_retailprice") > 2090).alias("locked"))
    return g.filter("caps > 1 and not locked").select("p_brand", "caps")


@query("reference_groups", "SELECT source, lang, count(DISTINCT doc_id) AS refs, string_agg(left(text, 20), '|' ORDER BY doc_id) FILTER (r <= 3) AS snippets FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) GROUP BY source, lang")
def _(t):
    rank = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    first = t("documents").withColumn("r", rank).filter("r <= 3").groupBy("source", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 20).alias("s")))), lambda x: x["s"]), "|").alias("snippets"))
    n = t("documents").groupBy("source", "lang").agg(F.count_distinct("doc_id").alias("refs"))
    return n.join(first, ["source", "lang"]).select("source", "lang", "refs", "snippets")


@query("success_summary", "SELECT count(*) AS total, count(*) FILTER (html LIKE '%<title>%') AS success_count FROM pages")
def _(t):
    return t("pages").agg(count().alias("total"), F.count_if(F.col("html").like("%<title>%")).alias("success_count"))


@query("status_flip_lag", f"WITH {SNAPSHOTS} SELECT entity, chapter, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY chapter) AS before FROM snap) WHERE before <> '' AND status <> '' AND before <> status")
def _(t):
    return tm.flips(snapshots(t), ["entity"], ["chapter"], "status").select("entity", "chapter", "before", "status")


@query("status_jump_from_empty", f"WITH {SNAPSHOTS} SELECT entity, chapter, status FROM (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY chapter) AS before FROM snap) WHERE status <> '' AND coalesce(before, '') <> status")
def _(t):
    return tm.flips(snapshots(t), ["entity"], ["chapter"], "status", from_empty=True).select("entity", "chapter", "status")


@query("strict_increase", "SELECT event_id, v FROM (SELECT event_id, user_id, floor(value)::BIGINT AS v, lag(floor(value)::BIGINT, 1, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE v <= before")
def _(t):
    e = t("events").select("event_id", "user_id", F.floor("value").alias("v"))
    return tm.out_of_order(e, ["user_id"], ["event_id"], "v", strict=True).select("event_id", "v")


@query("non_decrease", "SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_quantity, 1, -1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS before FROM lineitem) WHERE l_quantity < before")
def _(t):
    return tm.out_of_order(t("lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long")), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity", strict=False).select("l_orderkey", "l_linenumber")


@query("last_non_empty_backfill", f"WITH {SNAPSHOTS}, g AS (SELECT *, CASE WHEN chapter % 3 = 0 THEN '' WHEN chapter % 5 = 0 THEN NULL ELSE status END AS leaf FROM snap) SELECT entity, chapter, last_value(nullif(leaf, '') IGNORE NULLS) OVER (PARTITION BY entity ORDER BY chapter ROWS UNBOUNDED PRECEDING) AS filled FROM g")
def _(t):
    leaf = F.when(F.col("chapter") % 3 == 0, "").when(F.col("chapter") % 5 != 0, F.col("status"))
    return snapshots(t).withColumn("leaf", leaf).select("entity", "chapter", tm.last_non_empty("leaf", ["entity"], ["chapter"]).alias("filled"))


@query("sequence_number", "SELECT l_orderkey, l_linenumber, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def _(t):
    w = Window.partitionBy("l_orderkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w.orderBy("l_linenumber")).cast("long").alias("i"), F.count("*").over(w).alias("total"))


@query("index_allocation", "WITH m AS (SELECT source, max(doc_id) FILTER (doc_id % 2 = 0) AS top FROM documents GROUP BY source) SELECT doc_id, (coalesce(top, -1) + row_number() OVER (PARTITION BY d.source ORDER BY doc_id))::BIGINT AS global_index FROM documents d JOIN m USING (source) WHERE doc_id % 2 = 1")
def _(t):
    d = t("documents").select("doc_id", "source")
    top = d.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), F.lit(-1)).alias("top"))
    numbered = r.numbered(d.filter("doc_id % 2 = 1"), "source", "doc_id")
    return numbered.join(top, "source").select("doc_id", (F.col("top") + F.col("n")).cast("long").alias("global_index"))


@query("next_start", "SELECT l_orderkey, l_linenumber, lead(l_partkey, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS until FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.lead("l_partkey", 1, 0).over(w).alias("until"))


@query("history_budget_trim", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 1 OR role = 'system' OR (back <= 10 AND chars <= 600)")
def _(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = t("conversations").withColumn("chars", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("back", F.row_number().over(w))
    return c.filter("back <= 1 or role = 'system' or (back <= 10 and chars <= 600)").select("conv_id", "turn")


@query("session_title", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'given' ELSE left(min_by(text, turn), 20) END AS title FROM conversations GROUP BY conv_id")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.when(F.col("conv_id") % 3 == 0, "given").otherwise(F.substring(F.min_by("text", "turn"), 1, 20)).alias("title"))


@query("growth_marker", "SELECT user_id, day, event_id FROM (SELECT user_id, ts::DATE AS day, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('purchase', 'signup')) WHERE r = 1")
def _(t):
    e = t("events").filter(F.col("event_type").isin("purchase", "signup")).withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("appearance_distribution", f"WITH {SNAPSHOTS} SELECT entity, chapter, round(chapter / greatest((SELECT max(chapter) FROM snap), 1) * 100, 4) AS position FROM snap GROUP BY entity, chapter")
def _(t):
    s = snapshots(t)
    last = s.agg(F.greatest(F.max("chapter"), F.lit(1)).alias("last"))
    return s.select("entity", "chapter").distinct().join(F.broadcast(last)).select("entity", "chapter", F.round(F.col("chapter") / F.col("last") * 100, 4).alias("position"))


@query("top_newest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(t):
    return t("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderdate")


@query("null_first_sort", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.toxic NULLS FIRST, d.doc_id")
def _(t):
    d = t("documents").select("doc_id").join(t("labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.orderBy(F.asc_nulls_first("toxic"), "doc_id")


@query("login_or_match", "SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 11")
def _(t):
    return t("customer").filter((F.col("c_name") == "Customer#000000007") | (F.col("c_custkey") == 11)).select("c_custkey")


@query("job_list_newest", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 10 ORDER BY o_orderdate DESC, o_orderkey DESC")
def _(t):
    return t("orders").filter("o_custkey = 10").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_orderstatus")


@query("job_detail", "SELECT o_orderkey, count(l_orderkey) AS chapters, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS states FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(count().alias("chapters"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    lines = lines.withColumn("states", F.array_join(F.transform("s", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), ","))
    return t("orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("chapters", F.lit(0)).alias("chapters"), F.coalesce("states", F.lit("")).alias("states"))


@query("history_by_key", "SELECT turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def _(t):
    return t("conversations").filter("conv_id = 3").orderBy("turn").select("turn", "role", "text")


@query("entity_names", "SELECT DISTINCT n_name FROM nation WHERE n_name <> ''")
def _(t):
    return t("nation").filter("n_name <> ''").select("n_name").distinct().orderBy("n_name")


@query("month_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS uploaded FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("uploaded"))

"""Text transforms; some have no SQL that DuckDB could run, and are tested by example."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import html, jsonx, split, text
from papyra.operators.terms import earliest_hits
from papyra.plans.registry import query


@query("clean_web_text", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', E'\n', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM pages")
def _(t):
    return t("pages").select("page_id", text.clean_web(F.col("html")).alias("cleaned"))


@query("clean_text_lines")
def _(t):
    return t("documents").select("doc_id", text.clean_lines(F.col("text")).alias("cleaned"))


@query("clean_markdown", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def _(t):
    return t("documents").select("doc_id", text.clean_markdown(F.col("text")).alias("cleaned"))


@query("sanitize_name", r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g'), '\.+$', ''), ''), 'untitled') AS file_name FROM pages""")
def _(t):
    return t("pages").select("page_id", text.file_name(F.col("url")).alias("file_name"))


@query("chapter_id", "SELECT doc_id, 'nch_' || substr(sha1(source || '|' || lang || '|' || doc_id), 1, 20) AS chapter_id FROM documents")
def _(t):
    return t("documents").select("doc_id", text.chapter_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("chapter_id"))


@query("chunk_id", "SELECT doc_id, substr(source, 1, 10) || '_ch' || (doc_id % 7) || '_' || printf('%04d', doc_id) || md5(source) AS chunk_id FROM documents")
def _(t):
    return t("documents").select("doc_id", text.chunk_id(F.col("source"), F.col("doc_id") % 7, F.col("doc_id")).alias("chunk_id"))


@query("snapshot_id", "SELECT DISTINCT 's_' || user_id || '_' || date_diff('day', DATE '2024-01-01', ts::DATE) AS snapshot_id FROM events")
def _(t):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return t("events").select(F.concat_ws("_", F.lit("s"), F.col("user_id").cast("string"), day.cast("string")).alias("snapshot_id")).distinct()


@query("shrink", "SELECT doc_id, substr(text, 1, (length(text) // 4)::INT) AS part FROM documents")
def _(t):
    return t("documents").select("doc_id", text.shrink(F.col("text"), 2).alias("part"))


#: English words, so that the test texts have hits.
ENGLISH = (("complaint", ("idiot", "worthless")), ("question", ("what", "which")), ("chat", ("the", "hello")))


@query("intent_rules", "SELECT conv_id, turn, CASE WHEN contains(text, 'idiot') OR contains(text, 'worthless') THEN 'complaint' WHEN contains(text, 'what') OR contains(text, 'which') THEN 'question' WHEN contains(text, 'the') OR contains(text, 'hello') THEN 'chat' ELSE 'other' END AS intent FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", text.first_class(F.col("text"), ENGLISH, "other").alias("intent"))


@query("intent_rules_fixed")
def _(t):
    return t("conversations").select("conv_id", "turn", text.first_class(F.col("text"), text.INTENTS, text.DEFAULT_INTENT).alias("intent"))


@query("no_rag_phrase", "SELECT conv_id, turn, NOT regexp_matches(text, 'don''?t use rag|no rag') AS searches FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", text.wants_search(F.col("text")).alias("searches"))


@query("highlight", "SELECT doc_id, regexp_replace(text, '(worthless|pathetic|idiot)', '<mark>\\1</mark>', 'g') AS marked FROM documents".replace("\\\\", "\\"))
def _(t):
    return t("documents").select("doc_id", text.highlighted(F.col("text"), ["idiot", "worthless", "pathetic"]).alias("marked"))


@query("confidence_bucket", "SELECT doc_id, CASE WHEN c IS NULL THEN 'unreviewed' WHEN c < 0.6 THEN 'low' ELSE 'ok' END AS bucket FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality * 0.7 + l.toxic * 0.2 END AS c FROM documents d LEFT JOIN labels l USING (doc_id))")
def _(t):
    d = t("documents").select("doc_id").join(t("labels"), "doc_id", "left").withColumn("c", F.col("quality") * 0.7 + F.col("toxic") * 0.2)
    return d.select("doc_id", text.confidence_bucket(F.col("c")).alias("bucket"))


@query("json_leaf_props", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("array_overlap_names", "SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['the', 'of', 'und'])")
def _(t):
    return t("documents").filter(F.arrays_overlap(F.split("text", " "), F.array(*map(F.lit, ("the", "of", "und"))))).select("doc_id")


@query("truncated_titles", "SELECT conv_id, turn, substr(text, 1, 50) AS snippet FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", F.substring("text", 1, 50).alias("snippet"))


@query("session_key_parts", "SELECT DISTINCT conv_id, 1::BIGINT AS user_id, substr('k' || conv_id, 1, 64) AS key FROM conversations")
def _(t):
    key = F.concat(F.lit("user_1_k"), F.col("conv_id").cast("string"))
    c = t("conversations").select("conv_id", key.alias("full")).distinct()
    return c.select("conv_id", F.regexp_extract("full", r"^user_(\d+)_", 1).cast("long").alias("user_id"), F.substring(F.regexp_extract("full", r"^user_\d+_(.*)$", 1), 1, 64).alias("key"))


@query("html_title")
def _(t):
    return t("pages").select("page_id", html.read_of(F.col("html"))["title"].alias("title"))


@query("html_links_and_text")
def _(t):
    p = t("pages").select("page_id", html.read_of(F.col("html")).alias("p"))
    return p.select("page_id", F.coalesce(F.size("p.links"), F.lit(0)).alias("links"), F.col("p.text").alias("text"))


def _headed(t):
    """Documents with headings put before each third line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("章 x\n"), x)).otherwise(x))
    return t("documents").select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


@query("chapter_split")
def _(t):
    d = _headed(t).select("doc_id", F.posexplode(split.chapters_of(F.col("text"), F.col("source"))).alias("i", "c"))
    return d.select("doc_id", "i", F.col("c.title").alias("title"), F.col("c.start").alias("char_start"), F.col("c.end").alias("char_end"), F.length("c.text").alias("n_chars"))


def _marked(t):
    """Documents as Markdown: each fourth line a heading of depth 1 to 3."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" "), F.substring(x, 1, 30), F.lit("\n\n"), x)).otherwise(x))
    return t("documents").select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


@query("md_blocks")
def _(t):
    d = _marked(t).select("doc_id", F.posexplode(split.blocks_of(F.col("text"))).alias("i", "b"))
    return d.select("doc_id", "i", "b.type", "b.start", "b.end", "b.level", "b.title")


@query("md_chapters")
def _(t):
    d = _marked(t).select("doc_id", F.posexplode(split.markdown_chapters_of(F.col("text"), F.col("source"))).alias("i", "c"))
    return d.select("doc_id", "i", "c.title", F.col("c.start").alias("char_start"), F.col("c.end").alias("char_end"))


@query("md_chunks")
def _(t):
    d = _marked(t).select("doc_id", F.posexplode(split.markdown_chunks_of(F.col("text"))).alias("i", "c"))
    return d.select("doc_id", "i", "c.type", "c.path", "c.section", F.col("c.text").alias("text"))


@query("recursive_chunks")
def _(t):
    d = t("documents").select("doc_id", F.posexplode(split.chunks_of(F.col("text"))).alias("i", "text"))
    return d.select("doc_id", "i", "text", F.md5("text").alias("content_hash"))


@query("scene_split")
def _(t):
    d = t("documents").select("doc_id", F.posexplode(split.scenes_of(F.regexp_replace("text", "\n", "\n\n"))).alias("i", "text"))
    return d.select("doc_id", "i", F.length("text").alias("n_chars"))


@query("json_recover")
def _(t):
    answer = F.concat(F.lit("Well: ```json\n"), F.to_json(F.struct("role", "turn")), F.lit("\n``` "), F.col("text"))
    return t("conversations").select("conv_id", "turn", jsonx.recovered_of(answer).alias("json"))


@query("suggestions", "SELECT conv_id, turn, substr(trim(string_split(text, '.')[1]), 1, 80) AS first FROM conversations")
def _(t):
    parts = F.transform(F.split("text", r"\."), lambda x: F.trim(x))
    return t("conversations").select("conv_id", "turn", F.substring(F.get(parts, F.lit(0)), 1, 80).alias("first"))


@query("extract_stub")
def _(t):
    """A deterministic extractor by rule: capitalised words are entities."""
    words = F.expr(r"regexp_extract_all(text, '(\\b[A-Z][a-z]{3,})', 1)")
    d = t("documents").select("doc_id", F.explode(F.array_distinct(words)).alias("name"))
    return d.groupBy("name").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


@query("url_join", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/c/' || page_id || '.html' AS absolute FROM pages")
def _(t):
    link = F.format_string("/c/%d.html", F.col("page_id"))
    return t("pages").select("page_id", html.joined_url(F.col("url"), link).alias("absolute"))


@query("crawl_envelope", "SELECT page_id, page_id % 4 <> 0 AS success, CASE WHEN page_id % 4 = 0 THEN 'empty page' END AS error, (SELECT count(*) FROM pages WHERE page_id % 4 <> 0 AND coalesce(html, '') <> '') AS success_count FROM pages WHERE coalesce(html, '') <> ''")
def _(t):
    """Each page's result by itself, and how many succeeded."""
    page = F.when(F.col("page_id") % 4 != 0, F.col("html")).otherwise(F.lit(""))
    p = t("pages").filter("html <> ''").select("page_id", html.result_of(page).alias("r"))
    n = p.agg(F.count_if("r.success").alias("success_count"))
    return p.join(F.broadcast(n)).select("page_id", "r.success", "r.error", "success_count")  # one row


@query("split_by_type")
def _(t):
    d = _marked(t).withColumn("file_type", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt"))
    c = d.select("doc_id", F.explode(split.by_type_of(F.col("text"), F.col("file_type"), F.col("source"))).alias("c"))
    return c.select("doc_id", "c.*")


PASSAGE = (2, 8)
_WORDS = r"string_split_regex(trim(text), '\s+')"


@query("term_join_earliest", f"""WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark), t AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM w, range({PASSAGE[0]}, {PASSAGE[1] + 1}) AS a(n), range(1, 500) AS b(i) WHERE i + n - 1 <= len(w)),
d AS (SELECT DISTINCT term FROM t), h AS (SELECT doc_id, term, strpos(text, term) - 1 AS pos FROM documents, d WHERE contains(text, term)),
b AS (SELECT doc_id, item_id, term, pos, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos, length(term) DESC, term) AS r FROM h JOIN t USING (term)) SELECT doc_id, item_id, term, pos::BIGINT AS pos FROM b WHERE r = 1""")
def _(t):
    """Where each document first has a passage, of two to eight words, of each benchmark item."""
    words = F.split(F.trim("text"), r"\s+")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(0)), F.lit(1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    w = t("benchmark").select("item_id", words.alias("w"))
    terms = None
    for n in range(PASSAGE[0], PASSAGE[1] + 1):
        one = w.filter(F.size("w") >= n).select("item_id", F.explode(grams(n)).alias("term"))
        terms = one if terms is None else terms.unionByName(one)
    hits = earliest_hits(t("documents"), terms, key=["doc_id"], text="text", owner="item_id")
    return hits.select("doc_id", F.col("owner").alias("item_id"), "term", F.col("at").alias("pos"))

"""All that is known of each entity as of a chapter, in one nested row, and the queries that show parts of it."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.operators.relational import window_around
from papyra.operators.temporal import valid_at
from papyra.operators.terms import earliest_hits

#: Fixed value: the trend of a relation that tells none.
STEADY = "稳定"


def deep_merged(values: list[str | None]) -> str:
    """JSON objects laid over each other, later ones on top: null, empty texts and empty lists change nothing, 0 and false
    count, objects are merged key by key, lists are replaced."""

    def lay(over: dict, below: dict) -> dict:
        out = dict(below)
        for k, v in over.items():
            if isinstance(v, dict):
                out[k] = lay(v, out[k] if isinstance(out.get(k), dict) else {})
            elif not (v is None or v == "" or v == []):
                out[k] = v
        return out

    merged: dict = {}
    for v in values:
        try:
            read = json.loads(v) if v else None
        except ValueError:
            read = None
        if isinstance(read, dict):
            merged = lay(read, merged)
    return json.dumps(merged, ensure_ascii=False)


def deep_merged_of(values: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(c: pa.Array) -> pa.Array:
        return pa.array([deep_merged(v or []) for v in c.to_pylist()], pa.string())

    return run(values)


def listed(df: DataFrame, key: str, name: str, order: list[str], columns: list[Column | str]) -> DataFrame:
    """(key, name): each key's rows as an array of structs, in order."""
    rows = df.select(key, F.struct(*[F.col(c) for c in order]).alias("__o"), F.struct(*columns).alias("__r"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__o", "__r"))).alias("l"))
    return rows.select(key, F.transform("l", lambda x: x["__r"]).alias(name))


def cards(t: dict[str, DataFrame], n: int) -> DataFrame:
    """One row for each entity. t: the stored tables (entity, entity_alias, entity_snapshot, entity_relation, timeline_event,
    timeline_event_entity, foreshadowing, rule_check, story_conflict, novel_chapter). An entity without something has an
    empty list or null there."""
    names = t["entity"].select("book_id", "entity_id", F.col("entity_name").alias("name"))
    spelled = names.unionByName(t["entity_alias"].select("book_id", "entity_id", F.col("alias_name").alias("name"))).filter("name <> ''").distinct()
    by_type = listed(t["entity_alias"].groupBy("entity_id", "alias_type").agg(F.array_sort(F.collect_set("alias_name")).alias("names")), "entity_id", "aliases_by_type", ["alias_type"], ["alias_type", "names"])
    by_type = by_type.select("entity_id", F.map_from_entries("aliases_by_type").alias("aliases_by_type"))
    aliases = t["entity_alias"].groupBy("entity_id").agg(F.array_sort(F.collect_set("alias_name")).alias("aliases"))
    # States up to n: all of them, the latest, and the attributes laid over each other.
    s = t["entity_snapshot"].filter(F.col("chapter_index") <= n)
    states = listed(s, "entity_id", "snapshots", ["chapter_index", "snapshot_id"], ["chapter_index", "status_desc", "attributes", "confidence", "review_status"])
    last = F.element_at("snapshots", -1)
    told = F.filter("snapshots", lambda x: F.coalesce(x["status_desc"], F.lit("")) != "")
    states = states.withColumns({
        "status": last["status_desc"], "attributes": deep_merged_of(F.transform("snapshots", lambda x: x["attributes"])), "status_filled": F.coalesce(F.try_element_at(told, F.lit(-1))["status_desc"], F.lit("")),
    })
    # Relations that hold at n, seen from either end.
    r = t["entity_relation"].filter(valid_at(n))
    other = names.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other_name"))
    columns = ["relation_id", "relation_type", "relation_weight", "valid_period", "start_chapter", "end_chapter", "surface_relation", "inner_relation", "relation_trend"]
    ends = r.select(F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("other_id"), *columns)
    ends = ends.unionByName(r.filter("source_entity_id <> target_entity_id").select(F.col("target_entity_id").alias("entity_id"), F.col("source_entity_id").alias("other_id"), *columns))
    ends = ends.join(other, "other_id", "left").withColumns({"relation_trend": F.coalesce(F.nullif("relation_trend", F.lit("")), F.lit(STEADY)), "inner_relation": F.coalesce("inner_relation", F.lit(""))})
    state_of = F.when(F.col("inner_relation") != "", "inference").otherwise("fact").alias("three_state")
    order = ["start_chapter", "relation_type", "other_id", "relation_id"]
    links = listed(ends, "entity_id", "relations", order, ["other_id", "other_name", *columns, state_of])
    events = t["timeline_event_entity"].select("event_id", "entity_id").distinct().join(t["timeline_event"].drop("book_id"), "event_id")
    took_part = listed(events, "entity_id", "events", ["global_sort", "event_id"], ["event_id", "event_title", "event_level", "global_sort", "start_chapter", "end_chapter", "narrative_type", "plot_impact"])
    # Foreshadowing names those involved; conflicts have them somewhere in a side.
    f = t["foreshadowing"].withColumn("name", F.explode("involved_entity_ids")).join(spelled, ["book_id", "name"]).dropDuplicates(["foreshadowing_id", "entity_id"])
    lines = listed(f, "entity_id", "foreshadowings", ["setup_chapter", "foreshadowing_id"], ["title", "setup_chapter", "reveal_chapter", "status", "foreshadowing_type", "concealment_level", "misleading_info"])
    sides = t["story_conflict"].select("book_id", "conflict_id", F.explode(F.array("side_a", "side_b")).alias("side"))
    taking = earliest_hits(sides, spelled, key=["book_id", "conflict_id"], text="side", scope="book_id", owner="entity_id", term="name")
    c = taking.select("book_id", "conflict_id", F.col("owner").alias("entity_id")).join(t["story_conflict"], ["book_id", "conflict_id"]).select("entity_id", "conflict_id", "conflict_title", "current_status", "side_a", "side_b")
    fights = listed(c, "entity_id", "conflicts", ["conflict_id"], ["conflict_title", "current_status", "side_a", "side_b"])
    rules = listed(t["rule_check"].filter("subject_entity_id is not null").withColumnRenamed("subject_entity_id", "entity_id"), "entity_id", "rules", ["valid_from_chapter", "rule_id"], ["rule_name", "rule_type", "rule_content", "subject_ability", "last_check_result"])
    card = t["entity"]
    for part in (aliases, by_type, states, links, took_part, lines, fights, rules, evidence_at(spelled, t["novel_chapter"], n)):
        card = card.join(part, "entity_id", "left")
    for part in (links, took_part, lines, fights, rules, aliases, states):
        for name, kind in part.dtypes:
            if kind.startswith("array"):
                card = card.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    core = F.from_json("core_baseline", "personality string, memory_points array<string>")
    pick = lambda c, *fields: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    inferred = lambda c, *fields: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in fields], F.lit("inference").alias("three_state")))
    return card.select(
        "entity_id", F.col("entity_name").alias("name"), F.col("entity_type").alias("type"), "aliases", "status", "relations", "events", "evidence", "confidence", "review_status",
        F.struct("narrative_role", "arc_type", F.col("first_chapter_index").alias("first_chapter"), F.col("last_chapter_index").alias("last_chapter"), F.col("is_active").cast("boolean").alias("is_active"), "aliases_by_type").alias("L0_identity"),
        F.struct(F.coalesce("description", F.lit("")).alias("origin"), F.coalesce("core_baseline", F.lit("{}")).alias("core_baseline"), F.coalesce(core["personality"], F.lit("")).alias("personality"),
                 F.coalesce(core["memory_points"], F.array().cast("array<string>")).alias("memory_points"), F.lit("inference").alias("three_state")).alias("L1_baseline"),
        F.struct(last_of("snapshots", "chapter_index").alias("chapter_index"), F.coalesce("status_filled", F.lit("")).alias("status_desc"), F.coalesce("attributes", F.lit("{}")).alias("attributes"),
                 F.when(last_of("snapshots", "review_status").isNull(), "review").otherwise("fact").alias("three_state"), last_of("snapshots", "confidence").alias("confidence"), last_of("snapshots", "review_status").alias("review_status")).alias("L2_snapshot"),
        F.struct("snapshots", pick("events", "event_id", "event_title", "start_chapter", "end_chapter").alias("events"), pick("relations", "other_name", "relation_type", "start_chapter", "end_chapter", "surface_relation", "inner_relation", "relation_trend").alias("relation_evolution"),
                 pick("foreshadowings", "title", "setup_chapter", "reveal_chapter", "status").alias("foreshadowing_line")).alias("L3_arc"),
        F.struct(inferred(F.filter("foreshadowings", lambda x: x["status"] == "pending"), "title", "foreshadowing_type", "concealment_level", "misleading_info").alias("unresolved_secrets"), "rules", "conflicts",
                 pick("relations", "other_name", "relation_type", "surface_relation", "inner_relation", "relation_trend", "three_state").alias("surface_inner_relations"),
                 inferred("events", "event_title", "narrative_type", "plot_impact").alias("narrative_types")).alias("L4_narrative"),
    )


def last_of(array: str, field: str) -> Column:
    return F.try_element_at(F.col(array), F.lit(-1))[field]


def evidence_at(spelled: DataFrame, chapters: DataFrame, n: int, width: int = 200) -> DataFrame:
    """(entity_id, evidence): where chapter n of the book first has one of the entity's names."""
    text = chapters.filter(F.col("chapter_index") == n).select("book_id", "chapter_index", "chapter_title", "chapter_text")
    found = earliest_hits(text, spelled, key=["book_id"], text="chapter_text", scope="book_id", owner="entity_id", term="name")
    first = found.select("book_id", F.col("owner").alias("entity_id"), F.col("at").alias("__at")).join(text, "book_id")
    return first.select("entity_id", F.struct("chapter_index", "chapter_title", window_around(F.col("chapter_text"), F.col("__at"), width).alias("window")).alias("evidence"))


def default_chapter(chapters: DataFrame) -> DataFrame:
    """(book_id, n): a book's last chapter, which stands for none given; 0 where it has none."""
    return chapters.groupBy("book_id").agg(F.coalesce(F.max("chapter_index"), F.lit(0)).alias("n"))


def attribute_summary(attributes: Column) -> Column:
    """"k: v" of a JSON object's values that are neither null nor empty; a text that isn't one stays as it is."""
    entries = F.from_json(attributes, "map<string,string>")
    said = F.transform(F.map_entries(F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(F.ltrim(attributes).startswith("{") & entries.isNotNull(), F.array_join(said, " · ")).otherwise(F.coalesce(attributes, F.lit("")))


def three_state(state: Column) -> Column:
    """What a state is shown as."""
    return F.when(state == "inference", "合理推断").when(state == "review", "待复核").otherwise("原文直证")


def bounds(start: Column, end: Column) -> tuple[Column, Column]:
    s = F.coalesce(start, F.lit(0)).cast("double")
    return s, F.when(end.isNull() | (end.cast("double") < s), s).otherwise(end.cast("double"))


def block(start: Column, end: Column, most: Column) -> Column:
    """Where a timeline shows chapters, in percent of ``most``: (left, width)."""
    s, e = bounds(start, end)
    m = F.when(most > 0, most).otherwise(F.lit(1))
    return F.struct((s / m * 100).alias("left"), ((e - s) / m * 100).alias("width"))


def chapter_label(start: Column, end: Column) -> Column:
    """"第 s~e 章", or what is left of it for a single chapter, an open end or a start that isn't known."""
    s, e = (c.cast("long") for c in bounds(start, F.nullif(end, F.lit(0))))
    single = F.format_string("第 %d 章", s)
    return F.when(e == s, single).when(s == 0, F.format_string("第 %d 章起", e)).otherwise(F.format_string("第 %d~%d 章", s, e))


def book_query(t: dict[str, DataFrame], book: str, entity: str | None = None, chapter: int | None = None, start: int | None = None, end: int | None = None, events: bool = False) -> dict[str, DataFrame]:
    """What is asked of a book: an entity's snapshots and relations, a chapter's events; nothing for what isn't asked."""
    out: dict[str, DataFrame] = {}
    own = lambda name: t[name].filter(F.col("book_id") == book)
    if entity:
        s = own("entity_snapshot").filter(F.col("entity_name") == entity)
        out["snapshots"] = s if chapter is None else s.filter(F.col("chapter_index") == chapter)
        ids = own("entity").filter(F.col("entity_name") == entity).select("entity_id")
        r = own("entity_relation")
        r = r.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").unionByName(r.join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")).dropDuplicates(["relation_id"])
        r = r if start is None else r.filter(F.col("start_chapter") >= start)
        out["relations"] = r if end is None else r.filter(F.col("start_chapter") <= end)
    if events:
        names = t["timeline_event_entity"].join(t["entity"].select("entity_id", "entity_name"), "entity_id").groupBy("event_id").agg(F.array_sort(F.collect_set("entity_name")).alias("involved_entities"))
        out["events"] = own("timeline_event").filter(F.col("start_chapter") == (chapter or 0)).join(names, "event_id", "left")
    return out

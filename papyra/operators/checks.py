"""What is checked before a chapter's records are stored: references, changes of state, order, rules and anchors. Each check
splits its rows, or only tells; what it has found are issues of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which column of a record says what it is, by type of record (a table's and a batch's name of it).
TARGET_IDS = {
    "entity": "entity_id",
    "entities": "entity_id",
    "entity_snapshot": "snapshot_id",
    "entity_snapshots": "snapshot_id",
    "entity_relation": "relation_id",
    "relations": "relation_id",
    "timeline_event": "event_id",
    "timeline_events": "event_id",
    "location": "location_id",
    "locations": "location_id",
    "location_snapshot": "snapshot_id",
    "foreshadowing": "foreshadowing_id",
    "foreshadowings": "foreshadowing_id",
    "story_conflict": "conflict_id",
    "conflicts": "conflict_id",
    "rule_check": "rule_id",
    "rule_checks": "rule_id",
}
#: References by table: (column, what it must be the name of, whether it may be empty, what to say).
REFERENCES = {
    "relations": [("source", "entity", False, "unknown source"), ("target", "entity", False, "unknown target")],
    "entity_snapshots": [("entity_name", "entity", False, "unknown entity")],
    "timeline_events": [("parent_title", "event", True, "unknown parent")],
    "foreshadowings": [("setup_event_title", "event", True, "unknown setup event")],
    "rule_checks": [("subject_entity_name", "entity", True, "unknown subject")],
}
#: What tells rows apart whose references may be empty, by table.
TOLD_BY = {"timeline_events": "event_title", "foreshadowings": "title", "rule_checks": "rule_name"}
#: Over so many keys rows are dealt that name nothing: by name they would all be one key.
LANES = 4096
#: The stored table of each batch.
TABLE_OF = {
    "entities": "entity",
    "entity_snapshots": "entity_snapshot",
    "relations": "entity_relation",
    "timeline_events": "timeline_event",
    "locations": "location",
    "foreshadowings": "foreshadowing",
    "conflicts": "story_conflict",
    "rule_checks": "rule_check",
}


def target_id(record_type: Column, record: Column) -> Column:
    """The id of a JSON record, or of the first of a list that has one, by its type; null where there is none."""
    one = lambda r: F.coalesce(*[F.when(record_type.isin(*[t for t, c in TARGET_IDS.items() if c == key]), F.nullif(F.get_json_object(r, f"$.{key}"), F.lit(""))) for key in dict.fromkeys(TARGET_IDS.values())])
    of_list = F.filter(F.transform(F.from_json(record, "array<string>"), one), lambda x: x.isNotNull())
    return F.when(F.ltrim(record).startswith("["), F.try_element_at(of_list, F.lit(1))).otherwise(one(record))


def issues(df: DataFrame, record_type: str, issue_type: str, description: Column, original: Column | None = None, suggested: Column | None = None, target: Column | None = None) -> DataFrame:
    """One issue for each row (book_id, chapter_index, ...)."""
    whole = F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns])) if suggested is None else suggested
    return df.select("book_id", "chapter_index", F.lit(record_type).alias("record_type"), F.lit(issue_type).alias("issue_type"), F.lit("warning").alias("severity"), description.alias("description"),
                     (F.lit(None).cast("string") if original is None else original.cast("string")).alias("original_value"), whole.alias("suggested_value"), (target_id(F.lit(record_type), whole) if target is None else target).alias("target_id"))


def lane(rows: DataFrame, name: str, told_by: str | None) -> Column:
    """0 for rows that name something; others are dealt to lanes by another of their columns, where they have it. Names
    joined by it have theirs from here too: of a literal the optimizer would make a condition on one side, not a key."""
    rest = F.pmod(F.xxhash64(told_by), F.lit(LANES)).cast("int") + 1 if told_by in rows.columns else F.lit(1)
    return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.lit(0)).otherwise(rest)


def asked_of(rows: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Those of names that some row asks for; by: the columns that both have, the name last. Empty names ask for nothing."""
    return names.join(rows.filter(F.col(by[-1]) != "").select(*by).distinct(), by, "left_semi")


def referred(table: str, rows: DataFrame, names: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows whose references are known, issues of the others). names: 'entity' and 'event' -> (book_id, name)."""
    columns, out = rows.columns, rows
    why: list[Column] = []
    for i, (c, kind, optional, says) in enumerate(REFERENCES.get(table, [])):
        known = names[kind].select("book_id", F.col("name").alias(c))
        missing = F.col(f"__{i}").isNull()
        if optional:
            known = asked_of(rows, known, ["book_id", c]).distinct()
            known = known.withColumns({"__lane": lane(known, c, None), f"__{i}": F.lit(True)})
            out = out.withColumn("__lane", lane(rows, c, TOLD_BY.get(table))).join(known, ["book_id", c, "__lane"], "left").drop("__lane")
            missing &= F.coalesce(F.col(c), F.lit("")) != ""
        else:
            out = out.join(known.distinct().withColumn(f"__{i}", F.lit(True)), ["book_id", c], "left")
        why.append(F.when(missing, F.concat_ws(" ", F.lit(says), F.coalesce(F.col(c), F.lit("")))))
    if not why:
        return rows, issues(rows.limit(0), TABLE_OF[table], "rule_violation", F.lit(""))
    out = out.withColumn("__why", F.coalesce(*why))
    bad = out.filter("__why is not null")
    return out.filter("__why is null").select(*columns), issues(bad.select(*columns, F.col("__why").alias("why")), TABLE_OF[table], "rule_violation", F.col("why"))


def supported(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Those (book_id, chapter_index, entity_name) that an event of the chapter supports: it names the entity among those who
    take part, or in its content. The first is an equality join. So is the second, with no event met by every name of its
    chapter: a content is taken apart into all its pieces that are as long as some name."""
    at = ["book_id", "chapter_index"]
    taking_part = events.select(*at, F.explode("involved_entities").alias("entity_name")).distinct()
    told = pairs.join(taking_part, [*at, "entity_name"], "left_semi")
    rest = pairs.join(taking_part, [*at, "entity_name"], "left_anti").filter("entity_name <> ''")
    content = events.select(*at, F.col("event_content").alias("__content")).filter("__content <> ''").distinct()
    size = pairs.filter("entity_name <> ''").select(F.length("entity_name").alias("__n")).distinct()  # as many rows as lengths
    longer = content.join(F.broadcast(size), F.length("__content") >= F.col("__n"))
    places = F.sequence(F.lit(1), F.length("__content") - F.col("__n") + 1)
    pieces = longer.select(*at, F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("__content"), i, F.col("__n"))))).alias("entity_name")).distinct()
    within = rest.join(pieces, [*at, "entity_name"], "left_semi").select(*at, "entity_name").distinct()
    return told.select(*at, "entity_name").distinct().unionByName(within)


def continuous(before: DataFrame, now: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, issues): an entity whose state differs from its last one without an event that supports it loses this
    chapter's snapshots. before: book_id, entity_name, status_desc."""
    at = ["book_id", "chapter_index", "entity_name"]
    clean = now.withColumn("__name", F.trim("entity_name"))
    old = before.groupBy("book_id", F.trim("entity_name").alias("__name")).agg(F.max(F.trim("status_desc")).alias("__before"))
    changed = clean.join(old, ["book_id", "__name"]).filter("__name <> '' and __before <> '' and trim(status_desc) <> '' and __before <> trim(status_desc)")
    pairs = changed.select(*at).distinct()
    bad = pairs.join(supported(pairs, events), at, "left_anti")
    found = changed.join(bad, at, "left_semi").select(*now.columns, "__before")
    told = F.concat(F.lit("state changed without an event: "), F.col("__before"), F.lit(" -> "), F.trim("status_desc"))
    snapshot_id = F.col("snapshot_id") if "snapshot_id" in now.columns else F.lit(None).cast("string")
    return now.join(bad, at, "left_anti"), issues(found, "entity_snapshot", "state_jump", told, F.col("__before"), F.trim("status_desc"), snapshot_id)


def disordered(events: DataFrame) -> DataFrame:
    """Issues of events whose place is below that of the one before in their scene, in the order of extraction (ord)."""
    w = Window.partitionBy("book_id", "chapter_index", "scene").orderBy("ord")
    seen = events.withColumn("before", F.lag("global_sort", 1, -1).over(w)).filter("global_sort < before")
    told = F.concat_ws(" ", F.lit("scene"), F.col("scene").cast("string"), F.lit("has"), F.col("global_sort").cast("string"), F.lit("behind"), F.col("before").cast("string"))
    return issues(seen, "timeline_event", "timeline_paradox", told)


def contradictory(rules: DataFrame) -> DataFrame:
    """Issues of abilities with several caps in a chapter and no lock among their rules."""
    g = rules.filter("rule_type in ('cap', 'balance_lock')").groupBy("book_id", "chapter_index", F.coalesce("subject_ability", F.lit("")).alias("subject_ability"))
    caps = F.array_sort(F.collect_set(F.when(F.col("rule_type") == "cap", F.col("rule_content"))))
    g = g.agg(caps.alias("caps"), F.bool_or(F.col("rule_type") == "balance_lock").alias("locked")).filter("size(caps) > 1 and not locked")
    return issues(g, "rule_check", "rule_violation", F.concat(F.lit("caps contradict: "), F.array_join("caps", ", ")), suggested=F.to_json("caps"), target=F.lit(None).cast("string"))


def anchored(table: str, rows: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose fragment is empty or stands in their chapter's text, issues of the others)."""
    texts = chapters.select("book_id", "chapter_index", F.col("chapter_text").alias("__text"))
    fragment = F.coalesce("source_fragment", F.lit(""))
    out = rows.join(texts, ["book_id", "chapter_index"], "left").withColumn("__ok", (fragment == "") | F.coalesce(F.contains("__text", fragment), F.lit(False))).drop("__text")
    return out.filter("__ok").drop("__ok"), issues(out.filter("not __ok").drop("__ok"), table, "unsupported_change", F.lit("the fragment isn't in the text"))


def validated(batch: dict[str, DataFrame], names: dict[str, DataFrame], before: DataFrame, chapters: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(what passes of each table, all issues): references, then changes of state, then order and rules, then anchors. Tables
    without references (entities, locations, conflicts) are checked for anchors only."""
    passed, found = {}, []
    for table, rows in batch.items():
        passed[table], bad = referred(table, rows, names)
        found += [bad] if table in REFERENCES else []
    if "entity_snapshots" in passed:
        events = passed.get("timeline_events")
        if events is not None:
            passed["entity_snapshots"], bad = continuous(before, passed["entity_snapshots"], events)
            found.append(bad)
    if "timeline_events" in passed:
        found.append(disordered(passed["timeline_events"]))
    if "rule_checks" in passed:
        found.append(contradictory(passed["rule_checks"]))
    for table, rows in passed.items():
        passed[table], bad = anchored(table, rows, chapters)
        found.append(bad)
    return passed, reduce(DataFrame.unionByName, found)

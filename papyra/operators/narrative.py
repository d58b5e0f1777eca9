"""From extracted records of a book's chapters to stored tables: parse and check, merge aliases, resolve names to ids,
validate, and keep the state of each chapter. All steps take whole tables, keyed by book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.operators.graph import alias_groups
from papyra.operators.upsert import new_keys, upsert

#: The records that are extracted, their fields and what they may hold.
ENTITY_TYPES = ("human", "item", "skill", "spirit", "task", "faction", "rule")
RELATION_TYPES = ("possess", "master", "contain", "restrain", "undertake", "belong_to", "host_bind", "alliance", "enmity", "family")
PERIODS, LEVELS, SEVERITIES = ("permanent", "temporary", "reversed"), ("stage", "event"), ("info", "warning", "critical")
SCHEMAS = {
    "entity": "name string, source_fragment string, aliases array<string>, type string, description string",
    "relation": "source string, target string, source_fragment string, relation_type string, weight int, valid_period string, desc string, surface_relation string, inner_relation string, relation_trend string",
    "event": "event_level string, source_fragment string, parent_title string, event_title string, event_content string, time_desc string, global_sort int, start_chapter int, end_chapter int, involved_entities array<string>, narrative_type string, plot_impact string",
    "location": "name string, source_fragment string, level int, parent_name string, description string, status_desc string, special_rules string",
    "foreshadowing": "title string, source_fragment string, description string, setup_chapter int, setup_event_title string, status string, involved_entities array<string>, foreshadowing_type string, concealment_level int, misleading_info string",
    "conflict": "conflict_title string, source_fragment string, conflict_type string, conflict_desc string, side_a string, side_b string, start_chapter int, end_chapter int, current_status string",
    "rule": "rule_name string, source_fragment string, rule_type string, rule_content string, subject_entity_name string, subject_ability string, valid_from_chapter int, valid_to_chapter int",
    "finding": "record_type string, target string, conflict_desc string, severity string, suggested_value string",
}
CHECKS: dict[str, dict[str, Column | Callable[[], Column]]] = {
    "entity": {"no name": lambda: F.trim("r.name") == "", "unknown type": lambda: ~F.col("r.type").isin(*ENTITY_TYPES)},
    "relation": {"unknown type": lambda: ~F.col("r.relation_type").isin(*RELATION_TYPES), "weight": lambda: ~F.col("r.weight").between(1, 2), "unknown period": lambda: ~F.col("r.valid_period").isin(*PERIODS)},
    "event": {"unknown level": lambda: ~F.col("r.event_level").isin(*LEVELS), "sort": lambda: ~F.col("r.global_sort").between(0, 999)},
    "location": {"level": lambda: ~F.col("r.level").between(1, 4)},
    "foreshadowing": {"concealment": lambda: ~F.col("r.concealment_level").between(1, 10), "unknown status": lambda: ~F.col("r.status").isin("pending", "revealed", "abandoned")},
    "conflict": {"no title": lambda: F.trim("r.conflict_title") == ""},
    "rule": {"unknown type": lambda: ~F.col("r.rule_type").isin("cap", "cost", "balance_lock", "condition", "other")},
    "finding": {"unknown severity": lambda: ~F.col("r.severity").isin(*SEVERITIES)},
}


def parsed(answers: DataFrame, kind: str, field: str = "items") -> tuple[DataFrame, DataFrame]:
    """(records, issues) of JSON answers {field: [...]}. answers: book, chapter, scene, json. A record that fails a check is
    an issue with its reason; an answer that can't be read is one issue."""
    item = T.StructType.fromDDL(SCHEMAS[kind])
    whole = T.StructType([T.StructField(field, T.ArrayType(item))])
    read = answers.withColumn("list", F.from_json("json", whole)[field])
    each = read.filter("list is not null").select("book", "chapter", "scene", F.posexplode("list").alias("ord", "r"))
    reason = F.coalesce(*[F.when(F.coalesce(check(), F.lit(False)), F.lit(name)) for name, check in CHECKS[kind].items()])
    each = each.withColumn("reason", reason)
    good = each.filter("reason is null").select("book", "chapter", "scene", "ord", "r.*")
    bad = each.filter("reason is not null").select("book", "chapter", F.lit(kind).alias("record_type"), "reason", F.to_json("r").alias("original_value"))
    unread = read.filter("list is null").select("book", "chapter", F.lit(kind).alias("record_type"), F.lit("not read").alias("reason"), F.col("json").alias("original_value"))
    return good, bad.unionByName(unread)


def merged_entities(records: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row for each entity of a chapter: records that share a name or alias are one. Its name is that of its earliest
    record; aliases are all others, sorted; type, description and fragment are the first that aren't empty."""
    w = Window.partitionBy("book", "chapter").orderBy("scene", "ord")
    rows = checkpoint(records.withColumn("nth", F.row_number().over(w)).withColumn("record", F.struct("book", "chapter", "nth")))
    spelled = F.array_union(F.array(F.trim("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda s: F.trim(s)))
    names = rows.select("record", F.explode(spelled).alias("spelling")).filter("spelling <> ''")
    scoped = names.select("record", F.concat_ws("\u0001", "record.book", F.col("record.chapter").cast("string"), "spelling").alias("name"))
    groups = alias_groups(scoped, checkpoint)
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("nth"))).alias(c)
    one = rows.join(groups, "record").groupBy("root").agg(F.min_by("name", "nth").alias("name"), first("type"), first("description"), first("source_fragment"))
    every = names.join(groups, "record").groupBy("root").agg(F.array_sort(F.collect_set("spelling")).alias("names"))
    out = one.join(every, "root").select("root.book", "root.chapter", "name", F.array_remove("names", F.col("name")).alias("aliases"), "type", "description", "source_fragment")
    return out


def canonical(df: DataFrame, columns: list[str], entities: DataFrame) -> DataFrame:
    """Names of ``columns`` replaced by the canonical name of their entity in the same chapter; unknown names stay."""
    pairs = entities.select("book", "chapter", F.explode("aliases").alias("alias"), F.col("name").alias("known"))
    for c in columns:
        of = pairs.select("book", "chapter", F.col("alias").alias(c), F.col("known").alias("__known"))
        df = df.join(of, ["book", "chapter", c], "left").withColumn(c, F.coalesce("__known", c)).drop("__known")
    return df


#: Columns that name entities, one by one and in lists; what makes two records of a kind the same fact.
NAMES, NAME_LISTS = ("source", "target", "entity_name", "side_a", "side_b", "subject_entity_name"), ("involved_entities",)
FACTS = {"relations": ("source", "target", "relation_type"), "timeline_events": ("event_level", "event_title")}
CHANNELS = ("entities", "entity_snapshots", "relations", "timeline_events", "locations", "foreshadowings", "conflicts", "rule_checks")


def name_maps(entities: DataFrame) -> DataFrame:
    """(book, chapter, names): a chapter's aliases and what they stand for; a chapter's names are few."""
    pairs = entities.select("book", "chapter", "name", F.explode("aliases").alias("alias")).groupBy("book", "chapter", "alias").agg(F.min("name").alias("name"))
    return pairs.groupBy("book", "chapter").agg(F.map_from_entries(F.collect_list(F.struct("alias", "name"))).alias("__names"))


def aligned(df: DataFrame, maps: DataFrame) -> DataFrame:
    """Records with the names of entities, in columns and in lists, as their chapter has them; names that it doesn't know, and
    the order of lists, stay."""
    known = lambda x: F.coalesce(F.try_element_at("__names", x), x)
    new = {c: known(F.col(c)) for c in NAMES if c in df.columns} | {c: F.transform(c, known) for c in NAME_LISTS if c in df.columns}
    return df.join(maps, ["book", "chapter"], "left").withColumns(new).select(*df.columns) if new else df


def first_facts(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of a chapter's records that are the same fact the first, by scene and place."""
    by = ["book", "chapter", *key]
    rest = [c for c in df.columns if c not in by]
    once = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("scene", "ord")).alias("r"))
    return once.select(*[F.col(c) if c in by else F.col(f"r.{c}").alias(c) for c in df.columns])


def merged_chapters(records: dict[str, DataFrame], checkpoint: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """All eight kinds of records of chapters (book, chapter, scene, ord, ...): entities that share a spelling are one; all other
    kinds call them by their name; relations and events that say the same again are dropped. Locations name no entities."""
    entities = checkpoint(merged_entities(records["entities"], checkpoint))
    maps = checkpoint(name_maps(entities))
    out = {"entities": entities}
    for kind in CHANNELS[1:]:
        rows = aligned(records[kind], maps)
        out[kind] = first_facts(rows, FACTS[kind]) if kind in FACTS else rows
    return out


def entity_id(book: Column, name: Column) -> Column:
    return F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat_ws("|", book, name)), 1, 20))


def registered(entities: DataFrame, known: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, alias) tables after a batch. An entity with any spelling known keeps that id and widens its range of chapters;
    others get an id of their own and all their spellings. known: entity_id, book, entity_name, entity_type, first_chapter,
    last_chapter; aliases: book, alias_name, entity_id."""
    spelled = entities.select("*", F.explode(F.array_union(F.array("name"), "aliases")).alias("alias_name"))
    hits = spelled.join(aliases, ["book", "alias_name"]).groupBy("book", "chapter", "name").agg(F.min("entity_id").alias("old_id"))
    rows = entities.join(hits, ["book", "chapter", "name"], "left").withColumn("entity_id", F.coalesce("old_id", entity_id(F.col("book"), F.col("name"))))
    seen = rows.groupBy("entity_id", "book").agg(F.min_by("name", "chapter").alias("entity_name"), F.min_by("type", "chapter").alias("entity_type"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"))
    old = known.select("entity_id", F.col("first_chapter").alias("a"), F.col("last_chapter").alias("b"))
    seen = seen.join(old, "entity_id", "left").withColumns({"first_chapter": F.least("first_chapter", "a"), "last_chapter": F.greatest("last_chapter", "b")}).select(*known.columns)
    fresh = rows.filter("old_id is null").select("book", "entity_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("alias_name"))
    fresh = fresh.groupBy("book", "alias_name").agg(F.min("entity_id").alias("entity_id"))
    grown = aliases.unionByName(new_keys(fresh, aliases, ["book", "alias_name"]).select(*aliases.columns))
    return upsert(known, seen, ["entity_id"], ["first_chapter", "last_chapter"]), grown


def resolved(relations: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with both ends' ids, issues of those with an end that no alias knows)."""
    of = lambda c: aliases.select("book", F.col("alias_name").alias(c), F.col("entity_id").alias(f"{c}_id"))
    r = relations.join(of("source"), ["book", "source"], "left").join(of("target"), ["book", "target"], "left")
    reason = F.when(F.col("source_id").isNull(), F.concat(F.lit("unknown source "), "source")).when(F.col("target_id").isNull(), F.concat(F.lit("unknown target "), "target"))
    r = r.withColumn("reason", reason)
    issues = r.filter("reason is not null").select("book", "chapter", F.lit("relation").alias("record_type"), "reason", F.to_json(F.struct("source", "target", "relation_type")).alias("original_value"))
    return r.filter("reason is null").drop("reason"), issues


def anchored(records: DataFrame, chapters: DataFrame) -> DataFrame:
    """Records whose fragment is empty or stands in their chapter's text."""
    texts = chapters.select("book", "chapter", "text")
    return records.join(texts, ["book", "chapter"]).filter((F.coalesce("source_fragment", F.lit("")) == "") | F.contains("text", "source_fragment")).drop("text")


def sort_key(chapter: Column, scene: Column, local: Column, *, scenes: int = 100, locals_: int = 1000) -> Column:
    return chapter.cast("long") * scenes * locals_ + scene.cast("long") * locals_ + local.cast("long")


def ladder_issues(rules: DataFrame) -> DataFrame:
    """Books with different caps for one subject and ability, and no lock among them."""
    g = rules.groupBy("book", "subject", "ability").agg(F.count_distinct(F.when(F.col("rule_type") == "cap", F.col("content"))).alias("caps"), F.bool_or(F.col("rule_type") == "balance_lock").alias("locked"))
    return g.filter("caps > 1 and not locked").drop("locked")


def evidence_terms(description: str | None, *values: str | None) -> list[str]:
    """What to look for in a chapter's text: the description and the text leaves of JSON values, at least two characters
    long, each once, the longest first."""
    import json

    from papyra.functions.jsonx import string_leaves

    found = [description or ""]
    for v in values:
        try:
            found += string_leaves(json.loads(v)) if v else []
        except ValueError:
            found.append(v or "")
    terms = dict.fromkeys(t for t in (s.strip() for s in found) if len(t) >= 2)
    return sorted(terms, key=len, reverse=True)


def entity_cards(entities: DataFrame, aliases: DataFrame, snapshots: DataFrame, relations: DataFrame, n: int) -> DataFrame:
    """One nested row for each entity as of chapter n: identity, names, state carried on by leaf, and open relations."""
    from papyra.operators.temporal import last_non_empty, valid_at

    names = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias_name")).alias("aliases"))
    leaves = [c for c in snapshots.columns if c not in ("entity_id", "chapter")]
    filled = snapshots.filter(F.col("chapter") <= n).select("entity_id", "chapter", *[last_non_empty(c, ["entity_id"], ["chapter"]).alias(c) for c in leaves])
    state = filled.groupBy("entity_id").agg(F.max("chapter").alias("state_chapter"), F.max_by(F.struct(*leaves), "chapter").alias("state"))
    near = relations.filter(valid_at(n))
    ends = near.select(F.col("source_id").alias("entity_id"), F.struct("relation_type", F.col("target_id").alias("other"), F.lit("out").alias("way")).alias("r"))
    ends = ends.unionByName(near.select(F.col("target_id").alias("entity_id"), F.struct("relation_type", F.col("source_id").alias("other"), F.lit("in").alias("way")).alias("r")))
    links = ends.groupBy("entity_id").agg(F.array_sort(F.collect_list("r")).alias("relations"))
    card = entities.join(names, "entity_id", "left").join(state, "entity_id", "left").join(links, "entity_id", "left")
    return card.select("entity_id", F.struct("entity_name", "entity_type", "aliases").alias("identity"), "state_chapter", "state", F.coalesce("relations", F.array().cast(links.schema["relations"].dataType)).alias("relations"))

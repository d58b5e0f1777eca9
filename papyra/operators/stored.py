"""The stored tables of a book: what an upsert of each may change, how extracted records are filled in, and their lifecycles.
All steps take whole tables, keyed by book, and give the next snapshot of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.upsert import new_keys, upsert

#: Each table's key, and the columns that an upsert of a known key takes over.
UPSERTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "novel_chapter": (("book_id", "file_name", "chapter_index_in_file"), ("chapter_title", "chapter_text", "char_offset_start", "char_offset_end", "scene_count")),
    "entity_snapshot": (("book_id", "entity_id", "chapter_index"), ("entity_name", "status_desc", "attributes")),
    "entity_relation": (("book_id", "source_entity_id", "target_entity_id", "relation_type", "start_chapter"), ("relation_desc", "relation_weight", "valid_period", "end_chapter", "surface_relation", "inner_relation", "relation_trend")),
    "timeline_event": (("event_id",), ("event_title", "event_content", "global_sort", "start_chapter", "end_chapter", "narrative_type", "plot_impact")),
    "timeline_event_entity": (("event_id", "entity_id"), ("role",)),
    "location_snapshot": (("book_id", "location_id", "chapter_index"), ("status_desc", "special_rules")),
    "foreshadowing": (("book_id", "foreshadowing_id"), ("title", "description", "status", "reveal_chapter", "foreshadowing_type", "concealment_level", "misleading_info")),
    "story_conflict": (("book_id", "conflict_id"), ("conflict_title", "current_status", "end_chapter")),
    "rule_check": (("book_id", "rule_id"), ("rule_name", "rule_content", "rule_type", "last_check_result")),
}
#: The state of a conflict that has ended, the role of those who take part in an event.
RESOLVED, PRESENT = "解决", "在场"


def upsert_table(name: str, target: DataFrame, source: DataFrame) -> DataFrame:
    """The table after the source. Of several source rows with one key, the one with the greatest values counts."""
    keys, update = UPSERTS[name]
    rest = [c for c in target.columns if c not in keys]
    once = source.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else source.select(*keys).distinct()
    return upsert(target, once.select(*target.columns), keys, update)


def hashed_id(prefix: str, *parts: Column | str) -> Column:
    """An id that depends on its parts only, so that a rerun gives the same."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20))


def registered_locations(locations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(location table, (book_id, location_name, location_id) of all names given). A name that the book knows keeps its id and
    widens its range of chapters; others come in, level 4 unless told. locations: book_id, chapter_index, location_name,
    location_level, description; known: location_id, location_name, location_level, description, book_id, first_chapter_index,
    last_chapter_index. Blank names are left out."""
    named = locations.withColumn("location_name", F.trim("location_name")).filter("location_name <> ''")
    first = lambda c: F.min_by(c, F.struct("chapter_index", "description", "location_level")).alias(c)
    seen = named.groupBy("book_id", "location_name").agg(
        first("location_level"), first("description"), F.min("chapter_index").alias("first_chapter_index"), F.max("chapter_index").alias("last_chapter_index")
    )
    old = known.groupBy("book_id", "location_name").agg(F.min("location_id").alias("location_id"))
    seen = seen.join(old, ["book_id", "location_name"], "left").withColumn("location_id", F.coalesce("location_id", hashed_id("loc", "book_id", "location_name")))
    before = known.select("location_id", F.col("first_chapter_index").alias("__a"), F.col("last_chapter_index").alias("__b"))
    ranged = seen.join(before, "location_id", "left").withColumns({
        "first_chapter_index": F.least("first_chapter_index", "__a"), "last_chapter_index": F.greatest("last_chapter_index", "__b"),
        "location_level": F.coalesce("location_level", F.lit(4)), "description": F.trim(F.coalesce("description", F.lit(""))),
    })
    table = upsert(known, ranged.select(*known.columns), ["location_id"], ["first_chapter_index", "last_chapter_index"])
    return table, seen.select("book_id", "location_name", "location_id")


def resolved_titles(events: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to register, (book_id, event_title, event_id) of all titles given): titles that the book knows keep their event;
    others get one, with level, title and book only, and 0 elsewhere. events: book_id, event_title, event_level; blank titles
    are left out."""
    titles = events.withColumn("event_title", F.trim("event_title")).filter("event_title <> ''")
    titles = titles.groupBy("book_id", "event_title").agg(F.min(F.coalesce("event_level", F.lit("event"))).alias("event_level"))
    ids = known.groupBy("book_id", "event_title").agg(F.min("event_id").alias("event_id"))
    fresh = new_keys(titles, ids, ["book_id", "event_title"]).withColumn("event_id", hashed_id("ev", "book_id", "event_title"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("global_sort", "start_chapter", "end_chapter")]
    every = titles.join(ids, ["book_id", "event_title"]).select("book_id", "event_title", "event_id").unionByName(fresh.select("book_id", "event_title", "event_id"))
    return fresh.select("event_id", "event_level", "event_title", "book_id", *zero), every


def _or(c: str, default: Column) -> Column:
    """The default for null and 0."""
    return F.when(F.coalesce(F.col(c), F.lit(0)) == 0, default).otherwise(F.col(c)).cast("long").alias(c)


def _text(c: str, default: str = "", to: str | None = None) -> Column:
    return F.coalesce(F.col(c), F.lit(default)).alias(to or c)


def filled_relations(relations: DataFrame) -> DataFrame:
    """Relations with both ends' ids (source_entity_id, target_entity_id) as rows of their table: a start that isn't told is
    the chapter, an end that isn't told 0 (goes on), and plain defaults. Rows with an end unknown are left out."""
    at = F.col("chapter_index")
    return relations.filter("source_entity_id is not null and target_entity_id is not null").select(
        hashed_id("rel", "book_id", "source_entity_id", "target_entity_id", "relation_type", at.cast("string")).alias("relation_id"), "book_id", "source_entity_id", "target_entity_id", "relation_type",
        _text("desc", to="relation_desc"), F.coalesce("weight", F.lit(2)).alias("relation_weight"), _text("valid_period", "temporary"), _text("surface_relation"), _text("inner_relation"), _text("relation_trend", "稳定"),
        _or("start_chapter", at), _or("end_chapter", F.lit(0)), "chapter_index",
    )


def filled_snapshots(snapshots: DataFrame) -> DataFrame:
    at = F.col("chapter_index").cast("string")
    return snapshots.filter("entity_id is not null").select(F.concat(F.lit("s_"), "entity_id", F.lit("_"), at).alias("snapshot_id"), "entity_id", "entity_name", _text("entity_type", "rule"), _text("status_desc"), _text("attributes", "{}"), "book_id", "chapter_index")


def filled_events(events: DataFrame) -> DataFrame:
    """Events with their event_id and parent_event_id; the sort key is made of chapter, scene and place in the scene."""
    at = F.col("chapter_index")
    sort = at.cast("long") * 100_000 + F.coalesce("scene", F.lit(0)) * 1000 + F.coalesce("global_sort", F.lit(0))
    return events.filter("event_id is not null").select(
        "event_id", _text("event_level", "event"), "parent_event_id", "event_title", _text("event_content"), _text("time_desc"), sort.alias("global_sort"), _text("narrative_type"), _text("plot_impact"),
        _or("start_chapter", at), _or("end_chapter", F.lit(0)), "book_id", "chapter_index",
    )


def filled_rules(rules: DataFrame) -> DataFrame:
    at = F.col("chapter_index")
    return rules.select(
        hashed_id("rul", "book_id", "rule_name").alias("rule_id"), "book_id", _text("rule_name"), _text("rule_type", "other"), _text("rule_content"), "subject_entity_id", _text("subject_ability"),
        _or("valid_from_chapter", at), _or("valid_to_chapter", F.lit(0)), "chapter_index",
    )


def filled_foreshadowings(items: DataFrame) -> DataFrame:
    at = F.col("chapter_index")
    return items.select(
        hashed_id("fs", "book_id", "title", at.cast("string")).alias("foreshadowing_id"), "book_id", _text("title"), _text("description"), _or("setup_chapter", at), "setup_event_id",
        F.coalesce("involved_entities", F.array().cast("array<string>")).alias("involved_entity_ids"), F.lit(None).cast("long").alias("reveal_chapter"), _text("status", "pending"), _text("foreshadowing_type"), "concealment_level", _text("misleading_info"), "chapter_index",
    )


def filled_conflicts(conflicts: DataFrame) -> DataFrame:
    """Conflicts as rows of their table, with the chapter that tells of them; an end that isn't told stays so."""
    return conflicts.select(
        hashed_id("cfl", "book_id", "conflict_title").alias("conflict_id"), "book_id", "conflict_title", _text("conflict_type", "对抗"), _text("conflict_desc"), _text("side_a"), _text("side_b"),
        _or("start_chapter", F.col("chapter_index")), "end_chapter", _text("current_status", "升级"), "chapter_index",
    )


def merged_rules(stored: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules by name: a known one takes the new content, type, subject and check and keeps its id and first chapter."""
    taken = ["rule_content", "rule_type", "subject_entity_id", "subject_ability", "last_check_result"]
    rest = [c for c in stored.columns if c not in ("book_id", "rule_name")]
    once = rules.groupBy("book_id", "rule_name").agg(F.max_by(F.struct(*rest), F.struct("valid_from_chapter", "rule_content")).alias("r")).select("book_id", "rule_name", "r.*")
    return upsert(stored, once.select(*stored.columns), ["book_id", "rule_name"], [c for c in taken if c in stored.columns])


def conflict_end(end: Column, status: Column, chapter: Column) -> Column:
    """Where a conflict ends: as told; else at the chapter that resolves it; else 0, which also opens an ended one again."""
    return F.coalesce(end, F.when(status == RESOLVED, chapter).otherwise(F.lit(0))).cast("long")


def merged_conflicts(stored: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflicts by title: a known one keeps its id and start. conflicts: as stored, with chapter_index; one row a title and
    chapter, of which the latest chapter counts."""
    rows = conflicts.withColumn("start_chapter", F.coalesce(F.nullif("start_chapter", F.lit(0)), "chapter_index"))
    ended = rows.withColumn("known_end", conflict_end(F.col("end_chapter"), F.col("current_status"), F.col("chapter_index")))
    rest = [c for c in stored.columns if c not in ("book_id", "conflict_title")]
    latest = ended.groupBy("book_id", "conflict_title").agg(F.max_by(F.struct(*rest, "known_end"), "chapter_index").alias("r"), F.min("start_chapter").alias("first"))
    latest = latest.select("book_id", "conflict_title", "r.*", "first").withColumn("start_chapter", F.col("first"))
    old = stored.select("book_id", "conflict_title", F.lit(True).alias("old"))
    latest = latest.join(old, ["book_id", "conflict_title"], "left").withColumn("end_chapter", F.when(F.col("old"), F.col("known_end")).otherwise(F.col("end_chapter")))
    return upsert(stored, latest.select(*stored.columns), ["book_id", "conflict_title"], ["current_status", "conflict_desc", "side_a", "side_b", "end_chapter"])


def consolidated(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, rows removed): of the open rows of a pair and type the earliest stays, with the latest row's description
    (unless empty) and weight. Ended rows stay as they are."""
    pair = ["book_id", "source_entity_id", "target_entity_id", "relation_type"]
    is_open = F.col("end_chapter") == 0
    place = Window.partitionBy(*pair, is_open).orderBy("start_chapter", "relation_id")
    every = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.struct("relation_desc", "relation_weight")).over(every)
    rows = relations.withColumns({"__nth": F.when(is_open, F.row_number().over(place)).otherwise(F.lit(1)), "__last": F.when(is_open, last)})
    stays = rows.filter("__nth = 1").withColumns({"relation_desc": F.coalesce(F.nullif("__last.relation_desc", F.lit("")), "relation_desc"), "relation_weight": F.coalesce("__last.relation_weight", "relation_weight")})
    return stays.select(*relations.columns), rows.filter("__nth > 1").select(*relations.columns)


def filled_ranges(table: DataFrame, key: str, seen: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``table`` with columns set to the least or greatest chapter of ``seen`` (key, chapter_index), where there is any.
    columns: name -> min or max."""
    of = {"min": F.min, "max": F.max}
    range_ = seen.groupBy(key).agg(*[of[how]("chapter_index").alias(f"__{c}") for c, how in columns.items()])
    rows = table.join(range_, key, "left")
    return rows.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def without_zero(table: DataFrame, column: str, to: Column | int) -> tuple[DataFrame, DataFrame]:
    """(the table with 0 in a column replaced, how many rows that concerns: what a dry run tells)."""
    zero = F.col(column) == 0
    value = to if isinstance(to, Column) else F.lit(to)
    return table.withColumn(column, F.when(zero, value).otherwise(F.col(column))), table.filter(zero).agg(F.count("*").alias("n"))


def conflict_ranges(conflicts: DataFrame, snapshots: DataFrame, taking_part: DataFrame) -> DataFrame:
    """Conflicts without a start (0 or null), or resolved without an end, from when their sides appear: the first snapshot of
    either, else the first event with one; the last snapshot. snapshots: book_id, entity_name, chapter_index; taking_part: the
    same. What can't be told stays."""
    sides = conflicts.select("conflict_id", "book_id", F.explode(F.array("side_a", "side_b")).alias("entity_name")).filter("entity_name <> ''").distinct()
    ranges = lambda df: df.groupBy("book_id", "entity_name").agg(F.min("chapter_index").alias("first"), F.max("chapter_index").alias("last"))
    by_conflict = lambda df, a, b: sides.join(ranges(df), ["book_id", "entity_name"]).groupBy("conflict_id", "book_id").agg(F.min("first").alias(a), F.max("last").alias(b))
    found = conflicts.join(by_conflict(snapshots, "s_first", "s_last"), ["conflict_id", "book_id"], "left").join(by_conflict(taking_part, "e_first", "e_last"), ["conflict_id", "book_id"], "left")
    no_start = F.coalesce("start_chapter", F.lit(0)) == 0
    no_end = F.col("end_chapter").isNull() & (F.col("current_status") == RESOLVED)
    return found.withColumns({
        "start_chapter": F.when(no_start, F.coalesce("s_first", "e_first", "start_chapter")).otherwise(F.col("start_chapter")),
        "end_chapter": F.when(no_end, F.col("s_last")).otherwise(F.col("end_chapter")),
    }).select(*conflicts.columns)


def book_ids(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_name, book_id, known): the id under which chunks of a book are stored, else a new one."""
    old = chunks.filter("book_id <> ''").groupBy("book_name").agg(F.min("book_id").alias("old"))
    found = wanted.select("book_name").distinct().join(old, "book_name", "left")
    return found.select("book_name", F.coalesce("old", hashed_id("book", "book_name")).alias("book_id"), F.col("old").isNotNull().alias("known"))


def updated_by_id(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a change of their key take its values where they aren't null; changes of unknown keys are dropped."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in columns]).dropDuplicates([key])
    rows = target.join(c, key, "left")
    return rows.select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in target.columns])

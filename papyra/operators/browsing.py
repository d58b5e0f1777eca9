"""What can be browsed of a book: ten types, each with its columns, order and filters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.relational import browse


class UnknownType(LookupError):
    """There is no such type to browse (an API answers 404)."""


@dataclass(frozen=True)
class Spec:
    """table; columns shown; order, each column with whether it goes down; parameter -> (kind of filter, columns); and a unique
    column that settles ties."""

    table: str
    columns: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]
    filters: Mapping[str, tuple[str, tuple[str, ...]]]
    unique: str


_REVIEW = ("confidence", "review_status")
#: The types, what they show, how they are ordered and filtered.
SPECS = {
    "entity": Spec("entity", ("entity_name", "entity_type", "first_chapter_index", "last_chapter_index", "is_active", "description", *_REVIEW), (("entity_name", False),), {"name": ("like", ("entity_name",)), "entity_type": ("eq", ("entity_type",)), "is_active": ("eq", ("is_active",))}, "entity_id"),
    "entity_snapshot": Spec("entity_snapshot", ("entity_name", "entity_type", "chapter_index", "status_desc", "attributes", *_REVIEW), (("chapter_index", True), ("entity_name", False)), {"entity_name": ("like", ("entity_name",)), "entity_type": ("eq", ("entity_type",)), "chapter_index": ("eq", ("chapter_index",))}, "snapshot_id"),
    "relation": Spec("entity_relation", ("relation_id", "source_name", "target_name", "relation_type", "valid_period", "start_chapter", "end_chapter", "relation_desc", "relation_weight", *_REVIEW), (("start_chapter", False), ("relation_type", False)), {"entity_name": ("like", ("source_name", "target_name")), "relation_type": ("eq", ("relation_type",)), "valid_period": ("eq", ("valid_period",)), "chapter_from": ("ge", ("start_chapter",)), "chapter_to": ("le", ("start_chapter",))}, "relation_id"),
    "timeline_event": Spec("timeline_event", ("event_id", "event_title", "event_level", "global_sort", "start_chapter", "end_chapter", "time_desc", *_REVIEW), (("global_sort", False),), {"event_level": ("eq", ("event_level",)), "title": ("like", ("event_title",)), "chapter_from": ("ge", ("start_chapter",)), "chapter_to": ("le", ("start_chapter",))}, "event_id"),
    "location": Spec("location", ("location_name", "location_level", "parent_location_id", "first_chapter_index", "last_chapter_index", "description", *_REVIEW), (("location_name", False),), {"name": ("like", ("location_name",)), "location_level": ("eq", ("location_level",))}, "location_id"),
    "foreshadowing": Spec("foreshadowing", ("foreshadowing_id", "title", "status", "setup_chapter", "reveal_chapter", "description", *_REVIEW), (("setup_chapter", False),), {"status": ("eq", ("status",)), "title": ("like", ("title",))}, "foreshadowing_id"),
    "conflict": Spec("story_conflict", ("conflict_id", "conflict_title", "conflict_type", "side_a", "side_b", "current_status", "start_chapter", "end_chapter", *_REVIEW), (("start_chapter", False),), {"title": ("like", ("conflict_title",)), "conflict_type": ("eq", ("conflict_type",)), "current_status": ("eq", ("current_status",))}, "conflict_id"),
    "rule": Spec("rule_check", ("rule_id", "rule_name", "rule_type", "subject_ability", "valid_from_chapter", "valid_to_chapter", "rule_content", *_REVIEW), (("valid_from_chapter", False),), {"name": ("like", ("rule_name",)), "rule_type": ("eq", ("rule_type",))}, "rule_id"),
    "alias": Spec("entity_alias", ("alias_name", "alias_type", "entity_id"), (("alias_name", False),), {"alias_name": ("like", ("alias_name",)), "alias_type": ("eq", ("alias_type",))}, "entity_id"),
    "validation": Spec("validation_issue", ("issue_id", "record_type", "issue_type", "severity", "status", "chapter_id", "chapter_title", "description"), (("issue_id", True),), {"status": ("eq", ("status",)), "severity": ("eq", ("severity",)), "issue_type": ("eq", ("issue_type",))}, "issue_id"),
}


def source(kind: str, tables: Mapping[str, DataFrame], book: str) -> DataFrame:
    """The rows of a book that a type is about: relations with both ends' names, issues with their chapter's title."""
    rows = tables[SPECS[kind].table].filter(F.col("book_id") == book)
    if kind == "relation":
        named = lambda end: tables["entity"].groupBy(F.col("entity_id").alias(f"{end}_entity_id")).agg(F.min("entity_name").alias(f"{end}_name"))
        return rows.join(named("source"), "source_entity_id", "left").join(named("target"), "target_entity_id", "left")
    if kind == "validation":
        return rows.join(tables["novel_chapter"].groupBy("chapter_id").agg(F.min("chapter_title").alias("chapter_title")), "chapter_id", "left")
    return rows


def browsed(kind: str, tables: Mapping[str, DataFrame], book: str, given: Mapping[str, object] | None = None, *, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(total, page) of a book's rows of a type. given: the type's filters, limit (20 unless told, at most 100) and offset; blank
    and unknown parameters filter nothing. Columns that a table doesn't have are null. ``UnknownType`` for other types. whole: all of a row's columns, and
    its place in the page as ``nth``."""
    if kind not in SPECS:
        raise UnknownType(kind)
    spec, given = SPECS[kind], given or {}
    rows = source(kind, tables, book)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in (*spec.columns, *(x for _, cs in spec.filters.values() for x in cs)) if c not in rows.columns})
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in spec.order]
    total, page = browse(rows, spec.filters, given, [*order, F.col(spec.unique).asc()], limit=given.get("limit"), offset=given.get("offset"))
    if whole:
        return total, page.withColumn("nth", F.row_number().over(Window.orderBy(*order, F.col(spec.unique).asc())))  # a page
    return total, page.select(*spec.columns)

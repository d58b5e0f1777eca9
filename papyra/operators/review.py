"""Issues that wait for a decision: who they are about, what supports them, what a decision writes back, and guards of jobs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.jsonx import string_leaves
from papyra.operators.relational import window_around
from papyra.operators.upsert import REVIEW, transition

#: The id of each table that an issue can be about.
REVIEWED = {
    "entity": "entity_id",
    "entity_snapshot": "snapshot_id",
    "entity_relation": "relation_id",
    "timeline_event": "event_id",
    "location": "location_id",
    "location_snapshot": "snapshot_id",
    "foreshadowing": "foreshadowing_id",
    "story_conflict": "conflict_id",
    "rule_check": "rule_id",
}


def confidences(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(record_type, target_id, book_id, confidence) of all tables' rows."""
    each = [df.select(F.lit(kind).alias("record_type"), F.col(REVIEWED[kind]).alias("target_id"), "book_id", F.col("confidence").cast("double").alias("confidence")) for kind, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def pending(issues: DataFrame, tables: Mapping[str, DataFrame], chapters: DataFrame) -> DataFrame:
    """Pending issues with their chapter's title and the confidence of the row that they are about: null without one."""
    open_ = issues.filter("status = 'pending'").join(chapters.select("chapter_id", "chapter_title"), "chapter_id", "left")
    return open_.join(confidences(tables), ["record_type", "target_id", "book_id"], "left").drop("target_id")


def summary(issues: DataFrame) -> DataFrame:
    return issues.filter("status = 'pending'").groupBy("book_id", "issue_type", "severity").agg(F.count("*").alias("n"))


def decided(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues after decisions (issue_id, decision, resolved_by, corrected): only allowed changes take effect, in ``changed``;
    a correction is kept as the suggested value of what is fixed."""
    rows = issues.join(decisions, "issue_id", "left")
    ok = reduce(lambda a, b: a | b, [(F.col("decision") == to) & transition(F.col("status"), to, REVIEW)[1] for to in ("confirmed", "fixed", "ignored")])
    ok = F.coalesce(ok, F.lit(False))
    fixed = ok & (F.col("decision") == "fixed") & F.col("corrected").isNotNull()
    out = rows.withColumns({"changed": ok, "__status": F.when(ok, F.col("decision")).otherwise(F.col("status")), "__value": F.when(fixed, F.col("corrected")).otherwise(F.col("suggested_value"))})
    keep = [F.col("__status").alias("status") if c == "status" else F.col("__value").alias("suggested_value") if c == "suggested_value" else F.col(c) for c in issues.columns]
    return out.select(*keep, "changed", F.when(ok, F.col("resolved_by")).alias("resolved_by"))


def written_back(kind: str, table: DataFrame, changed: DataFrame) -> DataFrame:
    """A table's rows after decisions: those that a changed issue is about have its status as review and full confidence.
    changed: rows of ``decided`` with changed set."""
    of = changed.filter((F.col("record_type") == kind) & F.col("changed") & F.col("target_id").isNotNull())
    of = of.groupBy(F.col("target_id").alias(REVIEWED[kind]), "book_id").agg(F.max("status").alias("__review"))
    rows = table.join(of, [REVIEWED[kind], "book_id"], "left")
    value = {"review_status": F.coalesce("__review", "review_status"), "confidence": F.when(F.col("__review").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence"))}
    return rows.select(*[value[c].alias(c) if c in value else F.col(c) for c in table.columns])


def correctable(issues: DataFrame, columns: Mapping[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows to store again for each type of record, refused issues with a reason): pending and confirmed issues whose value
    is a JSON object of a known type. columns: type -> DDL of its record."""
    open_ = F.col("status").isin("pending", "confirmed")
    known = F.col("record_type").isin(*columns)
    is_object = F.coalesce(F.ltrim("suggested_value").startswith("{") & F.try_parse_json("suggested_value").isNotNull(), F.lit(False))
    why = F.when(~open_, "not open").when(~known, "unknown type").when(~is_object, "not read")
    rows = issues.withColumn("reason", why)
    # A type's rows first: each type reads the issues, and only its own values are to be parsed.
    of = lambda kind: issues.filter((F.col("record_type") == kind) & F.coalesce(open_, F.lit(True))).filter(is_object)
    again = {kind: of(kind).select("issue_id", F.col("book_id"), F.from_json("suggested_value", ddl).alias("r")).select("issue_id", "book_id", "r.*") for kind, ddl in columns.items()}
    return again, rows.filter("reason is not null").select("issue_id", "record_type", "reason")


def _terms(description: str | None, suggested: str | None, original: str | None) -> list[str]:
    found = [description or ""]
    for v in (suggested, original):
        if v:
            try:
                found += string_leaves(json.loads(v))
            except ValueError:
                found.append(v)
    return sorted(dict.fromkeys(t for t in (s.strip() for s in found) if len(t) >= 2), key=len, reverse=True)


@F.arrow_udf(T.ArrayType(T.StringType()))
def terms_of(description: pa.Array, suggested: pa.Array, original: pa.Array) -> pa.Array:
    return pa.array([_terms(*v) for v in zip(description.to_pylist(), suggested.to_pylist(), original.to_pylist())], pa.list_(pa.string()))


def evidence(issues: DataFrame, chapters: DataFrame, width: int = 200) -> DataFrame:
    """(issue_id, term, window): where the chapter's text has the longest of an issue's terms (its description and the text
    leaves of its values, of two characters or more); no row for those without any."""
    rows = issues.join(chapters.select("chapter_id", "book_id", "chapter_text"), ["chapter_id", "book_id"])
    hit = F.try_element_at(F.filter(F.col("terms"), lambda t: F.contains("chapter_text", t)), F.lit(1))
    rows = rows.withColumn("terms", terms_of("description", "suggested_value", "original_value")).withColumn("term", hit).filter("term is not null")
    return rows.select("issue_id", "term", window_around(F.col("chapter_text"), F.expr("instr(chapter_text, term) - 1"), width).alias("window"))


def rerun_guard(chapters: Column, running: Column) -> Column:
    """Why a book can't be run again; null: it can."""
    return F.when(chapters == 0, "no chapters").when(running > 0, "running")


def restarted(states: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapter states, guard for each book): books without a running job have all their chapters set back to pending."""
    running = jobs.groupBy("book_id").agg(F.count_if(F.col("status") == "running").alias("running"))
    guard = states.groupBy("book_id").agg(F.count("*").alias("chapters")).join(running, "book_id", "full_outer")
    guard = guard.select("book_id", rerun_guard(F.coalesce("chapters", F.lit(0)), F.coalesce("running", F.lit(0))).alias("refused"))
    ok = guard.filter("refused is null").select("book_id", F.lit(True).alias("__ok"))
    rows = states.join(ok, "book_id", "left")
    new = {"status": F.when(F.col("__ok"), "pending").otherwise(F.col("status")), "retry_count": F.when(F.col("__ok"), 0).otherwise(F.col("retry_count")), "shrink_level": F.when(F.col("__ok"), 0).otherwise(F.col("shrink_level"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in states.columns]), guard


def retried(states: DataFrame, busy: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chapter states, reset chapters by book): failed chapters (of the chosen ids only, if given) of books that aren't busy go
    back to pending, one more retry, without shrinking."""
    rows = states.join(busy.select("book_id").distinct().withColumn("__busy", F.lit(True)), "book_id", "left")
    if chosen is not None:
        rows = rows.join(chosen.select("chapter_id").distinct().withColumn("__chosen", F.lit(True)), "chapter_id", "left")
    take = F.col("__busy").isNull() & (F.col("status") == "failed") & (F.col("__chosen").isNotNull() if chosen is not None else F.lit(True))
    rows = rows.withColumn("__take", take)
    new = {"status": F.when(F.col("__take"), "pending").otherwise(F.col("status")), "retry_count": F.col("retry_count") + F.col("__take").cast("int"), "shrink_level": F.when(F.col("__take"), 0).otherwise(F.col("shrink_level"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in states.columns]), rows.groupBy("book_id").agg(F.count_if("__take").alias("reset"))


def group_status(documents: DataFrame, named: DataFrame, status: str) -> DataFrame:
    """Files still processing whose (user_id, file_name) is named take the status."""
    rows = documents.join(named.select("user_id", "file_name").distinct().withColumn("__named", F.lit(True)), ["user_id", "file_name"], "left")
    new = F.when(F.col("__named") & (F.col("status") == "processing"), status).otherwise(F.col("status"))
    return rows.select(*[new.alias("status") if c == "status" else F.col(c) for c in documents.columns])


def uploaded(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, files that are dropped): a processing file with chunks is ready, with their number; one without is dropped."""
    n = chunks.groupBy("user_id", "file_name").agg(F.count("*").alias("__n"))
    rows = documents.join(n, ["user_id", "file_name"], "left")
    busy = F.col("status") == "processing"
    gone = busy & F.col("__n").isNull()
    new = {"status": F.when(busy, "ready").otherwise(F.col("status")), "chunk_count": F.when(busy, F.col("__n")).otherwise(F.col("chunk_count"))}
    return rows.filter(~gone).select(*[new[c].alias(c) if c in new else F.col(c) for c in documents.columns]), rows.filter(gone).select("user_id", "file_name")


def upload_refusal(name: Column, size: Column, extensions: tuple[str, ...] = ("txt", "md", "pdf")) -> Column:
    """Why a file isn't taken; null: it is."""
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "no name").when(~F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)).isin(*extensions), "extension").when(F.coalesce(size, F.lit(0)) == 0, "empty")


FEEDBACK_TEXT = 500


def with_feedback(messages: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, codes): feedback (id, user_id, feedback, feedback_text) overwrites what a message had: 404 without such a
    message, 403 for another user's, 400 for a value that isn't up or down or a text that is too long, else 200; the first
    that holds counts. Of several for a message, the one with the greatest values is taken. An empty text is none."""
    own = messages.select("id", F.col("user_id").alias("__owner"))
    rows = asked.join(own, "id", "left")
    wrong = ~F.coalesce(F.col("feedback").isin("up", "down"), F.lit(False)) | (F.coalesce(F.length("feedback_text"), F.lit(0)) > FEEDBACK_TEXT)
    code = F.when(F.col("__owner").isNull(), 404).when(F.col("__owner") != F.col("user_id"), 403).when(wrong, 400).otherwise(200)
    rows = rows.withColumn("code", code)
    taken = rows.filter("code = 200").groupBy("id").agg(F.max(F.struct("feedback", "feedback_text")).alias("__f"))
    out = messages.join(taken, "id", "left")
    new = {"feedback": F.coalesce("__f.feedback", "feedback"), "feedback_text": F.when(F.col("__f").isNotNull(), F.nullif("__f.feedback_text", F.lit(""))).otherwise(F.col("feedback_text"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in messages.columns]), rows.drop("__owner")

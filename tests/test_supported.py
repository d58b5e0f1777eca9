from pyspark.sql import functions as F

from papyra.operators import checks as ck

PAIR = "book_id string, chapter_index long, entity_name string"
EVENT = "book_id string, chapter_index long, event_content string, involved_entities array<string>"


def test_names_in_contents_as_by_brute_force(spark):
    names = ["Ann", "Anna", "ann", "字", "😀b", "b", "", None, " x ", "nobody", "Annabel"]
    pairs = [(b, c, n) for b in ("p", "q") for c in (1, 2) for n in names]
    events = [("p", 1, "Hannah saw Annabe 字", []), ("p", 2, "😀b", ["nobody", "Ann"]), ("q", 1, "a x b", None), ("q", 1, "", []), ("q", 2, None, ["ann"]), ("p", 1, "Ann", [])]
    want = {(b, c, n) for b, c, n in pairs if n for eb, ec, text, part in events if (b, c) == (eb, ec) and (n in (part or []) or n in (text or ""))}
    got = [tuple(r) for r in ck.supported(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(events, EVENT)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_event_meets_every_name_of_its_chapter(spark):
    """Names and events of one chapter: as many rows as pieces of contents, not names times events."""
    pairs = spark.range(3000).select(F.lit("b").alias("book_id"), F.lit(1).cast("long").alias("chapter_index"), F.format_string("name %05d", "id").alias("entity_name"))
    events = spark.range(3000).select("*", F.lit("b").alias("book_id"), F.lit(1).cast("long").alias("chapter_index"), F.format_string("of name %05d", F.col("id") * 2).alias("event_content"), F.array().cast("array<string>").alias("involved_entities"))
    found = ck.supported(pairs, events)
    assert found.count() == 1500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "contains(" not in plan.lower()

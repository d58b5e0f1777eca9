import pytest
from pyspark.sql import functions as F

from papyra.operators import persist as ps
from papyra.operators.review import correctable
from papyra.plans import persisting as pl
from papyra.plans.story_tables import story
from papyra.sources.versioned import Conflict, Versioned

SF = "/root/testdata/sf0.001"


def keep(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def small(spark):
    """The test tables, cut to some tens of rows."""
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "part", "orders", "documents", "lineitem")}
    tables["customer"] = tables["customer"].filter("c_custkey <= 40")
    tables["orders"] = tables["orders"].filter("o_custkey <= 40 and o_orderkey <= 120")
    tables["part"] = tables["part"].filter("p_partkey <= 40")
    return tables.__getitem__


@pytest.fixture
def store(spark, small, tmp_path):
    s = Versioned(spark, str(tmp_path / "book"))
    tables = {n: story(small, n) for n in pl.STORED}
    tables["validation_issue"] = spark.createDataFrame([], "issue_id string, book_id string, chapter_id string, chapter_index long, record_type string, issue_type string, severity string, status string, description string, original_value string, suggested_value string, target_id string, resolved_by string")
    tables["persist_outcome"] = spark.createDataFrame([], "batch string, book_id string, chapter_index long, record_type string, stored long, set_aside long")
    s.commit(tables, expected=0)
    return s


def chapters(t):
    return pl.chapters(t).withColumn("chapter_id", F.concat(F.lit("nch_"), "book_id"))


def test_a_batch_becomes_one_version_with_its_rejects(small, store):
    version, outcome = ps.persist(store, pl.batch(small), chapters(small), "chapter 41", keep)
    assert version == 2 and store.versions() == [1, 2]
    issues = store.read("validation_issue")
    assert {r.issue_type for r in issues.select("issue_type").distinct().collect()} == {"unsupported_change", "persist_error", "rule_violation", "state_jump", "timeline_paradox"}
    assert issues.filter("status <> 'pending' or chapter_id is null").isEmpty() and issues.select("issue_id").distinct().count() == issues.count()
    assert rows(outcome.select("book_id", "record_type", "stored", "set_aside")) == rows(store.read("persist_outcome").select("book_id", "record_type", "stored", "set_aside"))
    # A second run changes nothing; the first version is still there as it was.
    assert ps.persist(store, pl.batch(small), chapters(small), "chapter 41", keep) == (2, None)
    assert store.versions() == [1, 2] and rows(store.read("entity", 1)) == rows(story(small, "entity"))


def test_a_failure_before_publishing_leaves_the_version_readable(small, store):
    bad = dict(pl.batch(small))
    bad["rule_checks"] = bad["rule_checks"].withColumn("rule_content", F.raise_error(F.lit("lost")).cast("string"))
    before = rows(store.read("rule_check"))
    with pytest.raises(Exception, match="lost"):
        ps.persist(store, bad, chapters(small), "chapter 41", lambda df: df)
    assert store.version() == 1 and rows(store.read("rule_check")) == before
    assert store.committed("chapter 41") is None
    gone = store.vacuum()
    assert gone and rows(store.read("rule_check")) == before


def test_of_two_commits_from_one_version_one_wins(spark, tmp_path):
    s = Versioned(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "x long")
    assert s.commit({"a": one, "b": one}, expected=0, batch="first") == 1
    assert s.commit({"a": one.withColumn("x", F.lit(2).cast("long"))}, expected=1, batch="second") == 2
    with pytest.raises(Conflict):
        s.commit({"a": one.withColumn("x", F.lit(3).cast("long"))}, expected=1, batch="third")
    assert s.version() == 2 and s.read("a").first().x == 2 and s.read("b").first().x == 1 and s.read("a", 1).first().x == 1
    assert (s.committed("first"), s.committed("second"), s.committed("third")) == (1, 2, None)
    assert s.commit({}, expected=2, batch="second") == 2
    assert len(s.vacuum(keep=1)) == 2 and s.versions() == [2] and s.read("b").first().x == 1
    assert Versioned(spark, str(tmp_path / "none")).version() == 0


def test_relations_of_a_chapter_are_stored_together_or_not(spark):
    base = "book_id string, chapter_index long, relation_id string, source_entity_id string, target_entity_id string, relation_type string, relation_weight int, valid_period string, start_chapter long, end_chapter long, relation_desc string"
    row = ("b", 3, "r", "x", "y", "family", 2, "temporary", 3, 0, "")
    df = spark.createDataFrame([row, (*row[:10], "z" * 501), ("c", *row[1:]), ("d", *row[1:7], "sometimes", *row[8:])], base)
    good, bad = ps.storable("entity_relation", df)
    assert [r.book_id for r in good.collect()] == ["c"]
    assert sorted((r.book_id, r.issue_type, r.description) for r in bad.collect()) == [("b", "persist_error", "can't be stored: relation_desc has more than 500 characters"), ("d", "persist_error", "can't be stored: valid_period can't be sometimes")]


def test_aliases_keep_their_digits(spark):
    known = spark.createDataFrame([], "entity_id string, entity_name string, entity_type string, description string, book_id string, first_chapter_index long, last_chapter_index long, is_active int")
    aliases = spark.createDataFrame([("e1", "old 100", "nickname", "b")], "entity_id string, alias_name string, alias_type string, book_id string")
    new = spark.createDataFrame([("b", 4, "N", "human", "", ["A 100", " B 1 "]), ("b", 4, "M", "human", "", ["old 100"])], "book_id string, chapter_index long, entity_name string, entity_type string, description string, aliases array<string>")
    table, grown, ids = ps.registered_entities(new, known, aliases)
    assert sorted(r.alias_name for r in grown.collect()) == ["A 100", "B 1", "N", "old 100"]
    assert {r.name: r.id for r in ids.collect()}["M"] == "e1" and table.count() == 2


def test_issues_stored_again(small, store, spark):
    asked = pl.issues(small).withColumns({c: F.lit(None).cast("string") for c in ("chapter_id", "issue_type", "severity", "description", "original_value", "target_id", "resolved_by")}).withColumn("chapter_index", F.lit(1).cast("long"))
    store.commit({"validation_issue": asked.select(*store.read("validation_issue").columns)}, expected=1)
    chosen = spark.createDataFrame([("vis_000000003", None), ("vis_000000007", '{"rule_name": "told", "rule_content": "x"}'), ("vis_none", None)], "issue_id string, corrected string")
    version, totals = ps.repersist(store, chosen, "fix", keep)
    assert version == 3 and ps.repersist(store, chosen, "fix", keep) == (3, None)
    after = {r.issue_id: r for r in store.read("validation_issue").collect()}
    before = {r.issue_id: r for r in store.read("validation_issue", 2).collect()}
    fixed = [i for i in after if after[i].status == "fixed"]
    assert set(fixed) <= {"vis_000000003", "vis_000000007"} and sum(r.succeeded for r in totals.collect()) == len(fixed) and sum(r.total for r in totals.collect()) == len({"vis_000000003", "vis_000000007"} & set(before))
    assert all(after[i].resolved_by == "repersist" for i in fixed) and all(after[i] == before[i] for i in after if i not in fixed)
    assert all(before[i].status in ("pending", "confirmed") for i in fixed)


def test_a_place_is_corrected_in_its_own_book(spark, small):
    tables = {n: story(small, n) for n in pl.STORED}
    row = tables["location_snapshot"].limit(1).select(F.lit("sl_x").alias("snapshot_id"), F.lit("loc_x").alias("location_id"), F.lit("book_0").alias("book_id"), F.lit(7).cast("long").alias("chapter_index"), F.lit("shut").alias("status_desc"), F.lit("none").alias("special_rules"))
    tables["location_snapshot"] = spark.createDataFrame(row.collect(), tables["location_snapshot"].schema)
    value = '{"location_id": "loc_%s", "status_desc": "open", "chapter_index": 7}'
    issues = spark.createDataFrame([(f"vis_00000000{i}", f"book_{b}", "location_snapshot", "pending", value % p) for i, b, p in ((1, 3, "x"), (2, 3, "y"))], "issue_id string, book_id string, record_type string, status string, suggested_value string")
    out = ps.repersisted(issues, tables)
    assert sorted((r.location_id, r.book_id, r.status_desc) for r in out.tables["location_snapshot"].collect()) == [("loc_x", "book_0", "open"), ("loc_y", "book_3", "open")]


def test_only_a_types_own_values_are_parsed(spark):
    rows = [("1", "b", "entity", "pending", '{"name": "x"}'), ("2", "b", "entity", None, ' {"name": "y"}'), ("3", "b", "entity", "ignored", '{"name": "z"}'), ("4", "b", "rule_check", "confirmed", "[1"), ("5", "b", None, "pending", "{}"), ("6", "b", "entity", "pending", None), ("7", "b", "other", "pending", "{}")]
    again, refused = correctable(spark.createDataFrame(rows, "issue_id string, book_id string, record_type string, status string, suggested_value string"), {"entity": "name string", "rule_check": "rule_name string"})
    assert sorted((r.issue_id, r.name) for r in again["entity"].collect()) == [("1", "x"), ("2", "y")] and again["rule_check"].isEmpty()
    assert sorted((r.issue_id, r.reason) for r in refused.collect()) == [("3", "not open"), ("4", "not read"), ("6", "not read"), ("7", "unknown type")]
    plan = again["entity"]._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line).lower()
    assert "parse" in condition and condition.index("= entity") < condition.index("parse")


@pytest.fixture
def shuffled(spark):
    """Joins by shuffles of 16 partitions, as large tables have them."""
    was = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in was}
    for k, v in was.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rows_that_refer_to_nothing_are_not_one_key(shuffled):
    events = shuffled.range(4000).select(F.lit("b").alias("book_id"), F.lit(1).cast("long").alias("chapter_index"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_title"),
                                         F.expr("CASE WHEN id % 40 = 0 THEN 'e7' WHEN id % 40 = 1 THEN 'lost' WHEN id % 40 = 2 THEN NULL ELSE '' END").alias("parent_title"))
    ids = events.select("book_id", F.col("event_title").alias("name"), F.concat(F.lit("id "), "event_title").alias("id"))
    good, bad = ps.ck.referred("timeline_events", events, {"event": ids.select("book_id", "name")})
    there = [r["count"] for r in good.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(there) == 3900 and max(there) < 800
    assert bad.count() == 100 and {r.description for r in bad.collect()} == {"unknown parent lost"}
    found = ps.with_id(good, ids, "parent_title", "parent_id", told_by="event_title")
    there = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(there) == 3900 and max(there) < 800
    assert {(r.parent_title, r.parent_id) for r in found.select("parent_title", "parent_id").distinct().collect()} == {("e7", "id e7"), ("", None), (None, None)}
    assert set(found.columns) == {*events.columns, "parent_id"}

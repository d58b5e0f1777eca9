import pytest

from papyra.operators import browsing as br
from papyra.operators import narrative as nv
from papyra.plans.story_tables import story

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    t = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    return {s.table: story(t, s.table) for s in br.SPECS.values()} | {"novel_chapter": story(t, "novel_chapter")}


@pytest.mark.parametrize("kind", sorted(br.SPECS))
def test_every_type_is_browsed(tables, kind):
    total, page = br.browsed(kind, tables, "book_1", {"limit": 7, "offset": 2})
    spec = br.SPECS[kind]
    n = tables[spec.table].filter("book_id = 'book_1'").count()
    rows = page.collect()
    assert page.columns == list(spec.columns) and total.first().total == n and len(rows) == min(7, max(n - 2, 0))
    first = [r[spec.order[0][0]] for r in rows]
    assert first == sorted(first, reverse=spec.order[0][1])


def test_filters_and_unknown_types(tables):
    total, page = br.browsed("relation", tables, "book_1", {"entity_name": "Customer#00000000", "relation_type": "", "chapter_from": 5, "chapter_to": 9, "nonsense": 3, "limit": "x"})
    rows = page.collect()
    assert rows and total.first().total >= len(rows) and all(5 <= r.start_chapter <= 9 and ("Customer#00000000" in (r.source_name or "") or "Customer#00000000" in (r.target_name or "")) for r in rows)
    assert br.browsed("conflict", tables, "book_1", {"conflict_type": "none"})[0].first().total == 0
    with pytest.raises(br.UnknownType):
        br.browsed("chapter", tables, "book_1")


def test_all_kinds_of_a_chapter_are_merged(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    at = "book string, chapter long, scene long, ord long"
    df = lambda columns, *rows: spark.createDataFrame([("b", 1, i // 2, i % 2, *r) for i, r in enumerate(rows)], f"{at}, {columns}")
    none = lambda columns: spark.createDataFrame([], f"{at}, {columns}")
    records = {
        "entities": df("name string, aliases array<string>, type string, description string, source_fragment string", ("Li", ["Old Li"], "human", "d", ""), ("Old Li", [], "human", "", ""), ("Sword", None, "item", "", "")),
        "relations": df("source string, target string, relation_type string, desc string", ("Li", "Sword", "possess", "first"), ("Old Li", "Sword", "possess", "second"), ("Old Li", "nobody", "enmity", "x")),
        "timeline_events": df("event_level string, event_title string, involved_entities array<string>", ("event", "Duel", ["Old Li", "nobody", "Li"]), ("event", "Duel", ["Sword"]), ("stage", "Duel", None)),
        "entity_snapshots": df("entity_name string, status_desc string", ("Old Li", "hurt")),
        "locations": df("name string", ("Old Li",)),
        "foreshadowings": df("title string, involved_entities array<string>", ("hint", ["Old Li"])),
        "conflicts": df("conflict_title string, side_a string, side_b string", ("war", "Old Li", "them")),
        "rule_checks": none("rule_name string, subject_entity_name string"),
    }
    out = nv.merged_chapters(records, lambda d: d.checkpoint())
    assert set(out) == set(nv.CHANNELS)
    assert sorted((r.name, tuple(r.aliases)) for r in out["entities"].collect()) == [("Li", ("Old Li",)), ("Sword", ())]
    assert sorted((r.source, r.target, r.desc) for r in out["relations"].collect()) == [("Li", "Sword", "first"), ("Li", "nobody", "x")]
    assert sorted((r.event_level, r.involved_entities) for r in out["timeline_events"].collect()) == [("event", ["Li", "nobody", "Li"]), ("stage", None)]
    assert [r.entity_name for r in out["entity_snapshots"].collect()] == ["Li"] and [r.name for r in out["locations"].collect()] == ["Old Li"]
    assert [r.involved_entities for r in out["foreshadowings"].collect()] == [["Li"]] and [(r.side_a, r.side_b) for r in out["conflicts"].collect()] == [("Li", "them")]
    assert out["rule_checks"].count() == 0 and out["relations"].columns == records["relations"].columns

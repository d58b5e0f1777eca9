import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.functions import html, jsonx, split
from papyra.operators import graph
from papyra.operators import relational as r
from papyra.operators import temporal as tm
from papyra.operators import upsert as up
from papyra.sources import loader


def test_page_bounds():
    assert [r.page_bounds(*a) for a in ((None, None), (0, -3), (500, 7), ("x", 1), ("5", "2"))] == [(20, 0), (20, 0), (100, 7), (20, 0), (5, 2)]


def fold(observed):
    """Relation intervals, a chapter at a time."""
    rows: list[list] = []
    for chapter in sorted({o[3] for o in observed}):
        now = [o for o in observed if o[3] == chapter]
        for pair in sorted({o[:2] for o in now}):
            kinds = {o[2] for o in now if o[:2] == pair}
            for x in rows:
                if tuple(x[:2]) == pair and x[4] == 0 and x[2] not in kinds:
                    x[4] = max(chapter - 1, 0)
            open_ = {x[2] for x in rows if tuple(x[:2]) == pair and x[4] == 0}
            rows += [[*pair, k, chapter, 0] for k in sorted(kinds - open_)]
    return sorted(map(tuple, rows))


def observations(seed):
    g = random.Random(seed)
    return sorted({(g.randrange(3), g.randrange(2), g.choice("abc"), g.randrange(1, 12)) for _ in range(60)})


@pytest.mark.parametrize("seed", range(3))
def test_relation_lifecycle_batch_and_steps(spark, seed):
    seen = observations(seed)
    df = spark.createDataFrame(seen, "source long, target long, kind string, chapter long")
    want = fold(seen)
    got = tm.relation_intervals(df, ["source", "target"], "kind", "chapter").select("source", "target", "kind", "start_chapter", "end_chapter")
    assert sorted(map(tuple, got.collect())) == want
    stored = spark.createDataFrame([], "source long, target long, kind string, start_chapter long, end_chapter long, note string")
    for n in sorted({s[3] for s in seen})[:4]:
        now = spark.createDataFrame([(*s[:3], f"n{n}") for s in seen if s[3] == n], "source long, target long, kind string, note string")
        rows = [tuple(x) for x in tm.merge_relations(stored, now, n, ["source", "target"], "kind", ["note"]).select(*stored.columns).collect()]
        stored = spark.createDataFrame(rows, stored.schema)
    first = [s for s in seen if s[3] in sorted({s[3] for s in seen})[:4]]
    assert sorted(x[:5] for x in rows) == fold(first)


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, v double")
    b = spark.createDataFrame([(2, "x", 9.0), (3, "c", 3.0)], "id long, name string, v double")
    once = up.upsert(a, b, ["id"], ["v"])
    want = [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, up.upsert(once, b, ["id"], ["v"]).collect()))


def test_as_of_rows_strict_or_not(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "key string, at long")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 9, "z")], "key string, at long, v string")
    get = lambda strict: sorted((x.key, x.at, x.asof_v) for x in tm.as_of_rows(left, right, "key", "at", "v", strict=strict).collect())
    assert get(False) == [("a", 1, "x"), ("a", 5, "y"), ("b", 3, None)]
    assert sorted(get(True), key=str) == sorted([("a", 1, None), ("a", 5, "x"), ("b", 3, None)], key=str)
    later = right.unionByName(spark.createDataFrame([("a", 4, None)], right.schema))
    assert [(x.asof_at, x.asof_v) for x in tm.as_of_rows(left, later, "key", "at", "v", strict=True).collect() if x.key == "a" and x.at == 5] == [(4, None)]


def test_one_hop_stops_before_an_edge_too_many(spark):
    star = [(0, i, "k", 1, 0) for i in range(1, 131)]
    nodes, edges = graph.one_hop(spark.createDataFrame(star, "source long, target long, kind string, start_chapter long, end_chapter long"), 0, 5)
    assert (nodes.count(), edges.count()) == (100, 99)
    same = [(0, 1, f"k{i:03}", 1, 0) for i in range(130)]
    nodes, edges = graph.one_hop(spark.createDataFrame(same, "source long, target long, kind string, start_chapter long, end_chapter long"), 0, 5)
    assert (nodes.count(), edges.count()) == (2, 100)
    assert graph.root_of(nodes.filter("node > 0"), 0).first().node == 1 and graph.root_of(nodes, 0).first().node == 0 and graph.root_of(nodes.limit(0), 7).first().node == 7


def test_rows_are_numbered_across_ranges(spark):
    df = spark.createDataFrame([(k, i * 3) for k in "ab" for i in range(50)], "k string, i long")
    assert sorted((x.k, x.i, x.n) for x in r.numbered(df, "k", "i", 7).collect()) == [(k, i * 3, i + 1) for k in "ab" for i in range(50)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="甲乙。！，\n ab", max_size=900), st.integers(20, 80))
def test_chunks_are_short_and_in_order(text, size):
    parts = split.chunks(text, size, size // 4)
    assert all(0 < len(p) <= size for p in parts)
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - size))
        assert found >= 0
        at = found + 1
    if text.strip():
        assert parts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。\n", max_size=400), st.integers(5, 60))
def test_scenes_keep_all_words(text, limit):
    parts = split.scenes(text, limit)
    assert all(len(p) <= limit for p in parts)
    keep = lambda s: "".join(s.split())
    assert keep("".join(parts)) == keep(text)


def test_chapters_and_markdown():
    text = "序\n\n　第一章 甲\n  内容。\n\n第二回 乙 \n更多。"
    got = split.chapters(text, "f")
    assert [(c["title"], text[c["start"] : c["end"]].strip() == c["text"]) for c in got] == [("第一章 甲", True), ("第二回 乙", True)]
    assert split.chapters("plain", "f") == [{"title": "f", "text": "plain", "start": 0, "end": 5}]
    md = "intro\n\n# A\ntext\n\n```py\n# no\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## B\n\nend\n"
    assert [b["type"] for b in split.blocks(md)] == ["text", "heading", "text", "code", "table", "text", "heading", "text"]
    assert [c["title"] for c in split.markdown_chapters(md, "f")] == [split.UNTITLED, "A", "B"]
    assert [(c["type"], c["path"]) for c in split.markdown_chunks(md)] == [("text", ""), ("text", "A"), ("code", "A"), ("table", "A"), ("text", "A > B")]
    table = "| h |\n|---|\n" + "\n".join(f"| row {i} |" for i in range(40))
    assert all(p.startswith("| h |\n|---|\n| row") and len(p) <= 100 for p in split.table_parts(table, 100))
    assert split.table_parts("", 9) == [] and split.table_parts("| h |\n|-|", 3) == ["| h |\n|-|"] and split.by_lines("", 5) == [""]
    assert [(c["title"], c["chunk_index"], c["chunk_total"]) for c in split.by_type(md, ".md", "f")] == [("", 0, 5), ("A", 1, 5), ("A", 2, 5), ("A", 3, 5), ("A > B", 4, 5)]
    assert [(c["title"], c["text"]) for c in split.by_type("plain", ".md", "f")] == [("f", "plain")] and split.by_type(text, ".txt", "f")[1]["title"] == "第二回 乙"
    assert split.by_lines("a\n" + "x" * 25 + "\nb", 10) == ["a", "x" * 10, "x" * 10, "x" * 5, "b"]


def test_json_from_answers():
    assert jsonx.recovered('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert jsonx.recovered('so {"a": "}"} or {"bb": [1, 2], "c": "{"} ok') == '{"bb": [1, 2], "c": "{"}'
    assert jsonx.recovered('[{"n": 1}, {"n": 2}]', "items") == '{"items": [{"n": 1}, {"n": 2}]}'
    assert jsonx.recovered('[{"items": []}]', "items") == '{"items": []}'
    assert jsonx.recovered("none") is None and jsonx.recovered(None) is None and jsonx.recovered("[1, 2]") is None
    assert jsonx.string_leaves({"a": ["x", {"b": "y"}], "c": 1}) == ["x", "y"]


def test_pages():
    page = html.read('<title>T</title><h1> H </h1><ul class="x fen_4"><a href="/1">第一章 甲</a><a href="/2">about</a><a href="/3">番外</a></ul><div id="txt">一<br>二 biquge<br/>三 <b>四</b><p>五</p></div>')
    assert page == {"title": "H", "links": [{"title": "第一章 甲", "url": "/1", "kind": "chapter"}, {"title": "番外", "url": "/3", "kind": "extra"}], "text": "一\n\n三\n\n四\n\n五"}
    assert html.read("") == {"title": "untitled", "links": None, "text": None}
    assert html.read('<meta property="og:title" content=" O "><title>T</title>')["title"] == "O"


def test_loader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  first line here\n\n\n\nsecond　\n", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("# 标题\n这是一个足够长的中文段落。".encode("gb18030"))
    (tmp_path / "short.txt").write_text("tiny")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / ".hidden.txt").write_text("hidden but long enough")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "c.txt").write_text("skipped but long enough")
    docs, failed = loader.load(spark, [str(tmp_path), f"{tmp_path}/a.txt", str(tmp_path), f"{tmp_path}/none"], skip=["skip"])
    assert docs.count() == 2 and sorted((x.encoding.replace("_", "-"), x.content_length) for x in docs.collect()) == [("gb18030", 18), ("utf-8", 23)]
    got = {x.file_name: x.text for x in docs.collect()}
    assert set(got) == {"a.txt", "b.md"} and got["a.txt"] == "first line here\n\nsecond"
    assert sorted(x.reason for x in failed.collect()) == ["missing", "too short"]
    (tmp_path / ".kept").mkdir()
    (tmp_path / ".kept" / "d.txt").write_text("below a hidden folder that was asked for")
    assert loader.load(spark, f"{tmp_path}/.kept")[0].count() == 1 and loader.load(spark, f"{tmp_path}/none")[0].count() == 0
    parts, _ = loader.load_and_split(spark, str(tmp_path), skip=["skip"])
    assert sorted((x.file_name, x.title, x.chunk_index, x.chunk_total) for x in parts.collect()) == [("a.txt", "a.txt", 0, 1), ("b.md", "标题", 0, 1)]
    table = f"{tmp_path}/table"
    schema = spark.createDataFrame([], "a long").schema
    assert [loader.ensured(spark, table, s) for s in (schema, schema, docs.schema)] == ["created", "kept", "rebuilt"]
    assert loader.schema_differs(docs.select("text"), spark.createDataFrame([], "text long, more int").schema) == ["missing more", "text is string, not bigint"]
    loader.save(docs.selectExpr("file_name as title", "text"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() > 0

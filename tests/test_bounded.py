"""What a task holds at once doesn't grow with its batch."""

import pyarrow as pa
import pytest

from papyra.functions import split
from papyra.operators import agents as ag
from papyra.operators import terms as tm


def test_records_are_passed_on_by_some_thousand(spark):
    seen = spark.range(30).selectExpr("'b' as book_id", "id as chapter_index", "0L as scene", "if(id = 7, '', repeat('w ', 999)) as text", "0 as level", "array() as names").coalesce(1)
    kinds = ag.Extractors()

    def words(text, level, names):
        if not text:
            raise ValueError("no word")
        return [{"name": w} for w in text.split()]

    kinds.register("entity", words)
    good, bad = ag.extracted(seen.withColumn("names", seen.names.cast("array<string>")), "entity", kinds)
    batches = good.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r.n for r in batches) == 29 * 999 and max(r.n for r in batches) <= ag.RECORDS
    assert [(r.chapter_index, r.error) for r in bad.collect()] == [(7, "ValueError: no word")]
    assert good.groupBy("chapter_index").agg({"ord": "max"}).filter("`max(ord)` <> 998").isEmpty()


@pytest.mark.parametrize("n", [0, 1, split.TEXTS, 2 * split.TEXTS + 1])
def test_texts_are_split_some_at_a_time(spark, n):
    texts = ["# a\n\n" + f"word {i} " * (i * 40) if i % 5 else None for i in range(n)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.c for r in d.select("id", split.markdown_chunks_of(d.text).alias("c")).collect()}
    assert {i: c and [x.asDict() for x in c] for i, c in got.items()} == {i: None if t is None else split.markdown_chunks(t) for i, t in enumerate(texts)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_hits_are_found_some_texts_at_a_time(monkeypatch):
    held = []
    of = tm._found_of
    monkeypatch.setattr(tm, "_found_of", lambda f, b, t: held.append(b.num_rows) or of(f, b, t))
    n = 2 * tm.TEXTS + 3
    batch = pa.table({"key": pa.array([{"id": i} for i in range(n)]), "text": ["a b"] * n, "scope": [""] * n})
    got = tm._found(tm.Finder(iter([("b", "", 5)])), batch, pa.int64())
    assert got.num_rows == n and max(held) == tm.TEXTS and got["at"].to_pylist() == [2] * n
    assert tm._found(tm.Finder(iter([])), batch.slice(0, 0), pa.int64()).num_rows == 0

import datetime
import random

import pytest

from papyra.operators import temporal as tm
from papyra.streaming import jobs

BEGIN = datetime.datetime(2024, 1, 1)
SHAPE = "source long, target long, kind string, chapter long, at timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def _run(spark, folder, batches, **how):
    """What the stream tells, batch after batch."""
    (folder / "in").mkdir(parents=True)
    told = []
    for rows in batches:
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = jobs.ordered_relation_state(spark.readStream.schema(SHAPE).parquet(str(folder / "in")), **how)
        out = []
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(folder / "state")).foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        told.append([tuple(r) for r in out])
    return told


def test_a_shuffled_stream_gives_the_batch_result(rocks, tmp_path):
    g = random.Random(3)
    seen = sorted({(g.randrange(3), g.randrange(2), g.choice("abc"), g.randrange(1, 15)) for _ in range(70)})
    rows = [(*s, BEGIN + datetime.timedelta(hours=s[3])) for s in seen]
    g.shuffle(rows)
    last = [(99, 99, "z", 1, BEGIN + datetime.timedelta(days=9))]
    told = _run(rocks, tmp_path, [rows[:25], rows[25:50], rows[50:], last], late="20 hours")
    assert told[0] == []  # nothing is behind the watermark yet
    now: dict = {}
    for row in [r for t in told for r in t]:
        now[row[:2] + row[2:4]] = row[4]
    df = rocks.createDataFrame(seen, "source long, target long, kind string, chapter long")
    want = tm.relation_intervals(df, ["source", "target"], "kind", "chapter")
    assert {k: e for k, e in now.items() if k[0] != 99} == {(r.source, r.target, r.kind, r.start_chapter): r.end_chapter for r in want.collect()}


def test_a_pair_that_is_not_seen_any_more_leaves_no_state(rocks, tmp_path):
    at = lambda days: BEGIN + datetime.timedelta(days=days)
    batches = [[(1, 2, "a", 1, at(0))], [(7, 7, "x", 1, at(3))], [(7, 7, "x", 2, at(20))], [(1, 2, "a", 9, at(21))], [(7, 7, "x", 3, at(40))]]
    told = _run(rocks, tmp_path, batches, late="1 day", forget=5 * 86_400_000)
    first = [r for t in told[:3] for r in t if r[0] == 1]
    again = [r for t in told[3:] for r in t if r[0] == 1]
    assert first == [(1, 2, "a", 1, 0)] and again == [(1, 2, "a", 9, 0)]  # it begins anew

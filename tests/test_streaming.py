from pyspark.sql import functions as F

from papyra.streaming import jobs
from tests.test_operators import fold, observations


def _run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _source(spark, rows, schema, tmp_path, parts):
    for i, some in enumerate(parts(rows)):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return jobs.files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema), per_trigger=1)


def test_relation_state_is_the_batch_result(spark, tmp_path):
    seen = observations(7)
    stream = _source(spark, seen, "source long, target long, kind string, chapter long", tmp_path, lambda x: [x])
    out = _run(jobs.relation_state(stream), "relations", "update", tmp_path)
    assert sorted(map(tuple, out.collect())) == fold(seen)


def test_progress_and_once(spark, tmp_path):
    rows = [("j", "done", "2024-01-01 00:00:00", 1.0), ("j", "done", "2024-01-01 00:10:00", 2.0), ("k", "failed", "2024-01-01 02:00:00", 3.0), ("j", "done", "2024-01-01 00:10:00", 2.0)]
    schema = "job string, state string, at string, value double"
    stream = _source(spark, rows, schema, tmp_path, lambda x: [x[:2], x[2:]])
    got = {(x.job, x.state): x.n for x in _run(jobs.progress(stream, "job", "state"), "progress", "complete", tmp_path).collect()}
    assert got == {("j", "done"): 3, ("k", "failed"): 1}
    timed = stream.withColumn("ts", F.to_timestamp("at"))
    assert _run(jobs.once(timed, ["job", "at"], "ts"), "once", "append", tmp_path).count() == 3
    total = _run(jobs.windowed(timed, "ts", "value"), "windowed", "complete", tmp_path)
    assert sorted((x.n, x.total) for x in total.collect()) == [(1, 3.0), (3, 5.0)]
    assert _run(jobs.daily_use(timed, "job", "ts"), "daily", "complete", tmp_path).count() == 2
    assert _run(jobs.sessions(timed, "job", "ts"), "sessions", "complete", tmp_path).count() == 2


def test_append_new_across_batches(spark, tmp_path):
    a = spark.createDataFrame([("b", "x"), ("b", "x"), ("b", "y")], "book string, text string")
    for _ in range(2):
        jobs.append_new(a, f"{tmp_path}/t", ["book"], "text")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_finished_leases_stay_finished(spark, tmp_path):
    rows = [("j", 1, "processing", 1), ("j", 2, "processing", 1), ("j", 3, "done", 9), ("j", 3, "processing", 2), ("j", 1, "done", 2), ("j", 3, "processing", 5)]
    stream = _source(spark, rows, "job string, chapter long, status string, at long", tmp_path, lambda x: [x[:4], x[4:]])
    got = [(x.chapter, x.status) for x in _run(jobs.leases(stream), "leases", "update", tmp_path).collect()]
    assert got.count((1, "done")) == 1 and (2, "processing") in got and [x for x in got if x[0] == 3] == [(3, "done")]

import pytest

from papyra.operators import batched as bt
from papyra.operators import transitions as ts
from papyra.sources.versioned import Conflict, Versioned

STATES, CHANGES = "id string, status string, version long, note string", "change string, id string, to string, seen long"


def keep(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def flags(df):
    return {r.change: (r.affected, r.reason) for r in df.collect()}


def test_changes_take_effect_once(spark):
    states = spark.createDataFrame([("a", "pending", 3, "x"), ("b", "done", 1, "y"), ("c", "processing", 0, None)], STATES)
    changes = [("1", "a", "processing", 3), ("2", "a", "processing", 3), ("3", "b", "processing", None), ("4", "c", "done", 7), ("5", "c", "failed", None), ("6", "z", "done", 1), ("7", None, "done", 1)]
    out = ts.transitioned(states, spark.createDataFrame(changes, CHANGES), "id")
    assert flags(out.flags) == {"1": (True, None), "2": (False, "outdated"), "3": (False, "not allowed"), "4": (False, "outdated"), "5": (True, None), "6": (False, "unknown"), "7": (False, "unknown")}
    assert sorted(map(tuple, out.states.collect())) == [("a", "processing", 4, "x"), ("b", "done", 1, "y"), ("c", "failed", 1, None)]
    assert sorted(map(tuple, out.log.collect())) == [("a", 4, "pending", "processing", "1"), ("c", 1, "processing", "failed", "5")]
    assert out.states.columns == states.columns


def test_two_batches_on_one_job_give_one_success_each_way(spark, tmp_path):
    store = Versioned(spark, str(tmp_path / "s"))
    states = spark.createDataFrame([("job", "pending", 0, "")], STATES)
    log = spark.createDataFrame([], "id string, version long, before string, after string, change string")
    store.commit({"states": states, "transitions": log}, expected=0)
    change = lambda name: spark.createDataFrame([(name, "job", "running", 0)], CHANGES)
    # The second batch reads the same version, and the first commits before it does.
    mine: list = []

    def first_comes_in(df):
        if not mine:
            mine.append(None)
            mine[0] = flags(ts.apply(store, change("first"), "id", "first", keep, ts.JOB))
        return keep(df)

    assert flags(ts.apply(store, change("second"), "id", "second", first_comes_in, ts.JOB)) == {"second": (False, "outdated")}
    assert mine[0] == {"first": (True, None)}
    assert [tuple(r)[:3] for r in store.read("states").collect()] == [("job", "running", 1)]
    assert [tuple(r) for r in ts.folded(store.read("transitions"), "id").collect()] == [("job", "running", 1)]
    with pytest.raises(Conflict):
        ts.apply(store, change("x"), "id", "x", lambda df: (store.commit({}, expected=store.version()), keep(df))[1], ts.JOB, tries=1)


def test_a_sink_that_fails_leaves_its_rows(spark, tmp_path):
    taken = tmp_path / "taken"
    taken.mkdir()

    def sink(name, batch):
        ids = batch.column(0).to_pylist()
        with open(taken / "tries", "a") as f:
            f.write(f"{name}\n")
        if 77 in ids:
            raise OSError("refused")
        (taken / name).write_text(",".join(map(str, ids)))  # by name: again is no copy

    rows = spark.range(500).selectExpr("id", "id * 2 as v", "1 as batch")
    for run in ("a", "b"):
        counts, failures = bt.delivered(rows.drop("batch"), "id", sink, str(tmp_path / run), size=20, tries=3, base=0.01, partitions=3)
        n = {r.ok: r.n for r in counts.collect()}
        bad = failures.collect()
        assert n[True] + n[False] == 500 and n[False] == len(bad) <= 20 and 77 in {r.id for r in bad}
        assert {(r.tries, r.error, r.v == 2 * r.id) for r in bad} == {(3, "OSError: refused", True)} and len({r.batch for r in bad}) == 1
        stored = [int(x) for p in taken.iterdir() if p.name != "tries" for x in p.read_text().split(",")]
        assert len(stored) == len(set(stored)) and set(stored) == set(range(500)) - {r.id for r in bad}
    tried = (taken / "tries").read_text().split()
    assert max(tried.count(t) for t in set(tried)) == 6 and bt.delays(6) == [1.0, 2.0, 4.0, 8.0, 16.0] and bt.delays(8)[-1] == 30.0
    counts, failures = bt.delivered(rows.drop("batch").limit(0), "id", sink, str(tmp_path / "c"))
    assert counts.count() == 0 and failures.count() == 0

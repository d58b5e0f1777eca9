import os

from papyra.llm import shared


def test_written_tables_are_kept_until_discarded(spark):
    before = list(shared.WRITTEN)
    shared.WRITTEN.clear()
    df = shared.written(spark.range(5), "five")
    assert df.count() == 5 and df.columns == ["id"]
    path = shared.WRITTEN[0]
    assert os.path.isdir(path.removeprefix("file:"))
    shared.discard(spark)
    assert not os.path.isdir(path.removeprefix("file:")) and not shared.WRITTEN
    shared.WRITTEN.extend(before)

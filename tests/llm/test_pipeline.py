import os

import pytest

import corpus_pipeline
from papyra.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert set(docs.columns) == set(columns), name
        rows.append(docs.count())
    assert rows[0] > rows[1] > rows[2]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == rows[-1] and out.filter("not intact").isEmpty()
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    clean = spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id", "left_semi")
    assert clean.join(kept, "doc_id", "left_anti").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLE_SQL[name])
    names, rows = [d[0] for d in want.description], want.fetchall()
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, rows))


def test_nulls_repeated_rows_and_clashing_columns_through_all_stages(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog near the quiet river bank while seven small birds sing in the old tree"
    rows = [(1, text, "en", "s0"), (2, text, "en", "s0"), (2, text, "en", "s0"), (None, text + " again", None, None), (None, None, None, "s1"), (5, "", "en", "s1"), (6, " \t\n", "en", None), (7, "short", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars", "1 as row", "2 as size", "3 as k", "4 as copies", "'x' as `a.b`")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for folder, some in (("full", docs), ("none", docs.limit(0))):
        some.write.parquet(str(tmp_path / folder / "documents.parquet"))
        labels.write.parquet(str(tmp_path / folder / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path / "full"))
        assert set(kept.columns) == set(docs.columns), name
    out = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert len(out) == kept.count() > 0 and all(r.intact or r.ids is None for r in out)
    assert sum(r.ids is None for r in out) == kept.filter("text is null").count() > 0
    assert not {r.doc_id for r in out} & {2}  # a copy of 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

from papyra.plans import catalogue


def run(spark, folder, name, **tables):
    for t, df in tables.items():
        df.write.parquet(str(folder / f"{t}.parquet"))
    return catalogue.QUERIES[name](spark, str(folder)).collect()


def test_words_after_the_sixtieth_character_overlap(spark, tmp_path):
    texts = ["x" * 70 + " of", "x " * 29 + "utheory the", "a" * 56 + " unders", "of", None, ""]  # the third, when cut, ends in "und"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in run(spark, tmp_path, "array_overlap_names", documents=docs)) == [0, 1, 3]


def test_every_order_and_every_document_stays(spark, tmp_path):
    orders = spark.range(190, 260).selectExpr("id as o_orderkey", "id - 160 as o_custkey", "date'2024-01-01' as o_orderdate")
    lines = spark.range(190, 250).selectExpr("id as l_orderkey", "1 as l_linenumber", "'A' as l_returnflag")
    detail = {r.o_orderkey: (r.chapters, r.states) for r in run(spark, tmp_path, "job_detail", orders=orders, lineitem=lines)}
    assert detail == {i: (1, "1:A") if i < 250 else (0, "") for i in range(190, 260)}
    assert len(catalogue.QUERIES["month_format"](spark, str(tmp_path)).collect()) == 70
    docs, labels = spark.range(50).withColumnRenamed("id", "doc_id"), spark.range(20).selectExpr("id as doc_id", "id % 2 as toxic")
    got = run(spark, tmp_path, "null_first_sort", documents=docs, labels=labels)
    assert [(r.doc_id, r.toxic) for r in got] == [(i, None) for i in range(20, 50)] + [(i, 0) for i in range(0, 20, 2)] + [(i, 1) for i in range(1, 20, 2)]


def test_intervals_of_all_sources_and_targets_are_valid(spark, tmp_path):
    orders = spark.createDataFrame([(1, 5), (2, 100)], "o_orderkey long, o_custkey long")
    rows = [(k, 50, "N", d, 1.0) for k in (1, 2) for d in ("1998-06-01", "2000-06-01")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_returnflag string, d string, l_quantity double").selectExpr("*", "date(d) as l_shipdate")
    assert sorted(r.source for r in run(spark, tmp_path, "interval_valid_at", orders=orders, lineitem=lines)) == [5, 100]

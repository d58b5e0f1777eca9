from papyra.operators import agents as ag


class Halves:
    """Scores by the number in a text, upside down; fails for one question, answers short for another, and never takes many."""

    def scores(self, question, texts):
        assert len(texts) <= 40
        if question == "fails" and "7" in texts:
            raise OSError("down")
        return [-float(t) for t in texts][: len(texts) - (question == "short" and "7" in texts)]


def test_a_failed_call_is_the_searchs_order_for_all_of_its_query(spark):
    rows = [(q, name, i, str(i), float(i)) for q, name in enumerate(("good", "fails", "short")) for i in range(100)]
    hits = spark.createDataFrame(rows, "query_id long, question string, vec_id long, text string, score double")
    got: dict = {}
    for r in ag.rescored(hits, Halves(), 3, call=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {0: [0, 1, 2], 1: [99, 98, 97], 2: [99, 98, 97]}

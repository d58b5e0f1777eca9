import json

from papyra.operators import narrative as nv


def _answers(spark, rows):
    return spark.createDataFrame([("b", c, s, json.dumps(v, ensure_ascii=False) if not isinstance(v, str) else v) for c, s, v in rows], "book string, chapter long, scene long, json string")


def test_a_small_book_end_to_end(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    keep = lambda df: df.checkpoint()
    people = _answers(spark, [
        (1, 0, {"items": [{"name": "韩立", "aliases": ["韩跑跑"], "type": "human", "description": "", "source_fragment": "韩立走"}, {"name": "飞剑", "type": "item"}]}),
        (1, 1, {"items": [{"name": "厉飞雨", "aliases": ["韩跑跑", "厉师兄"], "type": "human", "description": "friend"}, {"name": "", "type": "human"}, {"name": "x", "type": "alien"}]}),
        (2, 0, {"items": [{"name": "韩跑跑", "type": "human"}]}), (3, 0, "not json"),
    ])
    good, issues = nv.parsed(people, "entity")
    assert sorted((i.chapter, i.reason) for i in issues.collect()) == [(1, "no name"), (1, "unknown type"), (3, "not read")]
    entities = nv.merged_entities(good, keep)
    got = {(e.chapter, e.name): (e.aliases, e.type, e.description) for e in entities.collect()}
    assert got == {(1, "韩立"): (["厉师兄", "厉飞雨", "韩跑跑"], "human", "friend"), (1, "飞剑"): ([], "item", None), (2, "韩跑跑"): ([], "human", None)}
    chapters = spark.createDataFrame([("b", 1, "那天韩立走了。"), ("b", 2, "空")], "book string, chapter long, text string")
    assert nv.anchored(entities, chapters).count() == 3
    known = spark.createDataFrame([], "entity_id string, book string, entity_name string, entity_type string, first_chapter long, last_chapter long")
    aliases = spark.createDataFrame([], "book string, alias_name string, entity_id string")
    for chapter in (1, 2, 2):
        step, grown = nv.registered(entities.filter(f"chapter = {chapter}"), known, aliases)
        known, aliases = keep(step), keep(grown)
    table = {k.entity_name: (k.first_chapter, k.last_chapter) for k in known.collect()}
    assert table == {"韩立": (1, 2), "飞剑": (1, 1)} and aliases.count() == 5
    links, _ = nv.parsed(_answers(spark, [(2, 0, {"items": [{"source": "韩跑跑", "target": "飞剑", "relation_type": "possess", "weight": 2, "valid_period": "temporary"}, {"source": "韩立", "target": "nobody", "relation_type": "enmity", "weight": 1, "valid_period": "temporary"}, {"source": "a", "target": "b", "relation_type": "enmity", "weight": 9, "valid_period": "temporary"}]})]), "relation")
    named = nv.canonical(links, ["source", "target"], entities)
    ok, bad = nv.resolved(named, aliases)
    assert ok.count() == 1 and [b.reason for b in bad.collect()] == ["unknown target nobody"]
    states = spark.createDataFrame([(k.entity_id, 1, "well", "") for k in known.collect()] + [(k.entity_id, 2, "", "north") for k in known.collect()], "entity_id string, chapter long, health string, place string")
    rel = ok.selectExpr("source_id", "target_id", "relation_type", "2L as start_chapter", "0L as end_chapter")
    cards = {c.identity.entity_name: c for c in nv.entity_cards(known, aliases, states, rel, 2).collect()}
    assert tuple(cards["韩立"].state) == ("well", "north") and cards["韩立"].relations[0].way == "out" and cards["飞剑"].relations[0].way == "in"
    early = {c.identity.entity_name: c for c in nv.entity_cards(known, aliases, states, rel, 1).collect()}
    assert early["韩立"].relations == [] and tuple(early["韩立"].state) == ("well", None)


def test_checks(spark):
    rules = spark.createDataFrame([("b", "s", "a", "cap", "10"), ("b", "s", "a", "cap", "20"), ("b", "t", "a", "cap", "1"), ("b", "t", "a", "cap", "2"), ("b", "t", "a", "balance_lock", "x")], "book string, subject string, ability string, rule_type string, content string")
    assert [(r.subject, r.caps) for r in nv.ladder_issues(rules).collect()] == [("s", 2)]
    assert nv.evidence_terms("short", '{"a": ["longest one", "x"], "b": "short"}', "plain") == ["longest one", "short", "plain"]
    row = spark.range(1).select(nv.sort_key(nv.F.lit(3_000_000), nv.F.lit(2), nv.F.lit(7)).alias("k")).first()
    assert row.k == 300_000_002_007


def test_intervals_of_relations_by_brute_force(spark):
    import random

    from papyra.operators import temporal as tm

    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(2), rng.choice("abc"), rng.randrange(1, 12)) for _ in range(90)]
    want = []
    for pair in sorted({r[:2] for r in rows}):
        chapters = sorted({r[3] for r in rows if r[:2] == pair})
        for kind in "abc":
            runs = []
            for n, c in enumerate(chapters):
                if (*pair, kind, c) in rows:
                    runs[-1:] = [runs[-1] + [n]] if runs and runs[-1][-1] == n - 1 else runs[-1:] + [[n]]
            want += [(*pair, kind, chapters[r[0]], chapters[r[-1] + 1] - 1 if r[-1] + 1 < len(chapters) else 0, len(r)) for r in runs]
    d = spark.createDataFrame(rows, "source long, target long, kind string, chapter long")
    got = tm.relation_intervals(d, ["source", "target"], "kind", "chapter", rows=7 * tm.TASK)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)

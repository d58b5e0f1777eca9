import random

import pytest

from papyra.llm import url_rules as ur


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[3], best[4] if best else ur.DEFAULT)


@pytest.mark.parametrize("rules", [ur.RULES, [], [("block", "a.b.org", ""), ("allow", "b.org", "/x/y/z/long"), ("block", "org", "/x"), ("allow", "org", "/x"), ("block", "com", "/")]])
def test_same_as_each_rule_by_hand(spark, rules):
    r = random.Random(2)
    hosts = ["org", "example.org", "a.b.org", "B.org", "xorg", "com", "x.com", "example.org.", "", "org:80", "É.org", "a..org", "com.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a", "/de/", "/x", "/x/y/z/long/er", "?q=/es/", "#/es/", "/a?b://c/", "\n/x"]
    urls = [f"{s}{h}{p}" for s in ("http://", "HTTPS://", "://", "") for h in hosts for p in paths] + [None, "", "mailto:x"]
    r.shuffle(urls)
    pages = spark.createDataFrame([(i % 50, u) for i, u in enumerate(urls)] + [(None, "http://org/x")] * 2, "page_id long, url string").selectExpr("*", "1 as host", "2 as lane", "3 as key")
    got = sorted(((x.row.page_id, x.row.url, x.host, x.path, x.rule, x.verdict) for x in ur.judged(pages, rules).collect()), key=str)
    assert got == sorted(((x.page_id, x.url, *judge(x.url, rules)) for x in pages.collect()), key=str)
    assert ur.judged(pages.limit(0), rules).count() == 0


def test_any_number_of_rules(spark, monkeypatch):
    rules = [("block", "a.b.org", ""), ("allow", "b.org", "/x/y"), ("block", "org", "/x"), ("allow", "org", "/x"), ("block", "com", "/"), ("allow", "b.org", "/x/y/z"), ("block", "b.org", "/x/y/z")]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("a.b.org", "b.org", "c.org", "com", "net") for p in ("/x", "/x/y/z/1", "/"))], "page_id long, url string")
    for swept in (1, 2, 100):
        monkeypatch.setattr(ur, "SWEPT", swept)
        got = sorted((x.row.url, x.host, x.path, x.rule, x.verdict) for x in ur.judged(pages, rules).collect())
        assert got == sorted((x.url, *judge(x.url, rules)) for x in pages.collect())


def test_plan(spark):
    pages = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    plan = ur.judged(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

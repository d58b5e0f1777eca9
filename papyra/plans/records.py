"""Extracted records against their schemas, and the pages of a book's browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators import browsing as br
from papyra.operators import schemas as sc
from papyra.plans.registry import query
from papyra.plans.story_tables import sql, story

_PICK = lambda n, *values: f"CASE o_orderkey % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
#: Records of two kinds as JSON, from orders: each field goes through right and wrong values with a period of its own.
RELATIONS = f"""SELECT o_orderkey AS k, '[["source": "' || o_orderpriority || '"' || {_PICK(7, '', ', "target": null', ', "target": ""', ', "target": "b"', ', "target": "c"', ', "target": 4', ', "target": "d"')} || ', "relation_type": ' || {_PICK(3, '"family"', '"odd"', '"enmity"')} ||
  {_PICK(8, '', ', "weight": 1', ', "weight": 0', ', "weight": 3', ', "weight": "2"', ', "weight": 2.5', ', "weight": true', ', "weight": null')} || {_PICK(5, '', ', "relation_trend": "稳定"', ', "relation_trend": "odd"', ', "desc": ["x"]', ', "desc": "said"')} || ']]' AS json FROM {{orders}}"""
LOCATIONS = f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'no object' ELSE '[["name": ' || {_PICK(4, '"a"', '""', 'null', '"b"')} || {_PICK(6, '', ', "level": 0', ', "level": 4', ', "level": 5', ', "level": "3"', ', "level": [1]')} || {_PICK(3, '', ', "parent_name": null', ', "parent_name": 3')} || ']]' END AS json FROM {{orders}}"""


def _records(t, text: str) -> DataFrame:
    return t("orders").sparkSession.sql(text.replace("[[", "{{").replace("]]", "}}"), orders=t("orders"))


_SHOWN = """WITH r AS (SELECT o_orderkey AS k, o_orderpriority FROM orders),
rel AS (SELECT k, 'relation' AS kind, concat_ws('; ', CASE k % 7 WHEN 0 THEN 'target: missing' WHEN 1 THEN 'target: not a text' WHEN 2 THEN 'target: empty' WHEN 5 THEN 'target: not a text' END, CASE k % 3 WHEN 1 THEN 'relation_type: unknown value' END,
  CASE k % 8 WHEN 2 THEN 'weight: below 1' WHEN 3 THEN 'weight: above 2' WHEN 5 THEN 'weight: not a whole number' WHEN 7 THEN 'weight: not a whole number' END, CASE k % 5 WHEN 3 THEN 'desc: not a text' WHEN 2 THEN 'relation_trend: unknown value' END) AS wrong,
  concat_ws(',', o_orderpriority, CASE k % 7 WHEN 2 THEN '' WHEN 3 THEN 'b' WHEN 4 THEN 'c' WHEN 6 THEN 'd' END, CASE k % 3 WHEN 0 THEN 'family' WHEN 1 THEN 'odd' ELSE 'enmity' END, CASE k % 8 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 3 WHEN 6 THEN 1 ELSE 2 END, CASE k % 5 WHEN 2 THEN 'odd' ELSE '稳定' END, CASE k % 5 WHEN 4 THEN 'said' ELSE '' END) AS clean FROM r),
loc AS (SELECT k, 'location' AS kind, CASE WHEN k % 11 = 0 THEN 'not an object' ELSE concat_ws('; ', CASE k % 4 WHEN 1 THEN 'name: empty' WHEN 2 THEN 'name: not a text' END, CASE k % 6 WHEN 0 THEN 'level: missing' WHEN 1 THEN 'level: below 1' WHEN 3 THEN 'level: above 4' WHEN 5 THEN 'level: not a whole number' END, CASE k % 3 WHEN 2 THEN 'parent_name: not a text' END) END AS wrong,
  CASE WHEN k % 11 <> 0 THEN concat_ws(',', CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN '' WHEN 3 THEN 'b' END, CASE k % 6 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 3 END) END AS clean FROM r)
SELECT * FROM rel UNION ALL SELECT * FROM loc"""


@query("schema_violations", _SHOWN)
def _(t):
    """All that is wrong with each record, and what is left of it."""
    wrong = F.array_join("violations", "; ").alias("wrong")
    rel = sc.checked(_records(t, RELATIONS), "relation")
    loc = sc.checked(_records(t, LOCATIONS), "location")
    r, at = F.col("record"), F.col("record.level").cast("string")
    one = rel.select("k", F.lit("relation").alias("kind"), wrong, F.concat_ws(",", r["source"], r["target"], r["relation_type"], r["weight"].cast("string"), r["relation_trend"], r["desc"]).alias("clean"))
    return one.unionByName(loc.select("k", F.lit("location").alias("kind"), wrong, F.when(r.isNotNull(), F.concat_ws(",", r["name"], at)).alias("clean")))


def _page_sql(kind: str) -> str:
    spec = br.SPECS[kind]
    order = ", ".join([f"{c} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}" for c, down in spec.order] + [spec.unique])
    return f"SELECT '{kind}' AS kind, row_number() OVER (ORDER BY {order}) AS nth, CAST({spec.unique} AS STRING) AS id, count(*) OVER () AS total FROM {sql(spec.table)} WHERE book_id = 'book_1'"


@query("browse_types", " UNION ALL ".join(f"SELECT * FROM ({_page_sql(k)}) WHERE nth <= 20" for k in br.SPECS))
def _(t):
    """The first page of each type of a book, by the id that settles ties, with how many there are."""
    tables = {s.table: story(t, s.table) for s in br.SPECS.values()} | {"novel_chapter": story(t, "novel_chapter")}
    out = None
    for kind, spec in br.SPECS.items():
        total, page = br.browsed(kind, tables, "book_1", whole=True)
        one = page.select(F.lit(kind).alias("kind"), "nth", F.col(spec.unique).cast("string").alias("id")).join(F.broadcast(total))  # one row of total
        out = one if out is None else out.unionByName(one)
    return out.select("kind", F.col("nth").cast("long").alias("nth"), "id", "total")

"""URL filters by a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels in reverse, each closed by a dot: ``a.example.org`` is ``org.example.a.``. A rule's
host, as such a key, is a prefix of the keys of that host and all its subdomains, so it covers one interval of the sorted
keys, and two rules' intervals are nested or apart. Rules and URLs are sorted together by key, and one sweep keeps the
stack of the rules that are open: as intervals nest, the stack has one place for each number of labels, holding the latest
rule host with so many labels, and it is open while its key is still a prefix. Among the rules on the stack whose path
starts the URL's path, the longest (host and path together; then the longer host; then block) wins.

The sweep runs in ``4 x spark.sql.shuffle.partitions`` lanes: URLs are dealt to lanes by a hash of the whole row, so a hot
host is spread, and each lane gets a copy of the rules, ``SWEPT`` at most: more rules are more sweeps, in which a URL keeps the
longest rule so far.

Edges: a null URL or one without ``://`` has empty host and path and gets the default verdict; so does one that no rule
fits; rows with the same id each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.shared import LOWER, UPPER, partitions, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules of one sweep.
DEFAULT, SWEPT = "allow", 100_000


def _key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _swept(urls: DataFrame, rules: Sequence[tuple[str, str, str]], lanes: int) -> DataFrame:
    """urls with ``won`` raised to the longest of some rules that fit, if that is longer."""
    of = urls.sparkSession.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "verdict string, host string, path string")
    rule = F.concat("host", "path")
    of = of.select(_key(F.col("host")).alias("key"), F.struct(F.length(rule).alias("n"), F.length("host").alias("h"), F.expr("verdict = 'block'").alias("b"), "path", rule.alias("rule"), "verdict").alias("r"))
    of = of.groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("opens")).select("key", "opens", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"))
    depths = sorted({h.count(".") + 1 for _, h, _ in rules})
    both = urls.unionByName(of, allowMissingColumns=True)
    sweep = Window.partitionBy("lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    labels = F.size(F.split("key", r"\.")) - 1
    top = {d: F.last(F.when((F.col("kind") == 0) & (labels == d), F.struct("key", "opens")), ignorenulls=True).over(sweep) for d in depths}
    both = both.select("*", *[top[d].alias(f"at{d}") for d in depths]).filter("kind = 1")
    stack = [F.when(F.col("key").startswith(F.col(f"at{d}.key")), F.col(f"at{d}.opens")) for d in depths]
    fits = reduce(lambda a, b: F.concat(a, b), [F.coalesce(F.filter(s, lambda r: F.col("path").startswith(r["path"])), F.expr("array()").cast(of.schema["opens"].dataType)) for s in stack])
    return both.select(*[c for c in urls.columns if c != "won"], F.greatest("won", F.array_max(fits)).alias("won"))


_WON = "struct<n:int,h:int,b:boolean,path:string,rule:string,verdict:string>"


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Every row of ``pages``, in struct ``row``, with host, path, rule and verdict."""
    lanes = 4 * partitions(pages.sparkSession)
    rest = F.when(F.locate("://", pages[url]) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    urls = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"), rest.alias("rest"))
    urls = urls.select("row", F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")
    urls = urls.select("*", _key(F.col("host")).alias("key"), lane.alias("lane"), F.lit(1).alias("kind"), F.lit(None).cast(_WON).alias("won"))
    for i in range(0, len(rules), SWEPT):
        urls = _swept(urls, rules[i : i + SWEPT], lanes)
    return urls.select("row", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict")


OP6_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
m AS (SELECT p.page_id, p.host, p.path, r.verdict, rhost || rpath AS rule
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), '{DEFAULT}') AS verdict
FROM m GROUP BY page_id, host, path"""

"""URL filter: host-suffix and path-prefix expressions, short hash prefixes, full digests.

A rule is (host, path, verdict).  It fits its host and all subdomains if the path of the
URL starts with the rule's path; the rule with the longest ``host + path`` wins, then the
longer host, then ``block`` before ``allow``.  Only DataFrame functions are used.

A URL has one expression per host suffix with as many labels as some rule has, and per
path prefix as long as some rule's path, so their number follows the rule table and not
the URL.  Expressions meet the rules by the first ``PREFIX_HEX`` digits of their SHA-256;
the full digest and the texts then decide.  Null URLs and those without ``://`` have an
empty host and path and fit no rule.  Repeated rows stay repeated; an empty table gives an
empty result; other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.registry import query
from wardline.llm.tables import table

PREFIX_HEX = 8
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    tail = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(tail, "^[^/?#]*", 0)
    path = F.regexp_extract(tail.substr(F.length(host) + 1, F.length(tail)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    shape = rules.agg(F.count(F.lit(1)).alias("n"),
                      F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
                      F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    keyed = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"),
                         _digest(F.col("host"), F.col("path")).alias("r_digest"))
    keyed = keyed.withColumn("key", F.substring("r_digest", 1, PREFIX_HEX))
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[
        F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, -n, n))) for n in shape["labels"]] or [F.lit(None).cast("string")]))
    prefixes = F.array_compact(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape["lengths"]] or [F.lit(None).cast("string")]))
    spread = (rows.withColumn("_s", suffixes).withColumn("_p", prefixes)
              .withColumn("_e", F.explode_outer(F.flatten(F.transform("_s", lambda s: F.transform("_p", lambda p: F.struct(s.alias("s"), p.alias("p"))))))))
    spread = spread.withColumn("_digest", F.when(F.col("_e").isNotNull(), _digest(F.col("_e.s"), F.col("_e.p"))))
    spread = spread.withColumn("key", F.substring("_digest", 1, PREFIX_HEX)).drop("_s", "_p")
    met = spread.join(keyed, "key", "left")
    sure = (F.col("_digest") == F.col("r_digest")) & (F.col("_e.s") == F.col("r_host")) & (F.col("_e.p") == F.col("r_path"))
    rank = F.when(sure, F.struct(
        (F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"),
        (F.col("r_verdict") == "block").cast("int").alias("c"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")))
    best = met.groupBy("_row", "page_id", "host", "path").agg(F.max(rank).alias("m"))
    return best.select("page_id", "host", "path", F.col("m.rule").alias("rule"),
                       F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_SQL = r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS t FROM a),
c AS (SELECT page_id, t, regexp_extract(t, '^[^/?#]*', 0) AS h FROM b),
d AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(t, length(h) + 1), '^[^?#]*', 0) AS path FROM c),
e AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM e
"""


@query("op3_url_rules", _SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))

"""URL rules as a sort-merge range join.

A host written label by label from its end, with a closing dot, is its canonical key; a
rule on a host and its subdomains is then the interval of keys that begin with the rule's
key. Intervals of different hosts nest or are apart, so the rules that hold at a place
are a stack. Boundaries and urls are sorted together and swept: each boundary carries the
stack that holds from there on, each url takes the stack of the last boundary before it and
keeps the longest rule whose path its own path begins with. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import table

#: The rules of the query, as (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """Host with its port and user, A-Z lower-cased; empty for null or a url without '://'."""
    host = F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))
    return F.translate(host, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """Path from its first slash to '?' or '#'; empty for null or a url without '://'."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each closed with a dot: 'a.net' -> 'net.a.'."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(top label, key, stack): the rules that hold from this key to the next boundary."""
    rules = rules.where(F.length("host") > 0).select(
        F.translate("host", UPPER, UPPER.lower()).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    )
    entry = F.struct(
        F.length(F.concat("host", "path")).alias("size"),
        F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        "path",
    )
    hosts = rules.groupBy("host").agg(F.array_sort(F.collect_set(entry)).alias("own"))
    labels = F.split("host", r"\.")
    around = hosts.select(
        "host",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
            )
        ).alias("outer"),
    )
    stacks = (
        around.join(hosts.select(F.col("host").alias("outer"), "own"), "outer")
        .groupBy("host")
        .agg(F.flatten(F.collect_list("own")).alias("stack"))
    )
    key = host_key(F.col("host"))
    begin = F.struct(key.alias("key"), F.col("stack"))
    end = F.struct(
        F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"),
        F.filter("stack", lambda r: r["host_size"] < F.length("host")).alias("stack"),
    )
    return (
        stacks.withColumn("key", key)
        .select(F.explode(F.array(begin, end)).alias("b"), F.element_at(labels, -1).alias("top"))
        .select("top", "b.key", "b.stack")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", salts: int = 256, default: str = "allow"
) -> DataFrame:
    """All rows of pages with host, path, rule (null: none fits) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains, if the url's path
    begins with the rule's path; the longest rule wins, then the longer host, then "block"
    over "allow". Rules with a null or empty host fit nothing. A null url, or one without
    "://", has an empty host and path and gets the default. Equal rows each give a row;
    columns named as the new ones are replaced; an empty table gives an empty table.

    The sweep runs per top label and salt, so one host or top label with a third of all
    urls is spread over `salts` tasks; the boundaries, two a rule host, go to every salt.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new]
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    points = pages.select(
        row.alias("row"),
        url_host(F.col(f"`{url}`")).alias("host"),
        url_path(F.col(f"`{url}`")).alias("path"),
    ).select(
        F.element_at(F.split("host", r"\."), -1).alias("top"),
        F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"),
        host_key(F.col("host")).alias("key"),
        F.lit(1).alias("kind"),
        "row",
        "host",
        "path",
    )
    bounds = _boundaries(rules).select(
        "top",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        "key",
        F.lit(0).alias("kind"),
        "stack",
    )
    sweep = W.partitionBy("top", "salt").orderBy("key", "kind")
    swept = (
        points.unionByName(bounds, allowMissingColumns=True)
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 1")
    )
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select(
        *(F.col("row").getField(c).alias(c) for c in kept),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id
                            ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
  FROM parts p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host))
   AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""

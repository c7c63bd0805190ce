"""Queries over declared and observed states and the life of contracts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.jobs.evidence import ORACLES as EVIDENCE
from spanloom.jobs.evidence import _text, planes
from spanloom.jobs.traffic import DAY, V
from spanloom.operators import aggregate, states
from spanloom.sources.openapi import explode_contracts
from spanloom.sources.views import executions, read


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of the parts: paths, versions and ids, of which traffic meets some."""
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, _text("/v", k % 7, "/p", k)).otherwise(_text("/p", k, "/{id}"))
    return read(spark, sf_dir, "part").select(path.alias("path"), F.when(k % 2 == 0, _text("op", k)).alias("operation_id"))


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    customer = read(spark, sf_dir, "customer")
    call = F.struct(F.when(k % 3 != 0, _text("host", k % 40)).otherwise("").alias("callee"))
    seen = customer.select(
        F.when(k % 4 == 0, _text("/p", k, "/{key}/")).when(k % 4 == 1, "").alias("route"), _text("op", k).alias("operation"), F.array(call).alias("downstream_calls"),
    )
    marked = customer.select(F.create_map(F.when(k % 2 == 0, "service.version").otherwise("other"), _text("v", k % 11)).alias("attributes"))
    hosts = read(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, _text("https://host", F.col("s_suppkey") % 60, "/x")).otherwise("api").alias("host"))
    routes = read(spark, sf_dir, "part").select(_text("/p", F.col("p_partkey") + 7, "/{x}").alias("path")).union(spark.range(1).select(F.lit("/")))
    goals = [("all", "error_rate", 0.99, None), ("easy", "error_rate", 0.01, None), ("late", "error_rate", 0.999, "2024-01-30"), ("speed", "latency", 0.5, None)]
    budgets = aggregate.error_budget(executions(spark, sf_dir), spark.createDataFrame(goals, "name string, metric string, target double, window string"), DAY)
    versions = spark.createDataFrame([("v9",), ("2.1",)], "version string")
    return states.state_drift(declared(spark, sf_dir), versions, hosts, seen, marked, routes, budgets, planes(spark, sf_dir))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(table: str, key: str) -> DataFrame:
        k = F.col(key)
        return read(spark, sf_dir, table).select(_text("o", k).alias("identifier"), _text("f", k % 5).alias("source"))

    found = states.state_views({"declared": rows("part", "p_partkey"), "observed": rows("customer", "c_custkey"), "desired": rows("nation", "n_nationkey")})
    lists = (F.array_join(c, ",").alias(c) for c in ("identifiers", "sources"))
    return found.select("state", "present", "records", F.col("fingerprint").isNotNull().alias("hashed"), *lists, "missing")


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def on(condition: F.Column, value: str) -> F.Column:
        return F.when(condition, value).otherwise("")

    doc = F.concat(
        F.lit('{"openapi":"3.0.0",'), on(k % 5 == 0, '"x-status":"GA",'), on(k % 7 == 0, '"x-lifecycle":"beta",'), on(k % 11 == 0, '"x-api-status":"odd",'),
        on(k % 3 == 0, '"x-deprecated":true,'), on(k % 4 == 0, '"x-sunset":"2030-01-01",'), on(k % 6 == 0, '"x-Replaced-By":"v2",'), on(k % 13 == 0, '"x-deprecation-date":"2024-01-01",'),
        F.lit('"paths":{"/a":{"get":{'), on(k % 8 == 1, '"deprecated":true,'), F.lit('"responses":{}}}}}'),
    )
    c = explode_contracts(read(spark, sf_dir, "part").select(k.cast("string").alias("project"), F.lit("d").alias("doc"), doc.alias("text")))
    return states.lifecycles(c.operations, c.nodes)


def deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part")
    kind = F.when(k % 3 == 0, "Service").when(k % 3 == 1, "Deployment").otherwise("Ingress")
    manifests = part.select(_text("s", k % 500).alias("name"), F.when(k % 4 != 0, "prod").alias("namespace"), kind.alias("kind"))
    ids = text.entity_id(F.when(k % 5 == 0, "Bad").otherwise("service"), F.lit("api"), _text("s", k * 2))
    return states.deployed_as(manifests, part.select(ids.alias("id")).where("id is not null"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "j12_state_drift": drifted,
    "a30_all_states": views,
    "c18_lifecycles": lives,
    "j19_deployed_as": deployed,
}


def _view(state: str, table: str, key: str) -> str:
    return f"""SELECT '{state}' AS state, TRUE AS present, (SELECT count(*) FROM {table}) AS records, TRUE AS hashed,
      (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT 'o' || {key} AS i FROM {table} ORDER BY 1 LIMIT 64)) AS identifiers,
      (SELECT string_agg(DISTINCT 'f' || ({key} % 5), ',' ORDER BY 'f' || ({key} % 5)) FROM {table}) AS sources, FALSE AS missing"""


ORACLES = {
    "j12_state_drift": f"""{V}, d AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '/v' || (p_partkey % 7) || '/p' || p_partkey ELSE '/p' || p_partkey || '/{{}}' END AS form FROM part),
      c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT k, CASE WHEN k % 4 = 0 THEN '/p' || k || '/{{key}}/' ELSE 'op' || k END AS subject FROM c),
      b AS (SELECT count(*) AS n, count(*) FILTER (status = 'error' OR coalesce(try_cast(status AS BIGINT) >= 500, FALSE)) AS bad,
        count(*) FILTER (day_window = '2024-01-30') AS ln, count(*) FILTER (day_window = '2024-01-30' AND (status = 'error' OR coalesce(try_cast(status AS BIGINT) >= 500, FALSE))) AS lbad FROM executions)
      SELECT DISTINCT 'runtime' AS kind, subject FROM o WHERE NOT (k % 4 = 0 AND '/p' || k || '/{{}}' IN (SELECT form FROM d)) AND 'op' || k NOT IN (SELECT 'op' || k FROM d WHERE k % 2 = 0)
      UNION ALL SELECT DISTINCT 'version', 'v' || (k % 11) FROM c WHERE k % 2 = 0 AND 'v' || (k % 11) NOT IN (SELECT 'v' || (k % 7) FROM d WHERE k % 3 = 0 UNION SELECT 'v9')
      UNION ALL SELECT DISTINCT 'dependency', 'host' || (k % 40) FROM c WHERE k % 3 <> 0 AND 'host' || (k % 40) NOT IN (SELECT 'host' || (s_suppkey % 60) FROM supplier WHERE s_suppkey % 2 = 0)
      UNION ALL SELECT 'routing', '/p' || (k + 7) || '/{{x}}' FROM d WHERE '/p' || (k + 7) || '/{{}}' NOT IN (SELECT form FROM d)
      UNION ALL SELECT 'slo', 'all' FROM b WHERE n >= 8 AND 0.01 * n - bad < 0 UNION ALL SELECT 'slo', 'easy' FROM b WHERE n >= 8 AND 0.99 * n - bad < 0 UNION ALL SELECT 'slo', 'late' FROM b WHERE ln >= 8 AND 0.001 * ln - lbad < 0
      UNION ALL SELECT 'auth', project || ' ' || method || ' ' || path FROM ({EVIDENCE["j13_auth_planes"]}) WHERE drift""",
    "a30_all_states": f"""{_view("declared", "part", "p_partkey")} UNION ALL {_view("observed", "customer", "c_custkey")} UNION ALL {_view("desired", "nation", "n_nationkey")}
      UNION ALL SELECT unnest(['implemented', 'hypothetical']), FALSE, 0, FALSE, '', '', TRUE""",
    "c18_lifecycles": """WITH p AS (SELECT p_partkey AS k FROM part), x AS (SELECT k, k % 8 = 1 OR k % 3 = 0 OR k % 13 = 0 AS deprecated, CASE WHEN k % 13 = 0 THEN '2024-01-01' END AS since, CASE WHEN k % 4 = 0 THEN '2030-01-01' END AS sunset FROM p)
      SELECT CAST(k AS VARCHAR) AS project, deprecated, since, sunset, CASE WHEN k % 6 = 0 THEN 'v2' END AS replacement,
        CASE WHEN k % 7 = 0 THEN 'EXPERIMENTAL' WHEN k % 5 = 0 THEN 'ACTIVE' WHEN sunset IS NOT NULL THEN 'SUNSET' WHEN deprecated THEN 'DEPRECATED' ELSE 'UNKNOWN' END AS state FROM x""",
    "j19_deployed_as": """SELECT DISTINCT 'deployment:k8s:' || CASE WHEN k % 4 <> 0 THEN 'prod.' ELSE '' END || name AS deployment, CASE k % 3 WHEN 0 THEN 'service' ELSE 'deployment' END AS kind, 'service:api:' || name AS service
      FROM (SELECT p_partkey AS k, 's' || (p_partkey % 500) AS name FROM part) WHERE k % 3 <> 2 AND name IN (SELECT 's' || (p_partkey * 2) FROM part WHERE p_partkey % 5 <> 0)""",
}

"""Queries over many repositories and environments, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import scratch
from spanloom.jobs import governance
from spanloom.jobs.evidence import _text
from spanloom.operators import workspace
from spanloom.sources.views import read


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    method = F.when(k % 2 == 0, "GET").otherwise("POST")
    ops = part.select(_text("r", k % 50).alias("repo"), method.alias("method"), _text("/v1/a", k, "/{id}").alias("path"))
    ways = part.select(_text("r", k % 49).alias("repo"), F.lower(method).alias("method"), _text("/v1/a", k, "/{key}/").alias("path"))
    sites = part.select(_text("r", k % 47).alias("repo"), F.when(k % 3 == 0, "GET").alias("site_method"), _text("/base/v1/a", k, "/7").alias("path"))
    gates = part.select(_text("r", k % 7).alias("repo"), F.when(k % 5 == 0, _text("/v1/a", k)).otherwise(_text("/v2/a", k)).alias("path"))
    packages = part.select(_text("r", k % 50).alias("repo"), _text("Lib_", F.floor(k / 4)).alias("name"))
    imports = part.select(_text("r", k % 11).alias("repo"), _text("lib.", k).alias("name"))
    return workspace.repo_edges(ops, ways, sites, gates, packages, imports)


def blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    links = lines.select(F.lit("CALLS").alias("kind"), _text("n", F.col("p")).alias("from_repo"), _text("n", F.floor(F.col("p") / 3) + F.col("s") % 2).alias("to_repo"), _text("x", F.col("s") % 3).alias("subject")).distinct()
    changed = read(spark, sf_dir, "part").select(_text("n", k).alias("repo"), _text("x", k % 4).alias("subject"))
    return workspace.repo_blast(links, changed)


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    def subjects(table: str, key: str, shift: int) -> DataFrame:
        return read(spark, sf_dir, table).select(_text("o", F.col(key) + shift).alias("subject"))

    return workspace.twin_drift(subjects("part", "p_partkey", 0), subjects("part", "p_partkey", 9), subjects("customer", "c_custkey", 0), subjects("supplier", "s_suppkey", 500))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    found = workspace.state_view(part.select(_text("o", k).alias("identifier"), "p_size"), "declared").union(
        workspace.state_view(part.limit(0).select(_text("o", k).alias("identifier"), "p_size"), "desired")
    )
    return found.select("state", "present", "records", F.col("fingerprint").isNotNull().alias("hashed"), F.array_join("identifiers", ",").alias("identifiers"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, k = read(spark, sf_dir, "pages"), F.col("page_id")
    routes = pages.select(_text("/r", k).alias("path"), F.when(k % 5 != 0, F.col("url")).alias("upstream"))
    services = pages.where("page_id % 3 = 0").select(_text("s", k).alias("service"), F.col("url").alias("host"))
    return workspace.upstreams(routes, services).drop("upstream")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    space = F.col("p_brand").alias("namespace")
    ingresses = part.select(_text("i", k).alias("name"), space, F.when(k % 4 != 0, F.array(_text("s", k), _text("s", k + 1))).alias("backends"))
    services = part.select(_text("s", k).alias("name"), space, F.when(k % 3 != 0, F.array(_text("l", k), _text("m", k))).alias("selectors"))
    deployments = part.where(k % 5 != 0).select(_text("d", k).alias("name"), space, F.array(_text("l", k), _text("m", k)).alias("labels"))
    return workspace.deployment_chain(ingresses, services, deployments)


def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    want = spark.createDataFrame([(["problem"], ["code", "detail"])], "types array<string>, fields array<string>")
    types = F.when(k % 7 != 0, F.when(k % 2 == 0, F.array(F.lit("problem"))).otherwise(F.array(F.lit("plain"))))
    fields = F.when(k % 3 == 0, F.array(F.lit("code"))).otherwise(F.array(F.lit("detail"), F.lit("code")))
    return workspace.error_conformance(want, read(spark, sf_dir, "part").select(k.alias("operation"), types.alias("types"), fields.alias("fields")))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 2 == 0, _text("/api/v", k % 9, "/x")).otherwise("/api/x")
    headers = F.when(k % 3 == 0, F.array(F.lit("X-API-Version"), F.lit("Accept"))).otherwise(F.array().cast("array<string>"))
    media = F.when(k % 5 == 0, F.array(_text("application/vnd.shop.v", k % 4, "+json"), F.lit("text/csv"))).otherwise(F.array(F.lit("application/json")))
    return workspace.version_signals(read(spark, sf_dir, "part").select(k.alias("operation"), path.alias("path"), headers.alias("header_names"), media.alias("media_types")))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions registered; contracts that did not change have both labels."""
    path = scratch(spark, "register")
    for new in (False, True):
        rows = governance.operations(spark, sf_dir, new).select("project", "method", "operation_id")
        workspace.register_baseline(rows, "project", path, "new" if new else "old")
    found = workspace.registered(spark, path)
    return found.select("contract", "elements", F.array_join("labels", ",").alias("labels"))


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    own: dict[str, workspace.Check] = {}

    @workspace.check("large-parts", own)
    def large(tables: dict[str, DataFrame]) -> DataFrame:
        return tables["part"].where("p_size > 40").select(F.lit("CUSTOM001").alias("id"), F.lit("LOW").alias("severity"), _text(F.col("p_partkey")).alias("subject"))

    part = read(spark, sf_dir, "part")
    known = part.select(F.lit("OAS001").alias("id"), F.lit("HIGH").alias("severity"), _text(F.col("p_partkey")).alias("subject"))
    return workspace.run_checks({"part": part}, known, own)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "j14_repo_edges": edges,
    "g9_repo_blast": blast,
    "j12_twin_drift": twins,
    "a30_state_views": states,
    "j20_upstreams": resolved,
    "j19_deployment_chain": chain,
    "c17_error_conformance": conformance,
    "c18_version_signals": versions,
    "a24_baseline_register": register,
    "u2_custom_checks": custom,
}

ORACLES = {
    "j14_repo_edges": """WITH p AS (SELECT p_partkey AS k, 'r' || (p_partkey % 50) AS own, CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, '/v1/a' || p_partkey || '/{id}' AS path FROM part),
      e AS (SELECT 'IMPLEMENTS' AS kind, 'r' || (k % 49) AS from_repo, own AS to_repo, m || ' ' || path AS subject FROM p
        UNION SELECT 'CALLS', 'r' || (k % 47), own, m || ' ' || path FROM p WHERE k % 3 <> 0 OR m = 'GET'
        UNION SELECT 'ROUTES', 'r' || (k % 7), own, m || ' ' || path FROM p WHERE k % 5 = 0
        UNION SELECT 'IMPORTS', 'r' || (i.p_partkey % 11), p.own, 'lib-' || i.p_partkey FROM p JOIN part i ON i.p_partkey = p.k // 4)
      SELECT * FROM e WHERE from_repo <> to_repo""",
    "g9_repo_blast": """WITH RECURSIVE e AS (SELECT DISTINCT 'n' || l_partkey AS f, 'n' || (l_partkey // 3 + l_suppkey % 2) AS t, 'x' || (l_suppkey % 3) AS s FROM lineitem),
      c AS (SELECT 'n' || p_partkey AS repo, 'x' || (p_partkey % 4) AS subject FROM part),
      w AS (SELECT c.repo, c.subject, e.f AS dependent, 1 AS hops FROM c JOIN e ON e.t = c.repo AND e.s = c.subject
        UNION SELECT w.repo, w.subject, e.f, w.hops + 1 FROM w JOIN e ON e.t = w.dependent WHERE w.hops < 25),
      l AS (SELECT repo, subject, dependent, min(hops) AS hops FROM w WHERE dependent <> repo GROUP BY ALL)
      SELECT repo, subject, dependent, hops FROM c LEFT JOIN l USING (repo, subject)""",
    "j12_twin_drift": """WITH d AS (SELECT DISTINCT p_partkey AS k FROM part), i AS (SELECT DISTINCT p_partkey + 9 AS k FROM part), o AS (SELECT DISTINCT c_custkey AS k FROM customer), g AS (SELECT DISTINCT s_suppkey + 500 AS k FROM supplier)
      SELECT 'declared_not_implemented' AS kind, 'o' || k AS subject FROM d WHERE k NOT IN (SELECT k FROM i) UNION ALL SELECT 'implemented_not_declared', 'o' || k FROM i WHERE k NOT IN (SELECT k FROM d)
      UNION ALL SELECT 'observed_not_declared', 'o' || k FROM o WHERE k NOT IN (SELECT k FROM d) UNION ALL SELECT 'routed_not_declared', 'o' || k FROM g WHERE k NOT IN (SELECT k FROM d)""",
    "a30_state_views": """WITH f AS (SELECT DISTINCT 'o' || p_partkey AS i FROM part ORDER BY 1 LIMIT 64)
      SELECT 'declared' AS state, TRUE AS present, (SELECT count(*) FROM part) AS records, TRUE AS hashed, string_agg(i, ',' ORDER BY i) AS identifiers FROM f UNION ALL SELECT 'desired', FALSE, 0, FALSE, ''""",
    "j20_upstreams": r"""WITH h AS (SELECT page_id AS k, lower(regexp_replace(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), ':\d+$', '')) AS host FROM pages),
      s AS (SELECT host, min('s' || k) AS service FROM h WHERE k % 3 = 0 GROUP BY 1)
      SELECT '/r' || k AS path, service, service IS NULL AS unresolved FROM h LEFT JOIN s ON s.host = h.host AND k % 5 <> 0""",
    "j19_deployment_chain": """WITH p AS (SELECT p_partkey AS k, p_brand AS namespace FROM part),
      b AS (SELECT namespace, k, unnest([k, k + 1]) AS s FROM p WHERE k % 4 <> 0 UNION ALL SELECT namespace, k, NULL FROM p WHERE k % 4 = 0)
      SELECT b.namespace, 'i' || b.k AS ingress, 's' || p.k AS service, CASE WHEN p.k % 3 <> 0 AND p.k % 5 <> 0 THEN 'd' || p.k END AS deployment FROM b LEFT JOIN p ON p.namespace = b.namespace AND p.k = b.s""",
    "c17_error_conformance": """SELECT p_partkey AS operation, CASE WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' WHEN p_partkey % 2 <> 0 OR p_partkey % 3 = 0 THEN 'VIOLATION' ELSE 'CONFORMS' END AS verdict,
      CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 <> 0 THEN 'problem' ELSE '' END AS missing_types, CASE WHEN p_partkey % 3 = 0 THEN 'detail' ELSE '' END AS missing_fields FROM part""",
    "c18_version_signals": """SELECT p_partkey AS operation, 'URI' AS mechanism, 'v' || (p_partkey % 9) AS version FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, 'HEADER', 'X-API-Version' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'MEDIA_TYPE', 'v' || (p_partkey % 4) FROM part WHERE p_partkey % 5 = 0""",
    "a24_baseline_register": f"""WITH {governance.OPS_SQL},
      r AS (SELECT project, side, list_sort(list(method || '|' || coalesce(operation_id, ''))) AS rows FROM ops GROUP BY ALL)
      SELECT project AS contract, any_value(len(rows)) AS elements, string_agg(DISTINCT side, ',' ORDER BY side) AS labels FROM r GROUP BY project, rows""",
    "u2_custom_checks": """SELECT 'OAS001' AS id, 'HIGH' AS severity, CAST(p_partkey AS VARCHAR) AS subject, NULL AS "check" FROM part
      UNION ALL SELECT 'CUSTOM001', 'LOW', CAST(p_partkey AS VARCHAR), 'large-parts' FROM part WHERE p_size > 40""",
}

"""Queries over scenarios, remediation, policies, capabilities and declared graphs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.jobs.evidence import _text
from spanloom.operators import planning
from spanloom.sources.views import read


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")

    def rule(metric: str, op: str, value: float) -> F.Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(op).alias("op"), F.lit(value).alias("value"))

    baselines = part.where(k % 5 != 0).select(_text("r", k).alias("route"), (k % 20).alias("p50"), (k % 20 + 5).alias("p90"), (k % 20 * 2).alias("p95"), (k % 20 * 3).alias("p99"))
    asked = F.array_compact(F.array(F.when(k % 4 != 0, rule("p95", "<=", 40.0)), F.when(k % 6 == 0, rule("cpu", "<", 1.0))))
    experiments = part.select(
        _text("e", k).alias("name"), _text("r", k).alias("route"), F.create_map(F.lit("p95"), F.lit(1.0) + k % 3 / 2).alias("adjustments"),
        F.when(k % 12 == 0, F.create_map(F.lit("cpu"), F.lit(0.5))).alias("rates"), F.when(k % 2 == 0, k).alias("payload_bytes"), asked.alias("constraints"),
        F.when(k % 7 == 0, rule("p50", ">=", 10.0)).when(k % 11 == 0, rule("payload_bytes", ">", 50.0)).alias("hypothesis"),
    )
    return planning.scenarios(experiments, baselines).withColumn("violated", F.array_join("violated", ","))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    names = F.array(*(F.lit(x) for x in ("OAS001", "RELAPI002", "APISEC006", "OAS020", "UNKNOWN1")))
    rows = read(spark, sf_dir, "documents").select(_text("s", F.floor(k / 2)).alias("subject"), F.element_at(names, (k % 5 + 1).cast("int")).alias("id"))
    return planning.fix_classes(rows)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, _text("/public/", k)).when(k % 3 == 1, _text("/internal/a/", k)).otherwise(_text("/intern/", k))
    ops = read(spark, sf_dir, "part").select(
        k.alias("subject"), path.alias("path"), (k % 2 == 0).alias("has_security"), F.when(k % 5 != 0, _text("op", k)).alias("operation_id"), F.when(k % 7 != 0, "team").alias("owner")
    )
    rows = [("P1", "auth", ["/internal/*"]), ("P2", "operation_id", []), ("P3", "owner", ["/public", "/intern*"]), ("P4", "auth", ["/none"])]
    return planning.policy_violations(ops, spark.createDataFrame(rows, "policy string, requires string, applies_to array<string>"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, "RETRY").when(k % 3 == 0, "GRPC_CLIENT").otherwise("HEALTH_CHECK")
    return read(spark, sf_dir, "supplier").select(name.alias("capability"), F.col("s_nationkey").alias("source"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("SAFE_RETRY", "RETRY", "IDEMPOTENCY"), ("GRPC_CLIENT_HEALTH", "GRPC_CLIENT", "HEALTH_CHECK"), ("NOT_MET", "CACHE", "VARY")]
    rules = spark.createDataFrame(rows, "rule string, trigger string, requires string")
    return planning.capability_gaps(planning.capabilities(evidence(spark, sf_dir)), rules)


def graph_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    routes = part.select(_text("s", k % 9).alias("service"), _text("h", k).alias("handler"), F.lit("get").alias("method"), _text("/a", F.floor(k / 2), "/{x}/").alias("path"), k.alias("place"))
    sites = part.select(_text("c", k % 4).alias("client"), F.lit("GET").alias("method"), _text("/a", k % 30, "/{}").alias("path"), k.alias("place"))
    contents = part.select(
        F.col("p_brand").alias("project"), F.lit("d").alias("doc"), _text("op", F.floor(k / 3)).alias("operation"), F.when(k % 2 == 0, "REQUEST").otherwise("RESPONSE").alias("side"), _text("S", k % 40).alias("name"), k.alias("place")
    )
    schemas = part.where("p_partkey % 40 < 25").select(F.col("p_brand").alias("project"), F.lit("d").alias("doc"), _text("S", k % 40).alias("name")).distinct()
    return routes, sites, contents, schemas


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.declared_graph(*graph_parts(spark, sf_dir))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(_text("s", F.col("l_suppkey")).alias("source"), F.lit("CALLS").alias("kind"), _text("p", F.col("l_partkey") % 50).alias("target"), F.lit("trace").alias("evidence_kind"), _text(F.col("l_orderkey")).alias("place"))
    return planning.flat_edges(lines, lines, 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p14_scenarios": scenarios,
    "j23_fix_classes": fixes,
    "c16_policy_violations": policies,
    "c21_capability_gaps": gaps,
    "g2_declared_graph": declared,
    "g7_flat_edges": flat,
}

ORACLES = {
    "p14_scenarios": """WITH e AS (SELECT p_partkey AS k, p_partkey % 20 * 2 * (1 + p_partkey % 3 / 2.0) AS p95 FROM part),
      f AS (SELECT *, k % 5 <> 0 AS known, k % 4 <> 0 AND p95 > 40 AS violated, k % 6 = 0 AND k % 12 <> 0 AS open_ended,
        CASE WHEN k % 7 = 0 THEN k % 20 >= 10 WHEN k % 11 = 0 AND k % 2 = 0 THEN k > 50 END AS believed, k % 7 = 0 OR k % 11 = 0 AS has FROM e)
      SELECT 'e' || k AS name, CASE WHEN NOT known THEN 'INCONCLUSIVE' WHEN violated THEN 'CONSTRAINT_VIOLATED' WHEN NOT believed THEN 'NOT_SUPPORTED'
        WHEN open_ended OR (has AND believed IS NULL) THEN 'INCONCLUSIVE' WHEN k % 4 = 0 AND k % 6 <> 0 AND NOT has THEN 'INCONCLUSIVE' ELSE 'SUPPORTED' END AS verdict,
        CASE WHEN known THEN CASE WHEN violated THEN 'p95' ELSE '' END END AS violated FROM f""",
    "j23_fix_classes": """SELECT 's' || (doc_id // 2) AS subject, CASE max(CASE doc_id % 5 WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END) WHEN 1 THEN 'SAFE' WHEN 2 THEN 'REVIEW_REQUIRED' ELSE 'MANUAL_ONLY' END AS class,
      count(*) AS findings FROM documents GROUP BY 1""",
    "c16_policy_violations": """SELECT 'P1' AS policy, p_partkey AS subject FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 <> 0
      UNION ALL SELECT 'P2', p_partkey FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'P3', p_partkey FROM part WHERE p_partkey % 7 = 0""",
    "c21_capability_gaps": """WITH c AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'RETRY' WHEN s_suppkey % 3 = 0 THEN 'GRPC_CLIENT' ELSE 'HEALTH_CHECK' END AS c FROM supplier),
      r(rule, trigger, requires) AS (VALUES ('SAFE_RETRY', 'RETRY', 'IDEMPOTENCY'), ('GRPC_CLIENT_HEALTH', 'GRPC_CLIENT', 'HEALTH_CHECK'), ('NOT_MET', 'CACHE', 'VARY'))
      SELECT * FROM r WHERE trigger IN (SELECT c FROM c) AND requires NOT IN (SELECT c FROM c)""",
    "g2_declared_graph": """WITH p AS (SELECT p_partkey AS k, p_brand AS b FROM part), e AS (
      SELECT 'service:s' || (k % 9) AS source, 'EXPOSES' AS kind, 'endpoint:GET /a' || (k // 2) || '/{}' AS target, k FROM p
      UNION ALL SELECT 'operation:h' || k, 'IMPLEMENTS', 'endpoint:GET /a' || (k // 2) || '/{}', k FROM p
      UNION ALL SELECT 'client:c' || (k % 4), 'CONSUMES', 'endpoint:GET /a' || (k % 30) || '/{}', k FROM p
      UNION ALL SELECT 'api:' || b || '#d', 'EXPOSES', 'operation:op' || (k // 3), k FROM p
      UNION ALL SELECT 'operation:op' || (k // 3), CASE WHEN k % 2 = 0 THEN 'ACCEPTS' ELSE 'RETURNS' END, 'schema:' || b || '#d#S' || (k % 40), k FROM p WHERE k % 40 < 25)
      SELECT source, kind, target, count(DISTINCT k) AS places, min(k) AS first FROM e GROUP BY ALL""",
    "g7_flat_edges": """WITH d AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || (l_partkey % 50) AS t, 'trace:' || l_orderkey AS id FROM lineitem),
      r AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY id) AS pos, count(*) OVER (PARTITION BY s, t) AS n FROM d)
      SELECT s || '|CALLS|' || t || '|' || string_agg(id, ',' ORDER BY id) FILTER (pos <= 3) AS line, greatest(0, any_value(n) - 3) AS more FROM r GROUP BY s, t""",
}

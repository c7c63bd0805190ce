"""Queries over configuration-like views of the provided tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.jobs import governance
from spanloom.operators import rules
from spanloom.sources.views import read

Query = Callable[[SparkSession, str], DataFrame]


def idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    supports = F.when(k % 3 == 0, None).otherwise(k % 5 != 0)
    return rules.idempotency(part.select((k % 300).alias("subject"), supports.alias("supports")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = lines(spark, sf_dir).select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("hop"))
    k = F.col("s_suppkey")
    policies = read(spark, sf_dir, "supplier").where(k % 7 != 0).select(
        k.alias("scope"), (k % 3 + 1).alias("max_attempts"), F.array(F.lit(503), (F.lit(500) + k % 2 * 2).cast("int")).alias("statuses")
    )
    hops = hops.groupBy("chain", "position").agg(F.min("hop").alias("hop"))
    found = rules.retry_amplification(hops, policies)
    return found.withColumn("overlap", F.array_join(F.col("overlap").cast("array<string>"), ","))


def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    edges = lines(spark, sf_dir).select(
        k.alias("caller"), F.when(k % 3 != 0, F.lit(60.0) + k % 100).alias("caller_ms"), F.col("l_suppkey").alias("downstream"),
        F.when(F.col("l_partkey") % 6 != 0, F.col("l_quantity")).alias("ms"),
    )
    return rules.timeout_budget(edges)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    source = F.element_at(F.array(*(F.lit(s) for s in ("service-config", "codeowners", "extension", "rumour"))), (k % 4 + 1).cast("int"))
    hits = read(spark, sf_dir, "customer").select((k % 400).alias("subject"), source.alias("source"), F.col("c_nationkey").alias("owner"))
    return rules.owner(hits)


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, line = read(spark, sf_dir, "orders"), lines(spark, sf_dir)
    key = F.col("o_orderkey")
    changes = order.select(key.alias("change"), F.array(key, key + 3).alias("entities"))
    seen = line.groupBy(F.col("l_orderkey").alias("regression")).agg(
        F.array(F.col("l_orderkey"), F.col("l_orderkey") + F.min("l_linenumber") % 4, F.floor(F.col("l_orderkey") / 2)).alias("entities")
    )
    found = rules.correlations(changes, seen)
    return found.withColumn("shared", F.array_join(F.col("shared").cast("array<string>"), ","))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("R1", "Brand#1*", "2030-01-01", "ok"), ("R1", "*", "2020-01-01", "ok"), ("R2", "Brand#22", "2030-01-01", "ok"), ("R2", "Brand#23", "2030-01-01", "Pending"), ("R3", "*", "soon", "ok"), ("R4", "*", "2030-01-01", "yes")]
    exceptions = spark.createDataFrame(rows, "rule string, scope string, expires string, approval string")
    part = read(spark, sf_dir, "part")
    found = part.select(F.concat(F.lit("R"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("rule"), F.col("p_brand").alias("subject"), "p_partkey")
    return rules.violations(found, exceptions, "2025-01-01")


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    name = F.element_at(F.array(F.lit("APISEC001"), F.lit("POLICY002"), F.lit("OAS003")), (k % 3 + 1).cast("int"))
    trust = F.element_at(F.array(F.lit("HIGH"), F.lit("LOW"), F.lit("UNKNOWN"), F.lit("MEDIUM")), (k % 4 + 1).cast("int"))
    changes = governance.operation_diff(spark, sf_dir)
    return rules.gate(docs.select(name.alias("id"), trust.alias("confidence")), changes)


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("project"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("operation_id"))
    return rules.doubled_operation_ids(rows)


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    path = F.concat(F.lit("/a/{id}"), F.when(k % 2 == 0, "/b/{key}").otherwise(""))
    one = part.select(k.alias("op"), F.when(k % 5 != 0, "id").alias("name"), F.when(k % 7 == 0, "query").otherwise("path").alias("location_in"), (k % 11 != 0).alias("required"))
    other = part.select(k.alias("op"), F.lit("key").alias("name"), F.when(k % 3 == 0, "query").otherwise("path").alias("location_in"), F.lit(True).alias("required"))
    return rules.path_parameter_issues(part.select(k.alias("op"), path.alias("path")), one.union(other))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    path = F.concat(F.lit("/v"), (k % 6).cast("string"), F.lit("/p"), (k % 271).cast("string"))
    return rules.version_pairs(part.select(k.alias("unit"), path.alias("path")))


def pull_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    impact = read(spark, sf_dir, "pages").select((F.col("page_id") % 37).alias("client"))
    changes, k = governance.operation_diff(spark, sf_dir), F.col("s_suppkey")
    kind = F.when(F.col("kind") == "endpoint_added", "ENDPOINT_ADDED").otherwise(F.upper("kind"))
    settings = read(spark, sf_dir, "supplier").select(
        F.element_at(F.array(*(F.lit(t) for t in SETTING_TYPES)), (k % 5 + 1).cast("int")).alias("type"),
        F.when(k % 6 == 0, "UNKNOWN").otherwise("NON_BREAKING").alias("classification"), F.concat(F.lit("svc"), (k % 20).cast("string")).alias("subject"),
    )
    rows = changes.select(kind.alias("type"), "classification", "subject").union(settings)
    objectives = spark.createDataFrame([(f"svc{i}",) for i in range(0, 20, 4)], "name string")
    return rules.pull_request(rows, impact, objectives, 2)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select((k % 300).alias("rule"), F.floor(k / 300).cast("int").alias("level_rank"), (k * 7 % 4).cast("int").alias("strength"))
    return rules.effective_policies(rows, read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 300).alias("rule")))


SETTING_TYPES = ("DEPENDENCY_CHANGED", "TIMEOUT_CHANGED", "RETRY_CHANGED", "AUTH_CHANGED", "RATE_LIMIT_CHANGED")


def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    expires = F.when(k % 4 == 0, "2020-01-01").when(k % 4 == 1, "soon").otherwise("2030-06-30T00:00")
    approval = F.when(k % 3 == 0, " Pending ").when(k % 3 == 1, "board")
    exceptions = read(spark, sf_dir, "customer").select(F.concat(F.lit("R"), k.cast("string")).alias("rule"), F.lit("*").alias("scope"), expires.alias("expires"), approval.alias("approval"))
    files = read(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 5 == 0, "unreadable").alias("issue")).where("issue is not null")
    return rules.policy_issues(exceptions, policies(spark, sf_dir), files.withColumnRenamed("n_name", "file"), "2025-01-01")


DIFF_SQL = governance.ORACLES["j1_operation_diff"]

POLICIES_SQL = """WITH p AS (SELECT c_custkey % 300 AS rule, CAST(c_custkey // 300 AS INTEGER) AS r, CAST(c_custkey * 7 % 4 AS INTEGER) AS s FROM customer),
      e AS (SELECT rule, max(r) AS hi, min(r) AS lo, arg_max(s, r) AS narrow, arg_min(s, r) AS wide FROM p GROUP BY 1),
      f AS (SELECT *, narrow < wide AND rule NOT IN (SELECT s_suppkey % 300 FROM supplier) AS issue FROM e)
      SELECT rule, CASE WHEN issue THEN lo ELSE hi END AS level_rank, CASE WHEN issue THEN wide ELSE narrow END AS strength, issue FROM f"""

QUERIES: dict[str, Query] = {
    "a20_idempotency": idempotency,
    "a21_retry_amplification": amplification,
    "a22_timeout_budget": timeouts,
    "a25_pull_request": pull_request,
    "c2_doubled_operation_ids": doubled,
    "c6_path_parameters": parameters,
    "j17_correlations": correlations,
    "j22_violations": violations,
    "p11_gate": gate,
    "c16_policy_issues": policy_findings,
    "w12_effective_policies": policies,
    "w13_owners": owners,
    "w15_version_pairs": versions,
}

ORACLES = {
    "a20_idempotency": """SELECT p_partkey % 300 AS subject, CASE WHEN count(s) = 0 THEN 'UNKNOWN' WHEN bool_and(s) THEN 'IDEMPOTENT' ELSE 'NON_IDEMPOTENT' END AS verdict
      FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 5 <> 0 END AS s FROM part) GROUP BY 1""",
    "a21_retry_amplification": """WITH h AS (SELECT l_orderkey AS chain, l_linenumber, min(l_suppkey) AS hop FROM lineitem GROUP BY ALL),
      p AS (SELECT s_suppkey AS scope, s_suppkey % 3 + 1 AS n, 500 + s_suppkey % 2 * 2 AS other FROM supplier WHERE s_suppkey % 7 <> 0)
      SELECT chain, CASE WHEN count(*) = count(scope) THEN CAST(round(product(n)) AS BIGINT) END AS attempts,
        CASE WHEN count(scope) = 0 THEN '' WHEN min(other) = max(other) THEN min(other) || CASE WHEN min(other) = 503 THEN '' ELSE ',503' END ELSE '503' END AS overlap
      FROM h LEFT JOIN p ON hop = scope GROUP BY chain""",
    "a22_timeout_budget": """WITH s AS (SELECT l_orderkey AS caller, max(CASE WHEN l_orderkey % 3 <> 0 THEN 60.0 + l_orderkey % 100 END) AS lim,
        sum(ms) AS sequential, max(ms) AS parallel, count(*) - count(ms) AS open
        FROM (SELECT l_orderkey, CASE WHEN l_partkey % 6 <> 0 THEN l_quantity END AS ms FROM lineitem) GROUP BY 1)
      SELECT caller, sequential, parallel, CASE WHEN lim IS NULL OR parallel IS NULL THEN 'UNKNOWN' WHEN parallel > lim THEN 'IMPOSSIBLE'
        WHEN sequential > lim OR open > 0 THEN 'AT_RISK' ELSE 'FEASIBLE' END AS verdict FROM s""",
    "a25_pull_request": f"""SELECT count(*) FILTER (classification = 'BREAKING') AS breaking, count(*) FILTER (kind = 'endpoint_added') AS new_endpoints,
      (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 3) AS auth_changes,
      (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0 OR (s_suppkey % 5 IN (1, 2, 4) AND s_suppkey % 20 % 4 = 0)) AS slo_relevant,
      (SELECT count(*) FROM supplier WHERE s_suppkey % 6 = 0) + count(*) FILTER (classification = 'UNKNOWN') + 2 AS unknowns, (SELECT count(DISTINCT page_id % 37) FROM pages) AS clients FROM ({DIFF_SQL})""",
    "c2_doubled_operation_ids": "SELECT p_brand AS project, p_size AS operation_id, count(*) AS uses FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL HAVING count(*) > 1",
    "c6_path_parameters": """WITH p AS (SELECT p_partkey AS k FROM part)
      SELECT 'OAS013' AS id, k AS op, 'id' AS name FROM p WHERE k % 5 = 0
      UNION ALL SELECT 'OAS012', k, 'id' FROM p WHERE k % 5 <> 0 AND (k % 7 = 0 OR k % 11 = 0)
      UNION ALL SELECT 'OAS012', k, 'key' FROM p WHERE (k % 2 = 0 AND k % 3 = 0) OR (k % 2 <> 0 AND k % 3 <> 0)""",
    "j17_correlations": """WITH c AS (SELECT DISTINCT o_orderkey AS change, unnest([o_orderkey, o_orderkey + 3]) AS e FROM orders),
      r AS (SELECT DISTINCT l_orderkey AS regression, unnest([l_orderkey, l_orderkey + min(l_linenumber) % 4, l_orderkey // 2]) AS e FROM lineitem GROUP BY l_orderkey)
      SELECT change, regression, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS shared FROM c JOIN r USING (e) GROUP BY ALL""",
    "j22_violations": """SELECT 'R' || (p_partkey % 4 + 1) AS rule, p_brand AS subject, p_partkey FROM part
      WHERE CASE p_partkey % 4 WHEN 0 THEN NOT starts_with(p_brand, 'Brand#1') WHEN 1 THEN p_brand <> 'Brand#22' WHEN 2 THEN TRUE ELSE FALSE END""",
    "c16_policy_issues": f"""SELECT 'POLICY008' AS id, 'R' || c_custkey || ' *' AS subject, CASE WHEN c_custkey % 4 = 1 THEN 'not_a_date' WHEN c_custkey % 4 = 0 THEN 'expired' ELSE 'not_approved' END AS detail
      FROM customer WHERE c_custkey % 4 < 2 OR c_custkey % 3 <> 1
      UNION ALL SELECT 'POLICY009', CAST(rule AS VARCHAR), 'widened' FROM ({POLICIES_SQL}) WHERE issue
      UNION ALL SELECT 'POLICY010', n_name, 'unreadable' FROM nation WHERE n_nationkey % 5 = 0""",
    "p11_gate": f"""SELECT 'breaking' AS category, count(*) AS n FROM ({DIFF_SQL}) WHERE classification = 'BREAKING' HAVING count(*) > 0
      UNION ALL SELECT 'security', count(*) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'policy', count(*) FROM documents WHERE doc_id % 3 = 1 AND doc_id % 4 <> 2 HAVING count(*) > 0""",
    "w12_effective_policies": POLICIES_SQL,
    "w13_owners": """WITH h AS (SELECT c_custkey % 400 AS subject, CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 END AS rank, c_nationkey AS owner FROM customer)
      SELECT subject, arg_min(owner, (rank, owner)) AS owner FROM h WHERE rank IS NOT NULL GROUP BY subject""",
    "w15_version_pairs": """WITH r AS (SELECT p_partkey AS unit, p_partkey % 6 AS v, '/p' || (p_partkey % 271) AS tail FROM part),
      s AS (SELECT tail, v, lead(v) OVER (PARTITION BY tail ORDER BY v) AS next FROM (SELECT DISTINCT tail, v FROM r))
      SELECT a.unit AS earlier, b.unit AS later, a.tail FROM r a JOIN s ON s.tail = a.tail AND s.v = a.v JOIN r b ON b.tail = s.tail AND b.v = s.next""",
}

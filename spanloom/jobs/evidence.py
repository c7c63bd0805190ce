"""Queries over declared reliability and security evidence, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.jobs.tracing import SPANS_SQL
from spanloom.operators import assembly, reliability, security
from spanloom.sources.views import read, spans


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call from each supplier to the parts of its lines."""
    return read(spark, sf_dir, "lineitem").select(_text("v", F.col("l_suppkey")).alias("caller"), _text("v", F.col("l_partkey")).alias("callee"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry policies by scope: a service, an edge, or an edge to somewhere else."""
    k = F.col("p_partkey")
    scope = F.when(k % 4 == 0, _text("v", k)).when(k % 4 == 1, _text("v", F.floor(k / 8) + 1, "->v", k)).when(k % 4 == 2, _text("v", k, " -> x"))
    return read(spark, sf_dir, "part").select(scope.alias("scope"), (k % 3 + 1).alias("max_attempts")).where("scope is not null")


def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    scope = F.when(k % 3 == 0, _text("v", k)).when(k % 3 == 1, _text("v", F.floor(k / 8) + 1, "->v", k))
    return read(spark, sf_dir, "part").select(scope.alias("scope"), (k % 90).alias("ms"), (k % 5 == 0).alias("propagated")).where("scope is not null")


POLICY_SQL = """e AS (SELECT DISTINCT 'v' || l_suppkey AS caller, 'v' || l_partkey AS callee FROM lineitem),
p0 AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'v' || p_partkey WHEN 1 THEN 'v' || (p_partkey // 8 + 1) || '->v' || p_partkey WHEN 2 THEN 'v' || p_partkey || ' -> x' END AS scope,
    p_partkey % 3 + 1 AS n FROM part),
p AS (SELECT scope, max(n) AS n FROM p0 WHERE scope IS NOT NULL GROUP BY scope),
q AS (SELECT trim(split_part(scope, '->', 1)) AS caller, arg_min(n, scope) AS n, min(scope) AS scope FROM p WHERE scope LIKE '%->%' GROUP BY 1),
t AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'v' || p_partkey WHEN 1 THEN 'v' || (p_partkey // 8 + 1) || '->v' || p_partkey END AS scope, p_partkey % 90 AS ms, p_partkey % 5 = 0 AS propagated FROM part),
bound AS (SELECT e.caller, e.callee, CASE WHEN a.scope IS NOT NULL THEN a.scope WHEN b.scope IS NOT NULL THEN b.scope ELSE q.scope END AS scope,
    CASE WHEN a.scope IS NOT NULL THEN a.n WHEN b.scope IS NOT NULL THEN b.n ELSE q.n END AS n
  FROM e LEFT JOIN p a ON a.scope = e.caller LEFT JOIN p b ON b.scope = e.caller || '->' || e.callee LEFT JOIN q ON q.caller = e.caller)"""


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reliability.bound_policies(edges(spark, sf_dir), policies(spark, sf_dir))
    return found.select("caller", "callee", "policy.scope", F.col("policy.max_attempts").alias("n"))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.depth_checks(edges(spark, sf_dir), policies(spark, sf_dir), timeouts(spark, sf_dir))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part")
    verdicts = part.select(F.when(k % 8 == 0, _text("v", k)).when(k % 8 == 3, _text("POST /p", k)).otherwise(_text("id", k)).alias("subject"), F.when(k % 16 < 9, "IDEMPOTENT").otherwise("UNKNOWN").alias("verdict"))
    ops = part.select(F.when(k % 2 == 0, "GET").otherwise("post").alias("method"), _text("/p", k).alias("path"), _text("id", k + 1).alias("identity"))
    tables = {
        "retries": policies(spark, sf_dir), "timeouts": timeouts(spark, sf_dir),
        "chains": edges(spark, sf_dir).distinct().select("caller", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.col("caller").alias("scope")), F.struct(F.lit(2).alias("place"), F.col("callee").alias("scope")))).alias("c")).select(F.col("caller").alias("chain"), "c.*").distinct(),
        "breakers": part.limit(0), "health": part, "shutdown": part.limit(0), "idempotency": verdicts,
    }
    return reliability.reliability_issues(tables, ops)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return reliability.observability_issues(assembly.observability(rows), rows)


PATHS = ("/users/{user_id}/x", "/admin/y", "/items/z", "/files/{name}/w", "/items/{id}/v", "/open/u")
INPUTS = ("limit", "callback", "Cursor", "offset", "q", "size")


def secured_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.element_at(F.array(*(F.lit(p) for p in PATHS)), (k % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), _text(path, k).alias("path"),
        F.when(k % 11 == 0, F.lit("adminReset")).when(k % 13 == 0, F.lit("do-admin-x")).alias("operation_id"),
        (k % 3 == 0).alias("anonymous"), (k % 5 == 0).alias("sensitive"), (k % 7 == 0).alias("deprecated"), (k % 4 == 0).alias("collection"), k.alias("k"),
    )


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, k = secured_operations(spark, sf_dir), F.col("k")
    name = F.element_at(F.array(*(F.lit(n) for n in INPUTS)), (k % 6 + 1).cast("int"))
    where = F.when(k % 8 == 1, "path").otherwise("query")
    inputs = ops.select("project", "method", "path", name.alias("name"), where.alias("location_in"))
    grants = ops.where(k % 9 == 0).select("project", F.concat_ws(" ", "method", "path").alias("scope")).union(
        ops.where(k % 10 == 0).select("project", "path")
    ).union(read(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select("p_brand", F.lit("*")).distinct())
    limits = ops.select("project", F.lit("/items").alias("scope")).distinct().where("project <> 'Brand#22'")
    return security.operation_risks(ops, inputs, grants, limits)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, k = secured_operations(spark, sf_dir), F.col("k")
    name = F.element_at(F.array(*(F.lit(n) for n in INPUTS)), (k % 6 + 1).cast("int"))
    return security.pagination(ops, ops.where(k % 7 != 0).select("project", "method", "path", name.alias("name")))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project has no routes, one no gateway, one a gateway for all and one for a prefix."""
    ops, k = secured_operations(spark, sf_dir), F.col("k")
    contract = ops.select("project", "method", "path", F.when(k % 5 != 0, k % 2 == 0).alias("requires"))
    routes = ops.where((k % 3 != 0) & (F.col("project") != "Brand#12")).select("project", F.lower("method").alias("method"), "path", (k % 8 > 3).alias("guarded"))
    renamed = F.regexp_replace("path", r"\{[a-z_]+\}", "{x}")
    guards = ops.where((k % 28 == 0) & ~F.col("project").isin("Brand#21", "Brand#22", "Brand#31")).select("project", _text(renamed, "/").alias("subject"))
    for project, subject in (("Brand#21", "/admin"), ("Brand#31", "*")):
        guards = guards.union(ops.where(F.col("project") == project).select("project", F.lit(subject)).distinct())
    return security.auth_planes(contract, routes, guards)


OPS_SQL = f"""o AS (SELECT p_brand AS project, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, {list(PATHS)}[k % 6 + 1] || k AS path, {list(INPUTS)}[k % 6 + 1] AS name, k
  FROM (SELECT *, p_partkey AS k FROM part))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "j15_policy_bindings": bindings,
    "j16_depth_checks": depth,
    "c11_reliability_issues": gaps,
    "c12_observability_issues": observed,
    "c9_operation_risks": risks,
    "c19_pagination": pages,
    "j13_auth_planes": planes,
}

ORACLES = {
    "j15_policy_bindings": f"WITH {POLICY_SQL} SELECT caller, callee, scope, n FROM bound",
    "j16_depth_checks": f"""WITH {POLICY_SQL},
      ends AS (SELECT c.callee, CASE WHEN a.scope IS NOT NULL THEN a.n ELSE q.n END AS n FROM (SELECT DISTINCT callee FROM e) c LEFT JOIN p a ON a.scope = c.callee LEFT JOIN q ON q.caller = c.callee),
      l AS (SELECT scope, min(ms) AS ms FROM t WHERE scope IS NOT NULL GROUP BY scope),
      x AS (SELECT e.*, a.scope IS NOT NULL OR b.scope IS NOT NULL AS declared, CASE WHEN a.scope IS NOT NULL THEN a.ms ELSE b.ms END AS mine, c.scope IS NOT NULL AS has, c.ms AS theirs
        FROM e LEFT JOIN l a ON a.scope = e.caller LEFT JOIN l b ON b.scope = e.caller || '->' || e.callee LEFT JOIN l c ON c.scope = e.callee)
      SELECT 'APIREL001' AS id, caller, callee, CAST(bound.n * ends.n AS DOUBLE) AS bound FROM bound JOIN ends USING (callee) WHERE bound.n > 1 AND ends.n > 1
      UNION ALL SELECT 'APIREL002', caller, callee, CASE WHEN has THEN CAST(theirs AS DOUBLE) END FROM x WHERE declared AND (NOT has OR mine < theirs)""",
    "c11_reliability_issues": f"""WITH {POLICY_SQL}, r AS (SELECT * FROM p), tm AS (SELECT scope, min(ms) AS ms FROM t WHERE scope IS NOT NULL GROUP BY scope),
      safe AS (SELECT DISTINCT CASE WHEN p_partkey % 8 = 0 THEN 'v' || p_partkey WHEN p_partkey % 8 = 3 THEN 'POST /p' || p_partkey ELSE 'id' || p_partkey END AS s FROM part WHERE p_partkey % 16 < 9)
      SELECT 'RELAPI001' AS id, string_agg(n || '^' || times, '*' ORDER BY n) AS subject FROM (SELECT n, count(*) AS times FROM r WHERE n > 1 GROUP BY n)
      UNION ALL SELECT 'RELAPI003', caller || ' ' || verdict FROM (SELECT e.caller, CASE WHEN max(a.ms) IS NULL OR max(b.ms) IS NULL THEN 'UNKNOWN' WHEN max(b.ms) > max(a.ms) THEN 'IMPOSSIBLE'
        WHEN sum(b.ms) > max(a.ms) OR count(*) > count(b.ms) THEN 'AT_RISK' END AS verdict FROM e LEFT JOIN tm a ON a.scope = e.caller LEFT JOIN tm b ON b.scope = e.callee GROUP BY e.caller) WHERE verdict <> 'UNKNOWN'
      UNION ALL SELECT 'RELAPI002', scope FROM r WHERE scope NOT IN (SELECT s FROM safe)
      UNION ALL SELECT 'RELAPI004', scope FROM t WHERE scope IS NOT NULL GROUP BY scope HAVING NOT bool_or(propagated)
      UNION ALL SELECT unnest(['RELAPI005', 'RELAPI007']), '(config)'
      UNION ALL SELECT 'RELAPI008', 'id' || (p_partkey + 1) FROM part WHERE p_partkey % 2 = 1 AND 'id' || (p_partkey + 1) NOT IN (SELECT s FROM safe) AND 'POST /p' || p_partkey NOT IN (SELECT s FROM safe)""",
    "c12_observability_issues": f"""{SPANS_SQL}, n AS (SELECT count(DISTINCT operation) AS names, CAST(bool_or(contains(operation, '-')) AS INT) + CAST(bool_or(contains(operation, '_')) AS INT) AS styles FROM spans)
      SELECT 'OBSAPI002' AS id, count(*) FILTER (lost) AS n FROM spans HAVING count(*) FILTER (lost) > 0
      UNION ALL SELECT 'OBSAPI004', count(*) FILTER (status = 'error') FROM spans HAVING count(*) FILTER (status = 'error') > 0
      UNION ALL SELECT 'OBSAPI005', count(*) FILTER (duration_ms IS NULL) FROM spans HAVING count(*) FILTER (duration_ms IS NULL) > 0
      UNION ALL SELECT 'OBSAPI003', styles FROM n WHERE names > 2 AND styles > 1""",
    "c9_operation_risks": f"""WITH {OPS_SQL}, g AS (SELECT *, k % 9 = 0 OR k % 10 = 0 OR project = 'Brand#11' AS granted, k % 6 IN (2, 4) AND contains(path, '/items/') AND project <> 'Brand#22' AS limited FROM o)
      SELECT project, 'APISEC001' AS id, method, path FROM g WHERE NOT granted AND k % 6 IN (0, 4)
      UNION ALL SELECT project, 'APISEC002', method, path FROM g WHERE NOT granted AND (k % 6 = 1 OR (k % 13 = 0 AND k % 11 <> 0))
      UNION ALL SELECT project, 'APISEC003', method, path FROM g WHERE k % 15 = 0
      UNION ALL SELECT project, 'APISEC005', method, path FROM g WHERE k % 3 = 0 AND NOT limited
      UNION ALL SELECT project, 'APISEC006', method, path FROM g WHERE k % 4 = 0 AND NOT (k % 6 IN (0, 2, 5))
      UNION ALL SELECT project, 'APISEC007', method, path FROM g WHERE k % 6 = 1 AND k % 8 <> 1
      UNION ALL SELECT project, 'APISEC009', method, path FROM g WHERE k % 7 = 0""",
    "c19_pagination": f"""WITH {OPS_SQL}, n AS (SELECT *, CASE WHEN k % 7 <> 0 THEN lower(name) END AS given FROM o)
      SELECT project, method, path, CASE WHEN given = 'cursor' THEN 'CURSOR' WHEN given IN ('limit', 'offset', 'size') THEN 'OFFSET' ELSE 'NONE' END AS kind,
        CASE WHEN given = 'offset' THEN FALSE WHEN given IN ('cursor', 'limit', 'size') THEN TRUE END AS bounded FROM n""",
    "j13_auth_planes": f"""WITH {OPS_SQL}, f AS (SELECT *, regexp_replace(path, '\\{{[^}}]*\\}}', '{{}}', 'g') AS form, CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END AS contract FROM o),
      r AS (SELECT project, method, form, bool_or(k % 8 > 3) AS guarded FROM f WHERE k % 3 <> 0 AND project <> 'Brand#12' GROUP BY ALL),
      g AS (SELECT DISTINCT project, form AS subject FROM f WHERE k % 28 = 0 AND project NOT IN ('Brand#21', 'Brand#22', 'Brand#31')
        UNION SELECT project, '/admin' FROM f WHERE project = 'Brand#21' UNION SELECT project, '*' FROM f WHERE project = 'Brand#31'),
      a AS (SELECT f.*, coalesce(r.guarded, CASE WHEN f.project IN (SELECT project FROM r) THEN FALSE END) AS implementation,
        CASE WHEN f.project IN (SELECT project FROM g) THEN EXISTS (SELECT 1 FROM g WHERE g.project = f.project AND (subject = '*' OR contains(f.form, subject) OR contains(subject, f.form))) END AS gateway
        FROM f LEFT JOIN r ON r.project = f.project AND r.method = f.method AND r.form = f.form),
      b AS (SELECT *, coalesce(contract, FALSE) AS declared, coalesce(implementation, FALSE) OR coalesce(gateway, FALSE) AS enforced,
        list_distinct(list_filter([contract, implementation, gateway], lambda x: x IS NOT NULL)) AS known FROM a)
      SELECT project, method, path, contract, implementation, gateway, len(known) > 1 AS drift,
        CASE WHEN declared AND enforced THEN 'COMPLETE' WHEN declared <> enforced THEN 'BROKEN' ELSE 'UNKNOWN' END AS chain,
        CASE WHEN implementation THEN 'implementation' WHEN gateway THEN 'gateway' WHEN declared THEN 'contract-only' ELSE 'none' END AS enforced_at
      FROM b WHERE len(known) > 0""",
}

"""Queries over contract versions, snapshots and fleets, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.jobs.traffic import rounded
from spanloom.operators import contracts, delta, drift, fleet
from spanloom.sources.views import read

METHODS = ("GET", "POST", "PUT", "DELETE")


def operations(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Operations made of parts: a project per brand, a path per part number; the new version
    drops every 11th part and gains every 13th."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kept = part.where(k % 11 != 0) if new else part.where(k % 13 != 0)
    method = F.element_at(F.array(*(F.lit(m) for m in METHODS)), (k % 4 + 1).cast("int"))
    variable = "{key}" if new else "{id}"
    return kept.select(
        F.col("p_brand").alias("project"),
        method.alias("method"),
        F.concat(F.lit("/v1/p"), (k % 40).cast("string"), F.lit(f"/{variable}/"), F.col("p_size").cast("string"), F.when(k % 3 == 0, "/").otherwise("")).alias("path"),
        F.when(k % 5 == 0, F.concat(F.lit("op"), k.cast("string"))).alias("operation_id"),
        (k % 2 == 0).alias("has_security"),
        (k % 7).alias("k"),
        F.col("p_partkey").alias("key"),
    )


OPS_SQL = """
ops AS (SELECT v.side, p_brand AS project, ['GET', 'POST', 'PUT', 'DELETE'][p_partkey % 4 + 1] AS method,
    '/v1/p' || (p_partkey % 40) || '/{}/' || p_size AS norm_path,
    '/v1/p' || (p_partkey % 40) || '/{' || CASE WHEN v.side = 'old' THEN 'id' ELSE 'key' END || '}/' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END AS path,
    CASE WHEN p_partkey % 5 = 0 THEN 'op' || p_partkey END AS operation_id, p_partkey % 2 = 0 AS has_security, p_partkey AS key
  FROM part, (VALUES ('old'), ('new')) v(side)
  WHERE CASE WHEN v.side = 'old' THEN p_partkey % 13 <> 0 ELSE p_partkey % 11 <> 0 END),
named AS (SELECT *, coalesce('operation_id:' || operation_id, 'method_path:' || method || ' ' || path) AS identity FROM ops),
a AS (SELECT project, method, norm_path, min(identity) AS was FROM named WHERE side = 'old' GROUP BY ALL),
b AS (SELECT project, method, norm_path, min(identity) AS now FROM named WHERE side = 'new' GROUP BY ALL)"""


#: One operation per key and side, and the operations of both sides.
UNIQUE_SQL = f"""WITH {OPS_SQL},
u AS (SELECT side, project, method, norm_path, min(identity) AS identity, arg_min(path, (identity, key)) AS path, arg_min(key, (identity, key)) % 7 AS k,
    arg_min(has_security, (identity, key)) AS has_security, arg_min(operation_id, (identity, key)) AS operation_id FROM named GROUP BY ALL),
o AS (SELECT * FROM u WHERE side = 'old'), n AS (SELECT * FROM u WHERE side = 'new'),
pairs AS (SELECT project, method, norm_path, o.identity AS subject, o.path AS old_path FROM o JOIN n USING (project, method, norm_path))"""


def unique(df: DataFrame) -> DataFrame:
    """One operation per (project, method, normalised path): the one with the smallest
    identity, as a contract has."""
    rows = contracts.keyed(df)
    key = ["project", "method", "norm_path"]
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct("identity", "key")).alias("of")).select("project", "method", "of.*").drop("norm_path", "identity")


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return unique(operations(spark, sf_dir, False)), unique(operations(spark, sf_dir, True))


def operation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.operation_changes(*pair(spark, sf_dir))


def elements(df: DataFrame, new: bool) -> DataFrame:
    """Parameters of operations: up to four, of which the new version renames and requires some."""
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("new" if new else "old"))
    return df.select(
        "project", "method", "path", "k", F.posexplode(names).alias("i", "name")
    ).where((F.col("i") + F.col("k")) % 3 != (1 if new else 0)).select(
        "project", "method", "path", "name", F.lit("query").alias("location_in"), ((F.col("i") + F.col("k")) % (2 if new else 4) == 0).alias("required")
    )


def parameter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = pair(spark, sf_dir)
    return contracts.parameter_changes(contracts.paired(old, new), elements(old, False), elements(new, True))


def content(df: DataFrame, new: bool) -> DataFrame:
    kinds = [F.lit(t) for t in ("application/json", "text/csv", "text/xml")]
    types = F.filter(F.array(*kinds), lambda t: (F.length(t) + F.col("k")) % 3 != (1 if new else 2))
    return df.where(F.col("k") != (3 if new else 5)).select("project", "method", "path", "k", types.alias("content_types"))


def body_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = pair(spark, sf_dir)
    return contracts.body_changes(contracts.paired(old, new), content(old, False), content(new, True))


def response_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = pair(spark, sf_dir)

    def responses(df: DataFrame, fresh: bool) -> DataFrame:
        rows = content(df, fresh).withColumn("status", F.explode(F.array(F.lit("200"), F.lit("404"))))
        return rows.where((F.col("status") == "200") | ((F.col("k") % 2 == 0) != fresh))

    return contracts.response_changes(contracts.paired(old, new), responses(old, False), responses(new, True))


def security_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = pair(spark, sf_dir)

    def effective(df: DataFrame, fresh: bool) -> DataFrame:
        own = contracts.keyed(df).where("has_security").select("project", F.col("identity").alias("owner"), F.when(F.col("k") % 2 == int(fresh), F.array(F.lit("key"))).otherwise(F.array(F.lit("key"), F.lit("oauth"))).alias("schemes"))
        whole = df.select("project", F.lit("").alias("owner"), F.array(F.lit("key")).alias("schemes")).distinct()
        return contracts.effective_security(df, own.unionByName(whole.where(F.lit(fresh))))

    return contracts.security_changes(contracts.paired(old, new), effective(old, False), effective(new, True))


def compat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.findings(operation_diff(spark, sf_dir)).groupBy("project", "id", "severity").agg(F.count("*").alias("n"))


def contract_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of old contracts equal those of the same rows in another order."""
    old = operations(spark, sf_dir, False).select("project", "method", "path")
    return contracts.fingerprints(old, "project")


def page_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as call sites of templates with one and two segments."""
    rows = [("en", None, "/en/{id}", "BREAKING", "f1"), ("de", "GET", "/de/{id}", "BREAKING", "f9"), ("any", None, "/{x}", "POTENTIALLY_BREAKING", None), ("none", None, "/fr/{id}", "NON_BREAKING", None)]
    changes = spark.createDataFrame(rows, "subject string, method string, template string, classification string, field string")
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    sites = read(spark, sf_dir, "pages").select(
        F.concat(F.lit("c"), (F.col("page_id") % 7).cast("string")).alias("client"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("site_method"),
        path.alias("path"), F.array(F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string"))).alias("fields"),
    )
    return contracts.client_impact(changes, sites).groupBy("id", "client", "subject", "classification").agg(F.count("*").alias("sites"))


def drift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = pair(spark, sf_dir)
    routes = new.select("project", "method", "path", F.concat(F.lit("app."), F.coalesce("operation_id", "path")).alias("handler"))
    return drift.pairs(old, routes).groupBy("how", F.col("op").isNotNull().alias("documented")).agg(F.count("*").alias("n"))


def snapshot(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Findings made of documents: an id per source, the subject per document; the new snapshot
    lacks some, has others and gives some more evidence."""
    docs = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    kept = docs.where(k % 10 != 0) if new else docs.where(k % 9 != 0)
    return kept.select(
        F.concat(F.lit("CHECK"), (k % 5).cast("string")).alias("id"),
        F.when(k % 17 != 0, F.array(F.concat(F.lit("e"), (k % 500).cast("string")))).otherwise(F.array().cast("array<string>")).alias("entity_ids"),
        (F.length("text") % 3 + F.when(F.lit(new) & (k % 4 == 0), 1).otherwise(0)).cast("int").alias("evidence"),
        k.alias("place"),
        F.element_at(F.array(F.lit("CRITICAL"), F.lit("HIGH"), F.lit("LOW")), (k % 3 + 1).cast("int")).alias("severity"),
    )


SNAP_SQL = """
snap AS (SELECT v.side, 'CHECK' || (doc_id % 5) || '|' || CASE WHEN doc_id % 17 <> 0 THEN 'e' || (doc_id % 500) ELSE '' END AS key,
    CAST(length(text) % 3 + CASE WHEN v.side = 'new' AND doc_id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS evidence, doc_id AS place,
    ['CRITICAL', 'HIGH', 'LOW'][doc_id % 3 + 1] AS severity
  FROM documents, (VALUES ('old'), ('new')) v(side)
  WHERE CASE WHEN v.side = 'old' THEN doc_id % 9 <> 0 ELSE doc_id % 10 <> 0 END),
last AS (SELECT side, key, arg_max(evidence, place) AS evidence, arg_max(severity, place) AS severity FROM snap GROUP BY ALL)"""


def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (delta.keyed_findings(snapshot(spark, sf_dir, x)) for x in (False, True))
    return delta.changes(old, new)


def snapshot_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keys(new: bool) -> DataFrame:
        rows = snapshot(spark, sf_dir, new)
        subject = F.coalesce(F.try_element_at("entity_ids", F.lit(1)), F.lit(""))
        keyed = rows.withColumn("key", F.concat("id", F.lit("|"), subject))
        return keyed.groupBy("key").agg(F.max_by("severity", "place").alias("severity"))

    return delta.snapshot_regressions(keys(False), keys(True))


def shape_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    old = docs.select(F.lit("domain").alias("kind"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("source")).alias("name"))
    new = docs.select(F.lit("domain").alias("kind"), F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.col("source")).alias("name"))
    return delta.transitions(old, new)


def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a snapshot, of the same rows in another order, and whether they agree."""
    rows = snapshot(spark, sf_dir, False)
    one = delta.snapshot_id(rows, ("evidence",))
    other = delta.snapshot_id(rows.repartition(5, "severity"), ("evidence",))
    return one.select("rows", F.lit("rows").alias("of")).join(other.select(F.col("snapshot_id").alias("o"), F.lit("rows").alias("of")), "of").join(
        one.select("snapshot_id", F.lit("rows").alias("of")), "of"
    ).select("rows", (F.col("o") == F.col("snapshot_id")).alias("same"))


def repo_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations(spark, sf_dir, False)
    return rows.select(
        F.col("project").alias("repo"), F.col("k").alias("api"), "has_security", "operation_id",
        F.when(F.col("key") % 3 == 0, F.lit("text")).alias("description"),
    )


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    k = F.col("page_id")
    return pages.select(
        F.concat(F.lit("Brand#"), (k % 30).cast("string")).alias("repo"), F.col("url").alias("host"),
        F.when(k % 2 == 0, k).alias("timeout_ms"), F.when(k % 3 != 0, k % 5 == 0).alias("has_retry"), (k % 7 == 0).alias("has_auth"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 20).cast("string")).alias("repo"), F.col("s_nationkey").alias("owner")
    ).groupBy("repo").agg(F.min("owner").alias("owner"))


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.shared_hosts(external(spark, sf_dir)).withColumn("repos", F.array_join("repos", ","))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fleet.external_gaps(external(spark, sf_dir))
    return found.groupBy(F.array_join("gaps", ",").alias("gaps")).agg(F.count("*").alias("n"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    scenario = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    entry = F.when(F.col("doc_id") % 4 == 0, "DRIFT*").otherwise(F.concat(F.lit("COMPAT00"), (F.col("doc_id") % 3).cast("string")))
    seen = F.when(F.col("doc_id") % 4 == 0, "DRIFT001").otherwise(F.concat(F.lit("COMPAT00"), (F.col("doc_id") % 3 + F.col("toxic")).cast("string")))
    return rounded(fleet.check_scores(
        labels.where("quality = 1").select(scenario.alias("scenario"), entry.alias("entry")),
        labels.select(scenario.alias("scenario"), seen.alias("check_id")),
    ))


def lacking_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.without_security(repo_operations(spark, sf_dir)).groupBy("repo", "api").agg(F.count("*").alias("n"))


def sunsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    versions = orders.select(
        k.alias("repo"), F.col("o_orderpriority").alias("version"), (k % 3 != 0).alias("deprecated"),
        F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("sunset"),
        F.lit("1996-01-01").cast("date").alias("today"),
    )
    return fleet.deprecated(versions)


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations(spark, sf_dir, False)
    ops = rows.select(F.col("project").alias("repo"), (F.col("k") % 3).alias("style"), F.when(F.col("key") % 50 == 0, "key").otherwise("oauth").alias("auth"))
    gateways = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 70).alias("route"), F.col("s_nationkey").alias("gateway"))
    return fleet.complexity(ops, external(spark, sf_dir), gateways)


def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    old, new = (F.concat(F.lit("e"), n.cast("string")) for n in (F.floor(F.col("page_id") / 2), F.col("page_id")))
    return delta.key_changes(pages.select(old.alias("key")), pages.select(new.alias("key")))


REPO_SQL = """WITH ops AS (SELECT p_brand AS repo, p_partkey % 7 AS api, p_partkey % 2 = 0 AS has_security,
    CASE WHEN p_partkey % 5 = 0 THEN 1 END AS operation_id, CASE WHEN p_partkey % 3 = 0 THEN 1 END AS description FROM part WHERE p_partkey % 13 <> 0),
external AS (SELECT 'Brand#' || (page_id % 30) AS repo, url, lower(regexp_replace(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), ':\\d+$', '')) AS host,
    page_id AS k FROM pages),
owners AS (SELECT 'Brand#' || (s_suppkey % 20) AS repo, min(s_nationkey) AS owner FROM supplier GROUP BY 1)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "j1_operation_diff": operation_diff,
    "j2_parameter_diff": parameter_diff,
    "j3_body_diff": body_diff,
    "j3_response_diff": response_diff,
    "j4_security_diff": security_diff,
    "j6_compat_findings": compat_findings,
    "j8_client_impact": page_impact,
    "j10_drift": drift_pairs,
    "a23_fingerprints": contract_prints,
    "a26_check_scores": scores,
    "d1_snapshot_delta": snapshot_delta,
    "d5_transitions": shape_transitions,
    "d6_snapshot_regressions": snapshot_worse,
    "s8_snapshot_ids": snapshot_ids,
    "l1_public_apis": lambda spark, sf_dir: fleet.public_apis(repo_operations(spark, sf_dir)),
    "l2_unowned": lambda spark, sf_dir: fleet.unowned(repo_operations(spark, sf_dir), owners(spark, sf_dir)),
    "d4_key_changes": source_changes,
    "l3_without_security": lacking_security,
    "l4_deprecated": sunsets,
    "l7_complexity": complexity,
    "l5_shared_hosts": shared,
    "l6_portfolio": lambda spark, sf_dir: fleet.portfolio(repo_operations(spark, sf_dir), external(spark, sf_dir), owners(spark, sf_dir)),
    "l8_quality": lambda spark, sf_dir: fleet.quality(repo_operations(spark, sf_dir)),
    "l9_external_gaps": gaps,
}

CONTENT_SQL = f"""{UNIQUE_SQL},
c AS (SELECT *, list_filter(['application/json', 'text/csv', 'text/xml'], lambda t: (length(t) + k) % 3 <> CASE side WHEN 'new' THEN 1 ELSE 2 END) AS types
  FROM u WHERE k <> CASE side WHEN 'new' THEN 3 ELSE 5 END)"""

ORACLES = {
    "j2_parameter_diff": f"""{UNIQUE_SQL},
      p AS (SELECT side, project, method, norm_path, CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE side END AS name,
          (i + k) % CASE side WHEN 'new' THEN 2 ELSE 4 END = 0 AS required
        FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM u) WHERE (i + k) % 3 <> CASE side WHEN 'new' THEN 1 ELSE 0 END),
      f AS (SELECT project, method, norm_path, name, a.required AS was, b.required AS now
        FROM (SELECT * FROM p WHERE side = 'old') a FULL JOIN (SELECT * FROM p WHERE side = 'new') b USING (project, method, norm_path, name)),
      d AS (SELECT *, CASE WHEN now IS NULL THEN 'param_removed' WHEN was IS NULL AND NOT now THEN 'param_added_optional' WHEN NOT coalesce(was, FALSE) AND now THEN 'param_added_required' END AS kind FROM f)
      SELECT project, kind, CASE kind WHEN 'param_added_optional' THEN 'POTENTIALLY_BREAKING' ELSE 'BREAKING' END AS classification, 'REQUEST' AS side, subject,
        old_path || '#query/' || name AS path FROM d JOIN pairs USING (project, method, norm_path) WHERE kind IS NOT NULL""",
    "j3_body_diff": f"""{CONTENT_SQL},
      f AS (SELECT project, method, norm_path, a.types AS was, b.types AS now FROM (SELECT * FROM c WHERE side = 'old') a FULL JOIN (SELECT * FROM c WHERE side = 'new') b USING (project, method, norm_path)),
      d AS (SELECT *, unnest(CASE WHEN now IS NULL OR was IS NULL THEN [''] ELSE list_transform(list_filter(was, lambda x: NOT list_contains(now, x)), lambda x: '/' || x) END) AS type FROM f)
      SELECT project, CASE WHEN now IS NULL THEN 'param_removed' WHEN was IS NULL THEN 'request_body_added' ELSE 'content_type_removed' END AS kind,
        CASE WHEN was IS NULL THEN 'POTENTIALLY_BREAKING' ELSE 'BREAKING' END AS classification, 'REQUEST' AS side, subject, old_path || '#requestBody' || type AS path
      FROM d JOIN pairs USING (project, method, norm_path)""",
    "j3_response_diff": f"""{CONTENT_SQL},
      r AS (SELECT * FROM (SELECT *, unnest(['200', '404']) AS status FROM c) WHERE status = '200' OR (k % 2 = 0) = (side = 'old')),
      f AS (SELECT a.project, a.method, a.norm_path, a.status, a.types AS was, b.types AS now FROM r a LEFT JOIN r b ON b.side = 'new' AND b.project = a.project AND b.method = a.method AND b.norm_path = a.norm_path AND b.status = a.status WHERE a.side = 'old'),
      d AS (SELECT *, unnest(CASE WHEN now IS NULL THEN [''] ELSE list_transform(list_filter(was, lambda x: NOT list_contains(now, x)), lambda x: '/' || x) END) AS type FROM f)
      SELECT project, CASE WHEN now IS NULL THEN 'status_removed' ELSE 'content_type_removed' END AS kind, 'BREAKING' AS classification, 'RESPONSE' AS side, subject,
        old_path || '#responses/' || status || type AS path FROM d JOIN pairs USING (project, method, norm_path)""",
    "j4_security_diff": f"""{UNIQUE_SQL},
      s AS (SELECT *, CASE WHEN has_security AND (k % 2 = 1) = (side = 'new') THEN ['key'] WHEN has_security THEN ['key', 'oauth'] WHEN side = 'new' THEN ['key'] ELSE [] END AS need FROM u),
      f AS (SELECT a.project, a.method, a.norm_path, a.need AS was, b.need AS now FROM s a JOIN s b ON a.side = 'old' AND b.side = 'new' AND b.project = a.project AND b.method = a.method AND b.norm_path = a.norm_path)
      SELECT project, CASE WHEN list_has_all(was, now) THEN 'auth_loosened' ELSE 'auth_tightened' END AS kind, CASE WHEN list_has_all(was, now) THEN 'NON_BREAKING' ELSE 'BREAKING' END AS classification,
        'META' AS side, subject, old_path || '#security' AS path FROM f JOIN pairs USING (project, method, norm_path) WHERE was <> now""",
    "j10_drift": f"""{UNIQUE_SQL}, m AS (SELECT count(*) AS c FROM pairs),
      lost AS (SELECT o.* FROM o ANTI JOIN n USING (project, method, norm_path)), extra AS (SELECT n.*, coalesce(operation_id, path) AS tail FROM n ANTI JOIN o USING (project, method, norm_path)),
      byname AS (SELECT count(*) AS c FROM (SELECT DISTINCT project, operation_id FROM lost) l JOIN (SELECT DISTINCT project, tail FROM extra) e ON e.project = l.project AND e.tail = l.operation_id)
      SELECT * FROM (SELECT 'path' AS how, TRUE AS documented, c AS n FROM m UNION ALL SELECT 'identity', TRUE, c FROM byname
        UNION ALL SELECT 'none', TRUE, (SELECT count(*) FROM lost) - c FROM byname UNION ALL SELECT 'none', FALSE, (SELECT count(*) FROM extra) - c FROM byname) WHERE n > 0""",
    "a23_fingerprints": f"""WITH {OPS_SQL},
      r AS (SELECT project AS contract, sha256('{{"method":"' || method || '","path":"' || path || '"}}') AS part FROM ops WHERE side = 'old'),
      l0 AS (SELECT contract, part, part AS digest, count(*) AS n FROM r GROUP BY ALL),
      l1 AS (SELECT contract, left(part, 8) AS p, sha256(string_agg(part || ':' || digest || ':' || n, ',' ORDER BY part)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM l0 GROUP BY ALL),
      l2 AS (SELECT contract, left(p, 6) AS q, sha256(string_agg(p || ':' || digest || ':' || n, ',' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM l1 GROUP BY ALL),
      l3 AS (SELECT contract, left(q, 4) AS p, sha256(string_agg(q || ':' || digest || ':' || n, ',' ORDER BY q)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM l2 GROUP BY ALL),
      l4 AS (SELECT contract, left(p, 2) AS q, sha256(string_agg(p || ':' || digest || ':' || n, ',' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM l3 GROUP BY ALL)
      SELECT contract, sha256(string_agg(q || ':' || digest || ':' || n, ',' ORDER BY q)) AS fingerprint, CAST(sum(n) AS BIGINT) AS elements FROM l4 GROUP BY contract""",
    "j1_operation_diff": f"""WITH {OPS_SQL},
      pairs AS (SELECT * FROM a FULL JOIN b USING (project, method, norm_path)),
      paths AS (SELECT project, norm_path, count(was) > 0 AS had, count(now) > 0 AS has, arg_min(was, method) AS w, arg_min(now, method) AS n FROM pairs GROUP BY ALL)
      SELECT project, 'endpoint_removed' AS kind, 'BREAKING' AS classification, 'META' AS side, w AS subject, norm_path AS path FROM paths WHERE NOT has
      UNION ALL SELECT project, 'endpoint_added', 'POTENTIALLY_BREAKING', 'META', n, norm_path FROM paths WHERE NOT had
      UNION ALL SELECT b.project, CASE WHEN now IS NULL THEN 'method_removed' ELSE 'endpoint_added' END, CASE WHEN now IS NULL THEN 'BREAKING' ELSE 'POTENTIALLY_BREAKING' END,
        'META', coalesce(was, now), b.norm_path FROM pairs b JOIN paths p ON p.project = b.project AND p.norm_path = b.norm_path AND had AND has WHERE was IS NULL OR now IS NULL""",
    "j6_compat_findings": f"""WITH {OPS_SQL},
      pairs AS (SELECT * FROM a FULL JOIN b USING (project, method, norm_path)),
      paths AS (SELECT project, norm_path, count(was) > 0 AS had, count(now) > 0 AS has FROM pairs GROUP BY ALL),
      f AS (SELECT project, 'COMPAT001' AS id, 'HIGH' AS severity FROM paths WHERE NOT has UNION ALL SELECT project, 'COMPAT021', 'INFO' FROM paths WHERE NOT had
        UNION ALL SELECT b.project, CASE WHEN now IS NULL THEN 'COMPAT002' ELSE 'COMPAT021' END, CASE WHEN now IS NULL THEN 'HIGH' ELSE 'INFO' END
        FROM pairs b JOIN paths p ON p.project = b.project AND p.norm_path = b.norm_path AND had AND has WHERE was IS NULL OR now IS NULL)
      SELECT project, id, severity, count(*) AS n FROM f GROUP BY ALL""",
    "j8_client_impact": r"""WITH s AS (SELECT 'c' || (page_id % 7) AS client, page_id % 2 = 0 AS get, page_id % 3 = 1 AS f1,
        string_split(trim(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/'), '/') AS p,
        trim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') <> '' AS has_path FROM pages),
      m AS (SELECT 'CLIENT00' || CASE WHEN f1 THEN 1 ELSE 2 END AS id, client, 'en' AS subject, 'BREAKING' AS classification FROM s WHERE len(p) >= 2 AND p[-2] = 'en'
        UNION ALL SELECT 'CLIENT002', client, 'de', 'BREAKING' FROM s WHERE len(p) >= 2 AND p[-2] = 'de' AND get
        UNION ALL SELECT 'CLIENT002', client, 'any', 'POTENTIALLY_BREAKING' FROM s WHERE has_path)
      SELECT id, client, subject, classification, count(*) AS sites FROM m GROUP BY ALL""",
    "d1_snapshot_delta": f"""WITH {SNAP_SQL},
      o AS (SELECT * FROM last WHERE side = 'old'), n AS (SELECT * FROM last WHERE side = 'new')
      SELECT key, CASE WHEN o.side IS NULL THEN 'added' WHEN n.side IS NULL THEN 'removed' ELSE 'changed' END AS change,
        greatest(0, coalesce(n.evidence, 0) - coalesce(o.evidence, 0)) AS evidence_added, greatest(0, coalesce(o.evidence, 0) - coalesce(n.evidence, 0)) AS evidence_removed
      FROM o FULL JOIN n USING (key) WHERE o.side IS NULL OR n.side IS NULL OR o.evidence <> n.evidence OR o.severity <> n.severity""",
    "d5_transitions": """WITH o AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE source END AS name FROM documents),
      n AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN lang ELSE source END AS name FROM documents)
      SELECT '+domain:' || name AS transition FROM n WHERE name NOT IN (SELECT name FROM o)
      UNION ALL SELECT '-domain:' || name FROM o WHERE name NOT IN (SELECT name FROM n)""",
    "d6_snapshot_regressions": f"""WITH {SNAP_SQL} SELECT 'APITEMP002' AS id, key, severity FROM last WHERE side = 'new' AND severity <> 'LOW'
      AND key NOT IN (SELECT key FROM last WHERE side = 'old')""",
    "s8_snapshot_ids": "SELECT count(*) AS rows, TRUE AS same FROM documents WHERE doc_id % 9 <> 0",
    "a26_check_scores": """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'DRIFT' ELSE 'COMPAT' END AS family,
          CASE WHEN doc_id % 4 = 0 THEN 1 ELSE CAST(toxic = 0 AS INT) END AS hit, quality FROM labels),
      e AS (SELECT family, count(*) AS expected, CAST(sum(hit) AS BIGINT) AS hits FROM w WHERE quality = 1 GROUP BY 1),
      f AS (SELECT family, count(*) AS false_positives FROM w WHERE quality <> 1 OR hit = 0 GROUP BY 1)
      SELECT family, coalesce(expected, 0) AS expected, coalesce(hits, 0) AS hits, coalesce(false_positives, 0) AS false_positives,
        round(hits / (hits + coalesce(false_positives, 0)), 6) AS precision, round(hits / expected, 6) AS recall FROM e FULL JOIN f USING (family)""",
    "l1_public_apis": f"{REPO_SQL} SELECT repo, count(*) FILTER (NOT has_security) AS open, count(*) AS operations, count(*) FILTER (NOT has_security) || '/' || count(*) AS share FROM ops GROUP BY repo HAVING count(*) FILTER (NOT has_security) > 0",
    "l2_unowned": f"{REPO_SQL} SELECT DISTINCT repo FROM ops WHERE repo NOT IN (SELECT repo FROM owners)",
    "d4_key_changes": """WITH a AS (SELECT DISTINCT 'e' || (page_id // 2) AS key FROM pages), b AS (SELECT DISTINCT 'e' || page_id AS key FROM pages)
      SELECT key, CASE WHEN a.key IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b USING (key) WHERE a.key IS NULL OR b.key IS NULL""",
    "l3_without_security": f"{REPO_SQL} SELECT repo, api, count(*) AS n FROM ops WHERE NOT has_security GROUP BY ALL",
    "l4_deprecated": """SELECT o_orderkey AS repo, o_orderpriority AS version, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) END AS days_left
      FROM orders WHERE o_orderkey % 3 <> 0""",
    "l7_complexity": f"""{REPO_SQL} SELECT 'multi-protocol' AS signal, p_brand AS subject FROM part WHERE p_partkey % 13 <> 0 GROUP BY 2 HAVING count(DISTINCT p_partkey % 7 % 3) > 1
      UNION ALL SELECT 'shared-host', url FROM external GROUP BY url HAVING count(DISTINCT repo) > 1
      UNION ALL SELECT 'several-gateways', CAST(s_suppkey % 70 AS VARCHAR) FROM supplier GROUP BY 2 HAVING count(DISTINCT s_nationkey) > 1
      UNION ALL SELECT 'mixed-auth', p_brand FROM part WHERE p_partkey % 13 <> 0 GROUP BY 2 HAVING count(DISTINCT p_partkey % 50 = 0) > 1""",
    "l5_shared_hosts": f"{REPO_SQL} SELECT host, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, count(DISTINCT repo) AS n FROM external GROUP BY host HAVING count(DISTINCT repo) > 1",
    "l6_portfolio": f"""{REPO_SQL} SELECT o.repo, operations, apis, coalesce(e.n, 0) AS external, owner FROM (SELECT repo, count(*) AS operations, count(DISTINCT api) AS apis FROM ops GROUP BY 1) o
      LEFT JOIN (SELECT repo, count(DISTINCT url) AS n FROM external GROUP BY 1) e USING (repo) LEFT JOIN owners USING (repo)""",
    "l8_quality": f"""{REPO_SQL} SELECT repo, count(*) AS total, 'operation_id' AS dimension, count(operation_id) AS covered FROM ops GROUP BY repo
      UNION ALL SELECT repo, count(*), 'security', count(*) FILTER (has_security) FROM ops GROUP BY repo UNION ALL SELECT repo, count(*), 'documentation', count(description) FROM ops GROUP BY repo""",
    "l9_external_gaps": f"""{REPO_SQL}, g AS (SELECT concat_ws(',', CASE WHEN k % 2 <> 0 THEN 'no timeout' END, CASE WHEN k % 3 = 0 OR k % 5 <> 0 THEN 'no retry' END,
        CASE WHEN k % 7 <> 0 THEN 'no auth' END) AS gaps FROM external) SELECT gaps, count(*) AS n FROM g WHERE gaps <> '' GROUP BY gaps""",
}

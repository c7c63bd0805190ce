"""Queries over change events, client impact, incidents and snapshots, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import scratch
from spanloom.functions.stats import window_key
from spanloom.jobs import governance
from spanloom.jobs.evidence import _text
from spanloom.jobs.tracing import SPANS_SQL
from spanloom.jobs.traffic import DAY, V
from spanloom.operators import assembly, contracts, delta, events, fleet, graph, incidents
from spanloom.sources import logs
from spanloom.sources.views import executions, read, spans

Query = Callable[[SparkSession, str], DataFrame]


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions whose calls lead to services that have executions too."""
    calls = F.transform("downstream_calls", lambda c: c.withField("callee", F.regexp_replace(c["callee"], "dep", "svc")))
    return executions(spark, sf_dir).withColumn("downstream_calls", calls)


def regressed(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("service", F.lit("(unknown)")).alias("service"), "operation").where("operation <> 'click'").distinct()


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(spark, sf_dir)
    return incidents.cascade(rows, regressed(rows), window_key(F.col("start_unix_nano"), DAY))


def settings(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 17 == 0, None).otherwise(k % 50 + (k % 3 - 1 if new else 0))
    kept = read(spark, sf_dir, "part").where(k % (11 if new else 13) != 0)
    return kept.select(_text("svc", k % 7, F.when(k % 5 != 0, _text("->x", k)).otherwise(_text("-", k))).alias("scope"), value.alias("value"), (k % (4 if new else 2)).cast("string").alias("rest"))


def setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = settings(spark, sf_dir, False), settings(spark, sf_dir, True)
    names = [x.select(F.col("scope").alias("subject"), F.col("rest").alias("settings")) for x in (old, new)]
    limits = events.setting_events(old, new, "rate_limit", False, contracts.HARMLESS)
    return events.union(
        events.setting_events(old, new, "timeout", False), events.setting_events(old, new, "retry", True), limits,
        events.set_events(*names, "dependency"), events.contract_events(governance.operation_diff(spark, sf_dir)),
    )


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setting changes of services and of calls between them."""
    k = F.col("s_suppkey")
    subject = F.when(k % 3 == 0, _text("svc", k % 9)).otherwise(_text("svc", k % 4, "->svc", k % 7))
    kind = F.when(k % 2 == 0, "TIMEOUT_CHANGED").when(k % 5 == 0, "SCHEMA_CHANGED").otherwise("RETRY_CHANGED")
    rows = read(spark, sf_dir, "supplier")
    return rows.select(kind.alias("type"), F.lower(kind).alias("kind"), subject.alias("subject"))


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(spark, sf_dir)
    return incidents.candidates(regressed(rows), hops(spark, sf_dir), hints(spark, sf_dir))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = linked(spark, sf_dir), hops(spark, sf_dir)
    ranked = incidents.candidates(regressed(rows), found, hints(spark, sf_dir))
    return incidents.episodes(regressed(rows), found, ranked, 3).withColumn("first_affected", F.array_join("first_affected", ","))


def named_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "svc").otherwise("click-"), (F.col("s_suppkey") % 7).cast("string"), F.lit("-availability")).alias("name"))
    return incidents.objectives_of(regressed(linked(spark, sf_dir)), names.distinct())


def old_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contracts.keyed(governance.unique(governance.operations(spark, sf_dir, False)))
    declared = F.when(F.col("key") % 6 == 0, F.array(F.lit("checkout"))).otherwise(F.array().cast("array<string>"))
    return rows.select(_text(F.col("project"), "|", F.col("identity")).alias("subject"), "method", F.col("path").alias("template"), declared.alias("declared"), "key")


def changes(operations: DataFrame) -> DataFrame:
    k = F.col("key")

    def pick(*values: str) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), (k % 4 + 1).cast("int"))

    path = F.when(k % 4 == 0, _text("response[200]:Item.f", k % 3)).otherwise("response[200]:Item.rows[].g[]")
    return operations.select(
        pick("response_field_removed", "endpoint_added", "auth_loosened", "type_changed_response").alias("kind"),
        pick("BREAKING", "POTENTIALLY_BREAKING", "NON_BREAKING", "BREAKING").alias("classification"),
        F.when(k % 4 == 1, "META").otherwise("RESPONSE").alias("side"), "subject", path.alias("path"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 19 != 0, _text("/api/v1/p", k % 40, "/x", k, "/", F.col("p_size")))
    return read(spark, sf_dir, "part").select(
        k.alias("site"), _text("c", k % 7).alias("client"), F.when(k % 2 == 0, "GET").alias("site_method"), path.alias("path"),
        F.array(_text("f", k % 3), F.lit("g")).alias("fields"),
    )


def client_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = old_operations(spark, sf_dir)
    return events.client_findings(changes(ops), ops.drop("declared", "key"), sites(spark, sf_dir))


def blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = old_operations(spark, sf_dir)
    lost = changes(ops.withColumn("subject", _text("lost", F.col("key")))).where("kind = 'endpoint_added'")
    flows = spark.createDataFrame([("checkout",), ("p3",), ("v1x",)], "name string")
    found = events.blast_radius(changes(ops).union(lost), ops.drop("key"), sites(spark, sf_dir), flows)
    return found.withColumns({c: F.array_join(c, ",") for c in ("clients", "flows")})


def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.migrations(governance.operation_diff(spark, sf_dir))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("en", "/en/{id}", "2023-01-01", "2024-03-01", None), ("de", "/de/{id}", "soon", "later", "/v2/de"), ("zz", "/zz/{id}", "2020-01-01", None, "/v2/zz")]
    old = spark.createDataFrame(rows, "api string, template string, since string, sunset string, replacement string")
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    pages = read(spark, sf_dir, "pages")
    callers = pages.select(_text("c", F.col("page_id") % 7).alias("client"), path.alias("path"))
    traffic = pages.select(path.alias("route"), F.when(F.col("page_id") % 2 == 0, 1).otherwise(0).alias("requests"))
    return events.readiness(old, callers, traffic, "2024-01-01")


def operation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of two versions by identity and the digest of what they are."""
    def digests(new: bool) -> DataFrame:
        rows = contracts.keyed(governance.unique(governance.operations(spark, sf_dir, new)))
        return rows.select(
            F.concat_ws(" ", "project", "method", "norm_path").alias("key"), F.sha2(F.concat_ws("|", F.col("has_security").cast("string"), "operation_id"), 256).alias("digest"),
            F.lit(0).alias("evidence"),
        )

    return delta.changes(digests(False), digests(True)).select("key", "change")


def all_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def found(new: bool) -> DataFrame:
        rows = governance.snapshot(spark, sf_dir, new)
        subject = F.coalesce(F.try_element_at("entity_ids", F.lit(1)), F.lit(""))
        return rows.withColumn("key", F.concat("id", F.lit("|"), subject)).groupBy("key").agg(F.max_by("severity", "place").alias("severity"))

    def operations(new: bool) -> DataFrame:
        return contracts.keyed(governance.operations(spark, sf_dir, new)).select(F.concat_ws(" ", "project", "method", "norm_path").alias("key")).distinct()

    k = F.col("page_id")
    pages = read(spark, sf_dir, "pages")
    subject = F.when(k % 3 == 0, _text("contracts:", k)).when(k % 3 == 1, "routes").otherwise(_text("other:", k))
    old = pages.select(subject.alias("subject"), _text("m", k % 90).alias("missing"))
    new = pages.select(subject.alias("subject"), _text("m", k % 99).alias("missing"))
    changed = governance.operation_diff(spark, sf_dir).select("classification", F.concat_ws(":", "kind", "project", "subject").alias("key"))
    return delta.regressions(changed, (found(False), found(True)), (operations(False), operations(True)), (old, new))


def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    one = part.select(_text("e", F.col("p_partkey")).alias("id"), F.col("p_size").alias("name"))
    other = part.select(_text("e", F.floor(F.col("p_partkey") / 2)).alias("id"), F.col("p_size").alias("name"))
    return graph.conflicts(one, other)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    names = F.array(*(F.lit(x) for x in ("COMPAT001", "DRIFT002", "RELAPI003", "APISEC001", "APIPERF001", "OBSAPI002", "OAS001")))
    rows = read(spark, sf_dir, "documents").select(F.element_at(names, (k % 7 + 1).cast("int")).alias("id"), (k % 3).alias("unknowns"))
    return fleet.health(rows)


def both_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of traces and of log lines as one table, by where they come from."""
    events_ = read(spark, sf_dir, "events")
    lines = events_.select(
        F.lit("GET").alias("method"), F.when(F.col("event_id") % 9 != 0, _text("/", F.col("event_type"))).alias("path"), F.lit(200).alias("status"),
        F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 4 != 0, _text("r", F.col("event_id"))).alias("request_id"),
        F.lit(None).cast("string").alias("trace_id"), F.lit(1).cast("long").alias("bytes_sent"),
    )
    traced = assembly.executions(assembly.placed(spans(spark, sf_dir)))
    found = logs.all_executions(traced, logs.executions_of_summaries(lines))
    return found.groupBy("origin", "operation").agg(
        F.count("*").alias("n"), F.count("service").alias("services"), F.count("request_id").alias("requests"),
        F.sum(F.size("unknowns")).alias("unknowns"), F.count("timed_out").alias("timed"),
    )


def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governance.snapshot(spark, sf_dir, False).select("id", "severity", "place")
    return delta.first_rows(rows, ["id", "severity"], ["place"], 3)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots saved, listed and loaded again by label and by id prefix."""
    path = scratch(spark, "snapshots")
    for new in (False, True):
        delta.save_snapshot(governance.snapshot(spark, sf_dir, new), path, "new" if new else "old", ("evidence",))
    listed = delta.list_snapshots(spark, path)
    again = delta.save_snapshot(governance.snapshot(spark, sf_dir, False).repartition(3, "severity"), path, "again", ("evidence",))
    first = delta.load_snapshot(spark, path, again[:8])
    return first.groupBy("severity").agg(F.count("*").alias("rows"), F.max("place").alias("last")).withColumn("snapshots", F.lit(listed.count()))


R = f"""{V}, c AS (SELECT coalesce(service, '(unknown)') AS service, exec_operation AS operation, replace(callee, 'dep', 'svc') AS callee, status, retries,
    day_window = (SELECT max(day_window) FROM executions) AS now FROM calls),
one AS (SELECT service, operation, callee, count(*) FILTER (now) AS n, count(*) FILTER (NOT now) AS before, count(*) FILTER (now AND status = 'error') AS failed,
    coalesce(sum(retries) FILTER (now), 0) AS resent FROM c WHERE callee IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (now) > 0),
one_any AS (SELECT service, operation, count(*) FILTER (NOT now) AS before_any FROM c GROUP BY ALL),
whole AS (SELECT service, callee, count(*) FILTER (now) AS n, count(*) FILTER (NOT now) AS before, count(*) FILTER (now AND status = 'error') AS failed,
    coalesce(sum(retries) FILTER (now), 0) AS resent FROM c WHERE callee IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (now) > 0),
whole_any AS (SELECT service, count(*) FILTER (NOT now) AS before_any FROM c GROUP BY ALL),
starts AS (SELECT DISTINCT coalesce(service, '(unknown)') AS service, operation FROM executions WHERE operation <> 'click'),
reach AS (SELECT s.service, s.operation, o.callee AS pos FROM starts s JOIN one o USING (service, operation)
  UNION SELECT r.service, r.operation, w.callee FROM reach r JOIN whole w ON w.service = r.pos),
every AS (SELECT o.service, o.operation, o.service AS pos, callee, n, before, failed, resent, before_any FROM starts JOIN one o USING (service, operation) JOIN one_any USING (service, operation)
  UNION ALL SELECT r.service, r.operation, r.pos, w.callee, w.n, w.before, w.failed, w.resent, a.before_any FROM reach r JOIN whole w ON w.service = r.pos JOIN whole_any a ON a.service = r.pos WHERE r.pos <> r.service),
timed AS (SELECT coalesce(service, '(unknown)') AS callee, median(duration_ms) FILTER (day_window = (SELECT max(day_window) FROM executions)) AS slow,
    median(duration_ms) FILTER (day_window <> (SELECT max(day_window) FROM executions)) AS usual FROM executions WHERE duration_ms <> 0 GROUP BY 1),
signals AS (SELECT service, operation, pos AS source, callee AS hop, unnest(list_filter([CASE WHEN failed > 0 THEN 'TIMEOUT' END, CASE WHEN resent > 0 THEN 'RETRY' END,
    CASE WHEN before_any > 0 AND n > 2 * before AND n >= 8 THEN 'LOAD' END, CASE WHEN slow > 1.5 * usual THEN 'LATENCY' END], lambda x: x IS NOT NULL)) AS signal
  FROM every LEFT JOIN timed USING (callee))""".replace("WITH ", "WITH RECURSIVE ", 1)
CAUSES_SQL = f"""{R},
h AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'TIMEOUT_CHANGED' WHEN s_suppkey % 5 = 0 THEN 'SCHEMA_CHANGED' ELSE 'RETRY_CHANGED' END AS type,
    CASE WHEN s_suppkey % 3 = 0 THEN 'svc' || (s_suppkey % 9) ELSE 'svc' || (s_suppkey % 4) || '->svc' || (s_suppkey % 7) END AS subject FROM supplier),
ways AS (SELECT DISTINCT service, operation, hop FROM signals),
named AS (SELECT service, operation, h.subject, lower(type) AS kind, TRUE AS seen FROM ways JOIN h ON h.subject = hop WHERE type <> 'SCHEMA_CHANGED'
  UNION ALL SELECT service, operation, h.subject, lower(type), FALSE FROM starts JOIN h ON h.subject = service OR split_part(h.subject, '->', 1) = service WHERE type <> 'SCHEMA_CHANGED'),
causes AS (SELECT service, operation, CASE WHEN bool_or(seen) THEN 'DERIVED' ELSE 'STATIC' END AS tier, subject, kind FROM named GROUP BY service, operation, subject, kind
  UNION SELECT service, operation, 'RUNTIME', hop, 'runtime_' || lower(signal) FROM signals WHERE signal IN ('TIMEOUT', 'RETRY') AND hop NOT IN (SELECT subject FROM h)),
ranked AS (SELECT service, operation, CAST(row_number() OVER (PARTITION BY service, operation ORDER BY list_position(['DERIVED', 'RUNTIME', 'STATIC'], tier), subject, kind) AS INTEGER) AS rank, tier, subject, kind FROM causes)"""


def _settings_sql(name: str, worse: str, removed: str) -> str:
    return f"""SELECT '{name.upper()}_CHANGED' AS type, '{name}_' || CASE WHEN b.scope IS NULL THEN 'removed' WHEN a.scope IS NULL THEN 'added' ELSE 'changed' END AS kind,
      CASE WHEN a.scope IS NULL THEN 'POTENTIALLY_BREAKING' WHEN b.scope IS NULL THEN '{removed}' WHEN a.value IS NULL OR b.value IS NULL OR a.value = b.value THEN 'UNKNOWN'
        WHEN b.value {worse} a.value THEN 'POTENTIALLY_BREAKING' ELSE 'NON_BREAKING' END AS classification, coalesce(a.scope, b.scope) AS subject
      FROM s_old a FULL JOIN s_new b ON a.scope = b.scope WHERE a.scope IS NULL OR b.scope IS NULL OR a.value IS DISTINCT FROM b.value OR a.rest <> b.rest"""


SETTINGS_SQL = """s AS (SELECT p_partkey AS k, 'svc' || (p_partkey % 7) || CASE WHEN p_partkey % 5 <> 0 THEN '->x' || p_partkey ELSE '-' || p_partkey END AS scope FROM part),
s_old AS (SELECT scope, CASE WHEN k % 17 <> 0 THEN k % 50 END AS value, CAST(k % 2 AS VARCHAR) AS rest FROM s WHERE k % 13 <> 0),
s_new AS (SELECT scope, CASE WHEN k % 17 <> 0 THEN k % 50 + k % 3 - 1 END AS value, CAST(k % 4 AS VARCHAR) AS rest FROM s WHERE k % 11 <> 0)"""
KEYS_SQL = governance.UNIQUE_SQL.replace("arg_min(operation_id, (identity, key)) AS operation_id", "arg_min(operation_id, (identity, key)) AS operation_id, arg_min(key, (identity, key)) AS key")
IMPACT_SQL = f"""{KEYS_SQL},
q AS (SELECT project || '|' || identity AS subject, method, norm_path, key FROM o),
ch AS (SELECT subject, ['response_field_removed', 'endpoint_added', 'auth_loosened', 'type_changed_response'][key % 4 + 1] AS kind, CASE WHEN key % 4 = 0 THEN 'f' || (key % 3) ELSE 'g' END AS field, key FROM q WHERE key % 4 <> 2),
st AS (SELECT p_partkey AS site, 'c' || (p_partkey % 7) AS client, CASE WHEN p_partkey % 2 = 0 THEN 'GET' END AS m, '/v1/p' || (p_partkey % 40) || '/{{}}/' || p_size AS norm, 'f' || (p_partkey % 3) AS f
  FROM part WHERE p_partkey % 19 <> 0),
met AS (SELECT q.subject, site, client, f FROM q JOIN st ON norm = norm_path AND (m IS NULL OR m = method))"""

QUERIES: dict[str, Query] = {
    "g10_cascade": hops,
    "w11_candidates": causes,
    "g11_episodes": episodes,
    "g11_objectives": named_objectives,
    "j7_setting_events": setting_changes,
    "j8_client_findings": client_findings,
    "j9_blast_radius": blast,
    "a28_migrations": migrations,
    "j24_readiness": readiness,
    "d3_operation_delta": operation_delta,
    "d6_all_regressions": all_regressions,
    "d7_conflicts": conflicting,
    "a27_health": health,
    "r13_all_executions": both_executions,
    "t3_first_rows": first_evidence,
    "s8_saved_snapshots": snapshots,
}

ORACLES = {
    "g10_cascade": f"{R} SELECT * FROM signals",
    "w11_candidates": f"{CAUSES_SQL} SELECT * FROM ranked",
    "g11_episodes": f"""{CAUSES_SQL}, nodes AS (SELECT service, operation, service AS node FROM starts UNION SELECT service, operation, hop FROM signals),
      l AS (SELECT service, operation, count(*) AS affected, array_to_string(list_sort(list(node))[:3], ',') AS first_affected FROM nodes GROUP BY ALL),
      s AS (SELECT service, operation, count(*) AS signals FROM signals GROUP BY ALL), t AS (SELECT service, operation, count(*) AS candidates FROM ranked GROUP BY ALL)
      SELECT service, operation, coalesce(signals, 0) AS signals, affected, first_affected, coalesce(candidates, 0) AS candidates, tier, subject, kind
      FROM l LEFT JOIN s USING (service, operation) LEFT JOIN t USING (service, operation) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) USING (service, operation)""",
    "g11_objectives": f"""{CAUSES_SQL} SELECT DISTINCT service, operation, name AS objective FROM starts
      JOIN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'svc' ELSE 'click-' END || (s_suppkey % 7) || '-availability' AS name FROM supplier) n ON contains(name, service) OR contains(name, operation)""",
    "j7_setting_events": f"""WITH {SETTINGS_SQL}, d AS ({governance.ORACLES["j1_operation_diff"]})
      {_settings_sql("timeout", "<", "POTENTIALLY_BREAKING")} UNION ALL {_settings_sql("retry", ">", "POTENTIALLY_BREAKING")} UNION ALL {_settings_sql("rate_limit", "<", "NON_BREAKING")}
      UNION ALL SELECT 'DEPENDENCY_CHANGED', 'dependency_' || CASE WHEN b.scope IS NULL THEN 'removed' WHEN a.scope IS NULL THEN 'added' ELSE 'changed' END,
        CASE WHEN a.scope IS NULL THEN 'NON_BREAKING' WHEN b.scope IS NULL THEN 'POTENTIALLY_BREAKING' ELSE 'UNKNOWN' END, coalesce(a.scope, b.scope)
      FROM s_old a FULL JOIN s_new b ON a.scope = b.scope WHERE a.scope IS NULL OR b.scope IS NULL OR a.rest <> b.rest
      UNION ALL SELECT CASE kind WHEN 'endpoint_added' THEN 'ENDPOINT_ADDED' WHEN 'endpoint_removed' THEN 'ENDPOINT_REMOVED' ELSE 'METHOD_CHANGED' END, kind, classification, subject FROM d""",
    "j8_client_findings": f"""{IMPACT_SQL} SELECT CASE WHEN key % 4 IN (0, 3) AND (field = 'g' OR field = f) THEN 'CLIENT001' ELSE 'CLIENT002' END AS id, client, subject, kind, site FROM met JOIN ch USING (subject)
      UNION ALL SELECT 'CLIENT003', 'c' || (p_partkey % 7), NULL, NULL, p_partkey FROM part WHERE p_partkey % 19 = 0""",
    "j9_blast_radius": f"""{IMPACT_SQL}, m AS (SELECT subject, string_agg(DISTINCT client, ',' ORDER BY client) AS clients, count(DISTINCT site) AS sites FROM met GROUP BY 1)
      SELECT subject, TRUE AS known, coalesce(clients, '') AS clients, coalesce(sites, 0) AS sites,
        concat_ws(',', CASE WHEN key % 6 = 0 THEN 'checkout' END, CASE WHEN norm_path LIKE '/v1/p3/%' THEN 'p3' END) AS flows
      FROM ch JOIN (SELECT subject, norm_path FROM q) USING (subject) LEFT JOIN m USING (subject)
      UNION ALL SELECT 'lost' || key, FALSE, '', 0, '' FROM q WHERE key % 4 = 1""",
    "a28_migrations": f"""WITH d AS ({governance.ORACLES["j1_operation_diff"]}), r AS (SELECT subject, CASE kind WHEN 'endpoint_removed' THEN 5 WHEN 'method_removed' THEN 4 ELSE 2 END AS r FROM d)
      SELECT subject, ['DIRECT', 'APPROXIMATE', 'UNKNOWN', 'REDESIGN_REQUIRED', 'NO_EQUIVALENT'][max(r)] AS class, count(*) AS changes, TRUE AS sdk FROM r GROUP BY subject""",
    "j24_readiness": r"""WITH p AS (SELECT page_id, string_split(trim(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/'), '/') AS p FROM pages),
      a(api, age, rest, replacement) AS (VALUES ('en', 365, 60, NULL), ('de', NULL, NULL, '/v2/de'), ('zz', 1461, NULL, '/v2/zz')),
      c AS (SELECT p[-2] AS api, count(DISTINCT page_id % 7) AS clients, count(*) FILTER (page_id % 2 = 0) AS requests FROM p WHERE len(p) >= 2 GROUP BY 1)
      SELECT a.api, coalesce(clients, 0) AS clients, coalesce(requests, 0) AS requests, CAST(age AS INTEGER) AS age_days, CAST(rest AS INTEGER) AS sunset_in_days, replacement, CASE WHEN age IS NOT NULL THEN coalesce(clients, 0) = 0 AND coalesce(requests, 0) = 0 END AS ready FROM a LEFT JOIN c USING (api)""",
    "d3_operation_delta": f"""{governance.UNIQUE_SQL}, x AS (SELECT side, project || ' ' || method || ' ' || norm_path AS key, CAST(has_security AS VARCHAR) || '|' || coalesce(operation_id, '') AS digest FROM u),
      xo AS (SELECT * FROM x WHERE side = 'old'), xn AS (SELECT * FROM x WHERE side = 'new')
      SELECT key, CASE WHEN xo.side IS NULL THEN 'added' WHEN xn.side IS NULL THEN 'removed' ELSE 'changed' END AS change FROM xo FULL JOIN xn USING (key) WHERE xo.side IS NULL OR xn.side IS NULL OR xo.digest <> xn.digest""",
    "d6_all_regressions": f"""WITH d AS ({governance.ORACLES["j1_operation_diff"]}), f AS ({governance.ORACLES["d6_snapshot_regressions"]}), {governance.OPS_SQL.strip()},
      k AS (SELECT DISTINCT side, project || ' ' || method || ' ' || norm_path AS key FROM ops),
      s AS (SELECT page_id AS k, CASE page_id % 3 WHEN 0 THEN 'contracts:' || page_id WHEN 1 THEN 'routes' ELSE 'other:' || page_id END AS subject FROM pages)
      SELECT 'APITEMP001' AS id, kind || ':' || project || ':' || subject AS key, 'HIGH' AS severity FROM d WHERE classification = 'BREAKING'
      UNION ALL SELECT 'APITEMP002', key, 'HIGH' FROM f UNION ALL SELECT 'APITEMP003', key, 'HIGH' FROM k WHERE side = 'old' AND key NOT IN (SELECT key FROM k WHERE side = 'new')
      UNION ALL SELECT 'APITEMP004', subject || '|' || m, 'MEDIUM' FROM (SELECT DISTINCT subject, 'm' || (k % 99) AS m FROM s WHERE subject NOT LIKE 'other%' EXCEPT SELECT subject, 'm' || (k % 90) FROM s)""",
    "d7_conflicts": """WITH x AS (SELECT 'e' || p_partkey AS id, p_size FROM part UNION ALL SELECT 'e' || (p_partkey // 2), p_size FROM part)
      SELECT id, count(DISTINCT p_size) AS definitions FROM x GROUP BY id HAVING count(DISTINCT p_size) > 1""",
    "a27_health": """WITH f AS (SELECT ['breaking_changes', 'breaking_changes', 'reliability_gaps', 'security_candidates', 'runtime_regressions', 'runtime_regressions', 'other'][doc_id % 7 + 1] AS "group", doc_id % 3 AS u FROM documents)
      SELECT "group", count(*) AS findings, CAST(sum(u) AS BIGINT) AS unknowns FROM f GROUP BY 1""",
    "r13_all_executions": f"""{SPANS_SQL} SELECT 'trace' AS origin, operation, count(*) AS n, count(service) AS services, count(request_id) AS requests, 0 AS unknowns, count(code) AS timed
      FROM marked WHERE is_exec GROUP BY operation UNION ALL SELECT 'log', CASE WHEN event_id % 9 <> 0 THEN '/' || event_type ELSE '(unknown)' END, count(*), 0,
        count(*) FILTER (event_id % 4 <> 0), count(*) + count(*) FILTER (event_id % 4 = 0), 0 FROM events GROUP BY 2""",
    "t3_first_rows": """WITH s AS (SELECT 'CHECK' || (doc_id % 5) AS id, ['CRITICAL', 'HIGH', 'LOW'][doc_id % 3 + 1] AS severity, doc_id AS place FROM documents WHERE doc_id % 9 <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY id, severity ORDER BY place) AS pos, count(*) OVER (PARTITION BY id, severity) AS n FROM s)
      SELECT id, severity, place, greatest(0, n - 3) AS more FROM r WHERE pos <= 3""",
    "s8_saved_snapshots": """SELECT ['CRITICAL', 'HIGH', 'LOW'][doc_id % 3 + 1] AS severity, count(*) AS rows, max(doc_id) AS last, 2 AS snapshots FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1""",
}

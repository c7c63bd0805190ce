"""Queries over spans and service graphs, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.jobs.traffic import V, rounded
from spanloom.operators import assembly, graph
from spanloom.sources.views import executions, read, spans

SPANS_SQL = """WITH RECURSIVE s0 AS (
  SELECT 'svc' || ((conv_id + turn) % 4) AS service, role || '-op' || (turn % 3) AS operation,
    CASE WHEN turn = 0 THEN NULL WHEN conv_id % 11 = 0 AND turn = 2 THEN 'lost'
         WHEN conv_id % 13 = 0 AND turn = 1 THEN 's' || turn
         ELSE 's' || CAST(floor((turn - 1) / 2) AS BIGINT) END AS parent,
    CASE WHEN conv_id % 17 = 0 AND turn = 3 THEN 's2' ELSE 's' || turn END AS id,
    CASE WHEN conv_id % 19 <> 0 THEN 't' || conv_id ELSE '(none)' END AS tid,
    1700000000000000000 + conv_id * 1000000000 + turn * 1000000 AS start_unix_nano,
    CASE WHEN (conv_id + turn) % 7 <> 0 THEN CAST(length(text) AS DOUBLE) END AS duration_ms,
    CASE WHEN (conv_id + turn) % 6 = 0 THEN 'error' WHEN (conv_id + turn) % 3 = 0 THEN 'ok' ELSE 'unset' END AS status,
    CASE WHEN role = 'assistant' THEN 'client' WHEN conv_id % 5 = 0 AND turn > 0 THEN 'internal' ELSE 'server' END AS kind,
    CASE WHEN (conv_id + turn) % 4 = 0 THEN '504' WHEN (conv_id + turn) % 4 = 1 THEN '200' END AS code,
    CASE WHEN role = 'assistant' THEN 'svc' || ((conv_id + turn + 1) % 4) END AS callee,
    turn % 2 = 0 AS has_parent_header, conv_id % 3 = 0 AS has_request_id,
    CASE WHEN conv_id % 3 = 0 THEN 'r' || conv_id END AS request_id,
    CASE WHEN turn = 3 THEN 2 END AS retries, conv_id * 100 + turn AS place
  FROM conversations),
ids AS (SELECT DISTINCT tid, id FROM s0),
spans AS (SELECT s.*, parent IS NOT NULL AND i.id IS NULL AS lost
          FROM s0 s LEFT JOIN ids i ON i.tid = s.tid AND i.id = s.parent),
traces AS (
  SELECT tid AS trace_id, CASE WHEN count(*) FILTER (parent IS NULL) = 1 THEN max(service) FILTER (parent IS NULL) END AS root_service,
    max(coalesce(duration_ms, 0)) AS duration_ms, count(*) FILTER (status = 'error') AS errors, count(*) AS span_count,
    count(*) FILTER (lost) AS orphans,
    coalesce(bool_or(lost OR coalesce(parent = id, FALSE)), FALSE) OR count(*) FILTER (parent IS NULL) <> 1 AS incomplete
  FROM spans GROUP BY tid),
ordered AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY operation, place) AS rank FROM spans),
marked AS (
  SELECT o.*, CASE WHEN bool_or(kind = 'server') OVER (PARTITION BY tid) THEN kind = 'server'
    ELSE rank = min(CASE WHEN parent IS NULL THEN rank END) OVER (PARTITION BY tid) END AS is_exec
  FROM ordered o)"""


COUNTERS_SQL = """count(*) AS tracing, count(duration_ms) AS metrics, count(*) FILTER (has_request_id) + count(*) FILTER (has_parent_header) AS correlation_ids,
      count(*) FILTER (parent IS NOT NULL OR has_parent_header) AS trace_propagation, count(*) FILTER (status = 'error') AS errors_without_context,
      count(*) FILTER (duration_ms IS NULL) AS without_duration, count(*) FILTER (has_parent_header) AS with_traceparent, count(*) FILTER (has_request_id) AS with_x_request_id,
      0::BIGINT AS with_x_correlation_id, 0::BIGINT AS with_request_id, 0::BIGINT AS with_trace_id, 0::BIGINT AS with_b3"""
CALLS_SQL = f"""{SPANS_SQL},
      firsts AS (SELECT tid, id, arg_min(parent, rank) AS parent, arg_min(service, rank) AS service,
          arg_min(is_exec, rank) AS first_exec, bool_or(is_exec) AS any_exec, min(rank) AS rank FROM marked GROUP BY ALL),
      walk AS (SELECT m.tid, m.rank, m.parent AS at, 0 AS hops FROM marked m WHERE kind = 'client'
        UNION ALL SELECT w.tid, w.rank, f.parent, hops + 1 FROM walk w JOIN firsts f ON f.tid = w.tid AND f.id = w.at
        WHERE NOT f.any_exec AND hops < 20),
      owners AS (SELECT w.tid, w.rank, f.rank AS owner FROM walk w JOIN firsts f ON f.tid = w.tid AND f.id = w.at
        WHERE f.any_exec AND f.first_exec),
      roots AS (SELECT tid, min(rank) AS first FROM marked WHERE is_exec GROUP BY tid),
      calls AS (SELECT m.tid, e.place, o.owner IS NULL AS orphan, p.service AS caller, m.callee, m.operation, m.duration_ms,
        coalesce(m.code, CASE WHEN m.status <> 'unset' THEN m.status END) AS status, CAST(m.retries AS BIGINT) AS retries
      FROM marked m JOIN roots r ON r.tid = m.tid LEFT JOIN owners o ON o.tid = m.tid AND o.rank = m.rank
      LEFT JOIN firsts p ON p.tid = m.tid AND p.id = m.parent
      JOIN marked e ON e.tid = m.tid AND e.rank = coalesce(o.owner, r.first) WHERE m.kind = 'client')"""
SEGMENTS_SQL = f"""{SPANS_SQL},
      below AS (SELECT tid, parent AS id, sum(coalesce(duration_ms, 0)) AS below FROM spans WHERE parent IS NOT NULL GROUP BY ALL),
      labelled AS (SELECT s.tid, CASE WHEN kind = 'client' THEN 'downstream:' || coalesce(callee, '(unknown)') ELSE 'service:' || service END AS label,
        CASE WHEN kind = 'client' THEN coalesce(duration_ms, 0) ELSE greatest(0, coalesce(duration_ms, 0) - coalesce(below, 0)) END AS ms
        FROM spans s LEFT JOIN below b ON b.tid = s.tid AND b.id = s.id),
      segments AS (SELECT tid AS trace_id, label, sum(ms) AS duration_ms, round(sum(ms) / any_value(t.duration_ms), 6) AS share
      FROM labelled l JOIN traces t ON t.trace_id = l.tid GROUP BY tid, label HAVING sum(ms) > 0)"""


def over_spans(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(operator(spans(spark, sf_dir)))


def exec_rows(df: DataFrame) -> DataFrame:
    rows = assembly.executions(assembly.placed(df))
    return rows.select(
        "tid", F.col("place.source_offset").alias("place"), "request_id", "service", "operation", "method",
        "route", "start_unix_nano", "duration_ms", "status", "retries", "timed_out",
    )


def call_rows(df: DataFrame) -> DataFrame:
    found = assembly.downstream_calls(assembly.placed(df))
    return found.select(
        "tid", F.col("place.source_offset").alias("place"), "orphan", "caller", "callee", "operation",
        "duration_ms", "status", "retries",
    )


def ordered_rows(df: DataFrame) -> DataFrame:
    found = assembly.ordered_calls(assembly.downstream_calls(assembly.placed(df)))
    return found.select("tid", F.col("place.source_offset").alias("place"), "at", "operation", "callee", "protocol")


def request_rows(df: DataFrame) -> DataFrame:
    rows = assembly.placed(df)
    counted = assembly.call_counts(assembly.executions(rows), assembly.downstream_calls(rows))
    each = F.transform("operations", lambda o: F.concat_ws(" x ", F.coalesce(o["operation"], F.lit("")), o["n"]))
    return counted.select(
        "tid", F.col("place.source_offset").alias("place"), "calls", F.array_join(each, ",").alias("operations")
    )


def budgets(df: DataFrame) -> DataFrame:
    limits = df.sparkSession.createDataFrame(
        [("svc1", 300.0), ("svc2", 10.0), ("nothing", 1.0)], "hop string, limit_ms double"
    )
    return assembly.budget_check(assembly.latency_segments(df), limits)


def paths_joined(df: DataFrame) -> DataFrame:
    return assembly.critical_paths(df).withColumn("path", F.array_join("path", ">"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node per part, which depends on up to three nodes of about half its number, by the
    suppliers of its lines. The smallest numbers go round in circles."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    supplier = F.col("l_suppkey")
    return lines.select(
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("source"),
        F.when(supplier % 2 == 0, "CALLS").otherwise("DEPENDS_ON").alias("kind"),
        F.concat(F.lit("n"), (F.floor(F.col("l_partkey") / 2) + supplier % 3).cast("string")).alias("target"),
    ).distinct()


EDGES_SQL = """edges AS (SELECT DISTINCT 'n' || l_partkey AS source,
    CASE WHEN l_suppkey % 2 = 0 THEN 'CALLS' ELSE 'DEPENDS_ON' END AS kind,
    'n' || (l_partkey // 2 + l_suppkey % 3) AS target
  FROM lineitem)"""


def over_edges(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(call_edges(spark, sf_dir))


def start_nodes(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([("n1",), ("n20",), ("n138",), ("gone",)], "node string")


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    masked = text.redact_text(F.col("text"))
    return docs.select("doc_id", F.sha2(masked, 256).alias("digest"), (masked != F.col("text")).alias("changed"))


def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1), r"\d+", "{id}")
    concrete = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return pages.select(
        "page_id",
        text.drift_path(path).alias("drift"),
        text.route_path(path).alias("route"),
        text.path_shape(path).alias("shape"),
        F.array_join(text.path_variables(path), ",").alias("variables"),
        text.sanitized_host(F.col("url")).alias("host"),
        text.path_matches(F.lit("/fr/{id}"), concrete).alias("fits"),
        text.short_hash(F.col("url")).alias("hash"),
    )


def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by the hash of their text: how many, the first, and the size."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.count("*").alias("copies"),
        F.min("doc_id").alias("first"),
        F.first(F.octet_length("text")).alias("size"),
    )


def all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the spans and of events read as access-log rows."""
    k = F.col("event_id")
    logged = read(spark, sf_dir, "events").select(
        F.when(k % 3 != 0, k.cast("string")).alias("request_id"), F.when(k % 5 == 0, k.cast("string")).otherwise("").alias("trace_id"), F.when(k % 7 != 0, F.col("value")).alias("duration_ms"),
    )
    return assembly.signals(spans(spark, sf_dir), logged)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first graph's definition of each entity of two graphs."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("of"))
    regions = read(spark, sf_dir, "customer").groupBy(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("id")).agg(F.count("*").cast("int").alias("of"))
    return graph.merged(nations, regions)


def chain_hops(df: DataFrame) -> DataFrame:
    """The hops of chains of two, with what their edges are about: here their kinds in lower case."""
    paths = graph.chains(df, 2)
    return graph.chain_hops(paths, df.withColumn("subject", F.lower("kind"))).withColumn("path", F.array_join("path", ">"))


REACH_SQL = f"""WITH RECURSIVE {EDGES_SQL}, starts(node) AS (VALUES ('n1'), ('n20'), ('n138'), ('gone')),
walk AS (SELECT s.node AS start, e.target AS node, 1 AS hops FROM starts s JOIN edges e ON e.source = s.node
  UNION SELECT w.start, e.target, w.hops + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE w.hops < {{depth}})
SELECT start, node, min(hops) AS hops{{more}} FROM walk GROUP BY start, node"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "r1_r2_executions": over_spans(exec_rows),
    "r3_r5_downstream_calls": over_spans(call_rows),
    "r6_requests": over_spans(request_rows),
    "r7_doubled_ids": over_spans(assembly.doubled_ids),
    "r8_traces": over_spans(lambda df: assembly.traces(df).drop("cut")),
    "r9_critical_paths": over_spans(paths_joined),
    "r6_ordered_calls": over_spans(lambda df: ordered_rows(df)),
    "r10_kept_spans": over_spans(lambda df: assembly.kept_spans(df, 3).select("tid", F.col("place.source_offset").alias("place"), "rank")),
    "r10_retention": over_spans(lambda df: assembly.traces(df, 4).select("trace_id", "cut").where("cut > 0")),
    "r11_latency_segments": over_spans(assembly.latency_segments),
    "r12_budgets": over_spans(budgets),
    "a8_observability": over_spans(assembly.observability),
    "a8_operation_names": over_spans(assembly.operation_names),
    "a8_signals": all_signals,
    "g1_runtime_edges": lambda spark, sf_dir: graph.runtime_edges(executions(spark, sf_dir)),
    "g3_neighbours": over_edges(lambda df: graph.neighbours(df, start_nodes(df))),
    "g4_reachable": over_edges(lambda df: graph.reachable(df, start_nodes(df))),
    "g5_topology": over_edges(graph.topology),
    "g6_neighbourhood": over_edges(lambda df: graph.neighbourhood(df, start_nodes(df), 2)),
    "g8_chains": over_edges(lambda df: graph.chains(df, 3).select(F.array_join("path", ">").alias("path"))),
    "g8_chain_hops": over_edges(lambda df: chain_hops(df)),
    "g12_migration_order": over_edges(graph.migration_order),
    "g13_cycles": over_edges(graph.cycles),
    "d7_merged_entities": labels,
    "m1_redaction": redacted,
    "m3_m5_paths": path_forms,
    "s9_content_groups": content_groups,
}

ORACLES = {
    "r1_r2_executions": f"""{SPANS_SQL} SELECT tid, place, request_id, service, operation, 'GET' AS method, operation AS route,
      start_unix_nano, duration_ms, coalesce(code, CASE WHEN status <> 'unset' THEN status END) AS status,
      CAST(retries AS BIGINT) AS retries, CASE WHEN code IS NOT NULL THEN code = '504' END AS timed_out
      FROM marked WHERE is_exec""",
    "r7_doubled_ids": f"{SPANS_SQL} SELECT tid, id, count(*) AS times FROM spans GROUP BY tid, id HAVING count(*) > 1",
    "r3_r5_downstream_calls": f"{CALLS_SQL} SELECT * FROM calls",
    "r6_requests": f"""{CALLS_SQL}, n AS (SELECT tid, place, operation, count(*) AS n FROM calls GROUP BY ALL),
      l AS (SELECT tid, place, CAST(sum(n) AS BIGINT) AS calls, string_agg(operation || ' x ' || n, ',' ORDER BY operation) AS operations FROM n GROUP BY ALL)
      SELECT m.tid, m.place, coalesce(l.calls, 0) AS calls, coalesce(l.operations, '') AS operations FROM marked m LEFT JOIN l USING (tid, place) WHERE is_exec""",
    "r12_budgets": f"""{SEGMENTS_SQL}, b(hop, lim) AS (VALUES ('svc1', 300.0), ('svc2', 10.0), ('nothing', 1.0)),
      tried AS (SELECT hop, lim, unnest(['service:' || hop, 'downstream:' || hop, hop]) AS label, unnest([0, 1, 2]) AS rank FROM b),
      hits AS (SELECT trace_id, hop, arg_min(label, rank) AS label, arg_min(duration_ms > lim, rank) AS over FROM segments JOIN tried USING (label) GROUP BY ALL)
      SELECT t.trace_id, b.hop, label, CASE WHEN label IS NULL THEN 'unknown' WHEN over THEN 'over' ELSE 'within' END AS verdict
      FROM (SELECT DISTINCT trace_id FROM segments) t CROSS JOIN b LEFT JOIN hits h ON h.trace_id = t.trace_id AND h.hop = b.hop""",
    "r8_traces": f"{SPANS_SQL} SELECT * FROM traces",
    "r9_critical_paths": f"""{SPANS_SQL},
      best AS (SELECT s.tid, s.parent, arg_max(s.id, (coalesce(s.duration_ms, 0), s.operation, s.place)) AS id FROM spans s
        JOIN traces t ON t.trace_id = s.tid AND NOT t.incomplete WHERE s.parent IS NOT NULL GROUP BY ALL),
      path AS (SELECT s.tid, s.id, s.operation AS path FROM spans s JOIN traces t ON t.trace_id = s.tid AND NOT t.incomplete WHERE s.parent IS NULL
        UNION ALL SELECT p.tid, b.id, p.path || '>' || s.operation FROM path p JOIN best b ON b.tid = p.tid AND b.parent = p.id
        JOIN spans s ON s.tid = b.tid AND s.id = b.id AND s.parent = b.parent)
      SELECT tid AS trace_id, arg_max(path, length(path)) AS path FROM path GROUP BY tid""",
    "r10_retention": f"{SPANS_SQL} SELECT trace_id, span_count - 4 AS cut FROM traces WHERE span_count > 4",
    "r11_latency_segments": f"{SEGMENTS_SQL} SELECT * FROM segments",
    "a8_observability": f"{SPANS_SQL} SELECT {COUNTERS_SQL}, count(*) FILTER (lost) AS orphans FROM spans",
    "a8_operation_names": f"{SPANS_SQL} SELECT operation, count(*) AS n FROM spans GROUP BY operation",
    "a8_signals": f"""{SPANS_SQL}, c AS (SELECT {COUNTERS_SQL}, count(*) FILTER (lost) AS orphans FROM spans),
      l AS (SELECT count(*) AS structured_logs, count(*) FILTER (event_id % 3 <> 0) AS request_ids, count(*) FILTER (event_id % 5 = 0) AS trace_propagation, count(*) FILTER (event_id % 7 <> 0) AS metrics FROM events)
      SELECT signal, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM (UNPIVOT c ON COLUMNS(*) INTO NAME signal VALUE n) UNION ALL SELECT * FROM (UNPIVOT l ON COLUMNS(*) INTO NAME signal VALUE n)) GROUP BY signal""",
    "r6_ordered_calls": f"""{CALLS_SQL} SELECT tid, place, row_number() OVER (PARTITION BY tid, place ORDER BY operation, callee) AS at, operation, callee, NULL AS protocol FROM calls""",
    "r10_kept_spans": f"""{SPANS_SQL} SELECT tid, place, rank FROM ordered WHERE rank <= 3""",
    "g1_runtime_edges": f"""{V}, p AS (SELECT caller AS source, callee AS target, retries FROM calls WHERE caller IS NOT NULL AND callee IS NOT NULL)
      SELECT source, 'CALLS' AS kind, target, count(*) AS n FROM p GROUP BY ALL
      UNION ALL SELECT source, 'RETRIES', target, count(*) FROM p WHERE retries > 0 GROUP BY ALL""",
    "g3_neighbours": f"""WITH {EDGES_SQL} SELECT DISTINCT * FROM (SELECT source AS node, kind, target AS other, 'out' AS direction FROM edges
      UNION ALL SELECT target, kind, source, 'in' FROM edges) WHERE node IN ('n1', 'n20', 'n138', 'gone')""",
    "g4_reachable": REACH_SQL.format(depth=40, more=""),
    "g5_topology": f"""WITH {EDGES_SQL}, p AS (SELECT DISTINCT source, target FROM edges)
      SELECT coalesce(a.node, b.node) AS node, coalesce(targets, 0) AS targets, coalesce(dependents, 0) AS dependents
      FROM (SELECT source AS node, count(*) AS targets FROM p GROUP BY 1) a
      FULL JOIN (SELECT target AS node, count(*) AS dependents FROM p GROUP BY 1) b ON a.node = b.node""",
    "g6_neighbourhood": REACH_SQL.format(depth=2, more=", min(hops) = 2 AS boundary"),
    "g8_chains": f"""WITH {EDGES_SQL}, p AS (SELECT DISTINCT source, target FROM edges WHERE source <> target),
      two AS (SELECT a.source AS a, a.target AS b, b.target AS c FROM p a JOIN p b ON a.target = b.source WHERE b.target <> a.source)
      SELECT a || '>' || b || '>' || c AS path FROM two
      UNION ALL SELECT a || '>' || b || '>' || c || '>' || target FROM two JOIN p ON p.source = c WHERE target NOT IN (a, b)""",
    "g8_chain_hops": f"""WITH {EDGES_SQL}, p AS (SELECT DISTINCT source, target FROM edges WHERE source <> target),
      two AS (SELECT a.source AS a, a.target AS b, b.target AS c FROM p a JOIN p b ON a.target = b.source WHERE b.target <> a.source),
      h AS (SELECT a || '>' || b || '>' || c AS path, unnest([1, 2]) AS "at", unnest([a, b]) AS source, unnest([b, c]) AS target FROM two)
      SELECT path, CAST(h."at" AS INTEGER) AS "at", h.source, h.target, kind, lower(kind) AS subject FROM h JOIN edges e ON e.source = h.source AND e.target = h.target""",
    "g12_migration_order": f"""WITH RECURSIVE {EDGES_SQL},
      f AS (SELECT DISTINCT source, target FROM edges),
      nodes AS (SELECT source AS node FROM f UNION SELECT target FROM f),
      reach AS (SELECT source AS a, target AS b FROM f UNION SELECT r.a, f.target FROM reach r JOIN f ON f.source = r.b),
      circular AS (SELECT a AS node FROM reach WHERE a = b),
      blocked AS (SELECT node FROM circular UNION SELECT b FROM reach JOIN circular ON a = node),
      depth AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT node FROM blocked)
        UNION SELECT f.target, level + 1 FROM depth d JOIN f ON f.source = d.node WHERE f.target NOT IN (SELECT node FROM blocked))
      SELECT node, max(level) AS level FROM depth GROUP BY node UNION ALL SELECT node, NULL FROM blocked""",
    "g13_cycles": f"""WITH RECURSIVE {EDGES_SQL},
      reach AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT r.a, e.target FROM reach r JOIN edges e ON e.source = r.b)
      SELECT x.a AS node, min(x.b) AS circle FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    "d7_merged_entities": """SELECT coalesce(n.n_name, c.id) AS id, CASE WHEN n.n_name IS NOT NULL THEN n.n_regionkey ELSE c.n END AS "of"
      FROM nation n FULL JOIN (SELECT 'NATION_' || c_nationkey AS id, CAST(count(*) AS INTEGER) AS n FROM customer GROUP BY 1) c ON c.id = n.n_name""",
    "m3_m5_paths": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS c FROM pages),
      q AS (SELECT *, regexp_replace(c, '\d+', '{id}', 'g') AS path FROM p),
      r AS (SELECT *, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS bare FROM q)
      SELECT page_id, replace(bare, '{id}', '{}') AS drift, replace(bare, '{id}', '{}') AS route, replace(trim(path), '{id}', '{}') AS shape,
        array_to_string(regexp_extract_all(path, '\{([^{}/]+)\}', 1), ',') AS variables,
        lower(regexp_replace(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), ':\d+$', '')) AS host,
        regexp_matches(c, '/fr/[^/]+/*$') AS fits, substr(sha256(url), 1, 16) AS hash FROM r""",
    "s9_content_groups": """SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first, CAST(any_value(octet_length(encode(text))) AS INTEGER) AS size
      FROM documents WHERE text IS NOT NULL GROUP BY 1""",
}

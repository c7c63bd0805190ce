"""Queries over executions, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import scratch
from spanloom.functions.stats import window_key
from spanloom.operators import aggregate, baseline
from spanloom.sources import sinks
from spanloom.sources.views import EXECUTIONS_SQL, executions

DAY = "yyyy-MM-dd"
V = "WITH " + EXECUTIONS_SQL.strip()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(
        *(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)
    )


def over(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(operator(executions(spark, sf_dir)))


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("availability", "error_rate", 0.7, None),
        ("latest", "error_rate", 0.9, "2024-01-30"),
        ("speed", "latency_p95", 0.9, None),
        ("empty", "error_rate", 0.9, "1999-01-01"),
    ]
    objectives = spark.createDataFrame(rows, "name string, metric string, target double, window string")
    return rounded(aggregate.error_budget(executions(spark, sf_dir), objectives, DAY))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions kept by day, and of them those of one service, operation and day, in order."""
    path = scratch(spark, "history")
    sinks.write_history(executions(spark, sf_dir), path, DAY)
    found = sinks.read_history(spark, path, "svc1", "click", "2024-01-30")
    return found.select("window", "request_id", "service", "operation", "start_unix_nano")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions written in order to many files and read back with their places."""
    path = scratch(spark, "export")
    rows = executions(spark, sf_dir).select("request_id", "trace_id", "service", "operation", "start_unix_nano")
    sinks.write_executions(rows, path)
    found = sinks.read_ordered(spark, path)
    return found.select("at", F.get_json_object("value", "$.request_id").alias("request_id"))


def payload_classes(df: DataFrame) -> DataFrame:
    size = F.col("response_bytes")
    state = aggregate.saturation(F.col("duration_ms"), F.lit(50.0), F.lit(100.0))
    return df.groupBy(
        aggregate.large_payload(size).alias("large"), state.alias("state")
    ).agg(F.count("*").alias("n"))


def fanouts(df: DataFrame) -> DataFrame:
    static = df.sparkSession.createDataFrame(
        [("click", 3), ("refund", 2)], "subject string, fanout long"
    )
    return aggregate.fanout_state(aggregate.runtime_fanout(df), static)


def check(check_id: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: baseline.regressions(df, DAY, (check_id,))


def regressing(df: DataFrame) -> DataFrame:
    """Operations whose error share of a day is past 0.1 on several days, as endpoints."""
    day = window_key(F.col("start_unix_nano"), DAY)
    bad = df.groupBy(F.col("service").alias("repo"), F.col("operation").alias("subject"), day.alias("window"))
    bad = bad.agg(F.avg((F.col("status") == "503").cast("double")).alias("rate")).where("rate > 0.1")
    return baseline.regressing_endpoints(bad)


def first_calls(df: DataFrame) -> DataFrame:
    calls = aggregate.calls_of(df.withColumnRenamed("operation", "subject"), "subject", "exec_id", "start_unix_nano")
    calls = calls.where("callee is not null")
    return baseline.first_observations(
        calls, ["subject", "callee"], ["start_unix_nano", "exec_id", "operation"]
    ).select("subject", "callee", "exec_id", "operation")


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def _summary(value: str, prefix: str) -> str:
    points = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    return ", ".join(
        [
            f"count({value}) AS {prefix}_count",
            *(_r(f"quantile_cont(CAST({value} AS DOUBLE), {p})", f"{prefix}_{n}") for n, p in points),
            _r(f"CAST(min({value}) AS DOUBLE)", f"{prefix}_min"),
            _r(f"CAST(max({value}) AS DOUBLE)", f"{prefix}_max"),
        ]
    )


A1_SQL = f"""{V}
SELECT service, operation, count(*) AS requests,
  count(*) FILTER (status = 'error' OR status LIKE '5%') AS errors,
  {_r("count(*) FILTER (status = 'error' OR status LIKE '5%') / count(*)", "error_rate")},
  count(*) FILTER (timed_out) AS timeouts,
  CAST(sum(coalesce(retries, 0)) AS BIGINT) AS retries,
  {_r("sum(coalesce(retries, 0)) / count(*)", "retry_rate")},
  CAST(sum(n_calls) AS BIGINT) AS downstream_calls,
  {_r("sum(n_calls) / count(*)", "fanout_per_request")},
  {_summary("duration_ms", "latency")}, {_summary("request_bytes", "request_bytes")},
  {_summary("response_bytes", "response_bytes")}, FALSE AS approximate
FROM executions GROUP BY service, operation"""

A3_SQL = f"""{V}
SELECT service, operation, list(hour_window || '=' || n ORDER BY hour_window) AS windows
FROM (SELECT service, operation, hour_window, count(*) AS n FROM executions GROUP BY ALL)
GROUP BY service, operation"""

A4_SQL = f"""{V}
SELECT coalesce(route, '(unknown)') AS path, {_summary("duration_ms", "latency")}
FROM executions WHERE duration_ms IS NOT NULL GROUP BY 1"""

ERROR = "(status = 'error' OR coalesce(try_cast(status AS BIGINT) >= 500, FALSE))"


def _robust(rows: str, keys: str, value: str, prefix: str) -> str:
    points = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
    return f"""(SELECT {keys}, count(x) AS {prefix}_count,
      {", ".join(f"quantile_cont(x, {p}) AS {prefix}_{n}" for n, p in points)},
      avg(x) AS {prefix}_mean, mad(x) AS {prefix}_mad
    FROM (SELECT {keys}, CAST({value} AS DOUBLE) AS x FROM {rows}) WHERE x IS NOT NULL GROUP BY {keys})"""


A5_SQL = f"""{V},
keyed AS (
  SELECT 'service' AS dimension, service AS key, day_window AS "window", * FROM executions
  UNION ALL SELECT 'operation', operation, day_window, * FROM executions
  UNION ALL SELECT 'route', route, day_window, * FROM executions),
rates AS (
  SELECT dimension, key, "window", count(*) AS count,
    {_r(f"avg(CAST({ERROR} AS DOUBLE))", "error_rate")},
    CAST(count(*) AS DOUBLE) AS throughput_per_hour,
    {_r("avg(CAST(retries > 0 AS DOUBLE))", "retry_rate")},
    {_r("avg(CAST(timed_out AS DOUBLE))", "timeout_rate")},
    {_r("quantile_cont(CAST(response_bytes AS DOUBLE), 0.95)", "payload_p95_bytes")},
    {_r("avg(n_calls)", "fanout_mean")},
    {_r("avg(CAST(contains(lower(cache_status), 'hit') AS DOUBLE))", "cache_hit_rate")},
    CASE WHEN count(*) >= 8 THEN 'MEDIUM' ELSE 'UNKNOWN' END AS confidence
  FROM keyed WHERE key IS NOT NULL GROUP BY ALL)
SELECT r.*, latency_count, {", ".join(_r(f"latency_{n}", f"latency_{n}") for n in ("p50", "p90", "p95", "p99", "mean", "mad"))}
FROM rates r LEFT JOIN {_robust("keyed", 'dimension, key, "window"', "duration_ms", "latency")} x
USING (dimension, key, "window")"""

A6_SQL = f"""{V},
keyed AS (SELECT coalesce(callee, '(unknown)') AS key, day_window AS "window", duration_ms, retries FROM calls),
counts AS (SELECT key, "window", count(*) AS count, {_r("avg(CAST(retries > 0 AS DOUBLE))", "retry_rate")}
           FROM keyed GROUP BY ALL)
SELECT c.*, latency_count, {", ".join(_r(f"latency_{n}", f"latency_{n}") for n in ("p50", "p90", "p95", "p99", "mean", "mad"))},
  CASE WHEN latency_count >= 8 THEN 'MEDIUM' ELSE 'UNKNOWN' END AS confidence
FROM counts c JOIN {_robust("keyed", 'key, "window"', "duration_ms", "latency")} x USING (key, "window")"""

SPLIT_SQL = """
ends AS (SELECT service AS s, operation AS o, max(day_window) AS latest FROM executions
         GROUP BY ALL HAVING max(day_window) <> min(day_window)),
split AS (SELECT e.*, CASE WHEN day_window = latest THEN 'current' ELSE 'baseline' END AS side
          FROM executions e JOIN ends ON e.service IS NOT DISTINCT FROM s AND e.operation = o),
split_calls AS (SELECT c.service, c.exec_operation AS operation, c.callee, c.duration_ms, s.side
                FROM calls c JOIN split s USING (exec_id) WHERE c.callee IS NOT NULL)"""


def _shift_sql(check_id: str, rows: str, value: str, callee: bool = False) -> str:
    keys = "service, operation" + ", callee" * callee
    same = " AND ".join(f"b.{k} IS NOT DISTINCT FROM c.{k}" for k in keys.split(", "))
    stats = _robust(rows, keys + ", side", value, "x")
    return f"""{V}, {SPLIT_SQL}, stats AS {stats}
SELECT '{check_id}' AS check_id, c.service, c.operation, {"c.callee" if callee else "CAST(NULL AS VARCHAR)"} AS callee,
  round(b.x_p95, 6) AS baseline, round(c.x_p95, 6) AS current
FROM (SELECT * FROM stats WHERE side = 'baseline') b
JOIN (SELECT * FROM stats WHERE side = 'current') c ON {same}
WHERE b.x_count >= 8 AND c.x_count >= 8
  AND c.x_p95 > greatest(b.x_p95 * 1.5, b.x_p95 + 3 * b.x_mad)
  AND c.x_p50 > b.x_p50 + greatest(b.x_mad, b.x_p50 * 0.10)"""


def _rate_sql(check_id: str, value: str, bound: float, down: bool = False) -> str:
    worse = "b - c" if down else "c - b"
    return f"""{V}, {SPLIT_SQL}
SELECT '{check_id}' AS check_id, service, operation, CAST(NULL AS VARCHAR) AS callee,
  round(b, 6) AS baseline, round(c, 6) AS current
FROM (SELECT service, operation, avg(x) FILTER (side = 'baseline') AS b, avg(x) FILTER (side = 'current') AS c,
        count(x) FILTER (side = 'baseline') AS bn, count(x) FILTER (side = 'current') AS cn
      FROM (SELECT service, operation, side, CAST({value} AS DOUBLE) AS x FROM split) GROUP BY ALL)
WHERE bn >= 8 AND cn >= 8 AND {worse} > {bound}"""


def windows_text(df: DataFrame) -> DataFrame:
    pairs = F.transform("windows", lambda w: F.concat(w["window"], F.lit("="), w["requests"]))
    return aggregate.window_counts(df).withColumn("windows", pairs)


def split_sizes(df: DataFrame) -> DataFrame:
    split = baseline.split_windows(df, DAY)
    return split.groupBy("service", "operation", "side", "window").agg(F.count("*").alias("n"))


def as_summaries(df: DataFrame) -> DataFrame:
    return aggregate.path_latency(df.withColumnRenamed("route", "path"))


def cost(df: DataFrame) -> DataFrame:
    return aggregate.cost_drivers(df)


def busiest(df: DataFrame) -> DataFrame:
    return aggregate.capacity(df)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a1_operation_aggregates": over(aggregate.operation_aggregates),
    "a3_window_counts": over(windows_text),
    "a4_path_latency": over(as_summaries),
    "a5_baselines": over(lambda df: baseline.baselines(df, DAY)),
    "a6_dependency_baselines": over(lambda df: baseline.dependency_baselines(df, DAY)),
    "a9_retry_signal": over(aggregate.retry_signal),
    "a10_payload_signal": over(aggregate.payload_signal),
    "a11_fanout_signal": over(aggregate.fanout_signal),
    "a12_repeated_calls": over(aggregate.repeated_calls),
    "a13_timeout_signal": over(aggregate.timeout_signal),
    "a14_cache_signal": over(aggregate.cache_signal),
    "a15_capacity": over(busiest),
    "a16_cost_drivers": over(cost),
    "a17_error_budget": budget,
    "a18_runtime_fanout": over(fanouts),
    "p10_history": history,
    "t2_exported_executions": exported,
    "p12_p13_payload_classes": over(payload_classes),
    "w1_split_windows": over(split_sizes),
    "w2_latency_regression": over(check("APIPERF001")),
    "w3_error_regression": over(check("APIPERF002")),
    "w4_downstream_regression": over(lambda df: check("APIPERF003")(df.withColumn("operation", F.lit("all")))),
    "w5_retry_regression": over(check("APIPERF004")),
    "w6_timeout_regression": over(check("APIPERF005")),
    "w7_payload_regression": over(check("APIPERF006")),
    "w8_fanout_regression": over(check("APIPERF007")),
    "w9_cache_regression": over(check("APIPERF008")),
    "w10_regressing_endpoints": over(regressing),
    "w14_first_observations": over(first_calls),
}

ORACLES = {
    "a1_operation_aggregates": A1_SQL,
    "a3_window_counts": A3_SQL,
    "a4_path_latency": A4_SQL,
    "a5_baselines": A5_SQL,
    "a6_dependency_baselines": A6_SQL,
    "a9_retry_signal": f"""{V} SELECT (SELECT count(*) FROM executions WHERE retries > 0) AS requests,
      CAST((SELECT sum(coalesce(retries, 0)) FROM calls) AS BIGINT) AS resends""",
    "a10_payload_signal": f"{V} SELECT max(response_bytes) AS largest FROM executions HAVING max(response_bytes) >= 262144",
    "a11_fanout_signal": f"{V} SELECT count(*) AS requests, CAST(max(n_calls) AS INTEGER) AS widest FROM executions WHERE n_calls >= 4",
    "a12_repeated_calls": f"""{V} SELECT exec_id, string_agg(callee || ' x ' || n, ', ' ORDER BY callee || ' x ' || n) AS detail
      FROM (SELECT exec_id, callee, count(*) AS n FROM calls WHERE callee IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
      GROUP BY exec_id""",
    "a13_timeout_signal": f"{V} SELECT count(*) AS requests FROM executions WHERE timed_out",
    "a14_cache_signal": f"""{V} SELECT count(*) AS statuses, count(*) FILTER (lower(cache_status) IN ('miss', 'expired')) AS misses,
      round(avg(CAST(lower(cache_status) IN ('miss', 'expired') AS DOUBLE)), 6) AS miss_share
      FROM executions WHERE cache_status IS NOT NULL""",
    "a15_capacity": f"""{V}
      SELECT 'throughput' AS dimension, round(max(n) / 3600, 6) AS value, 'OBSERVED' AS state
      FROM (SELECT count(*) AS n FROM executions WHERE hour_window <> '(unwindowed)' GROUP BY hour_window)
      UNION ALL SELECT 'concurrency', CAST(max(n_calls) AS DOUBLE), 'OBSERVED' FROM executions
      UNION ALL SELECT unnest(['cpu', 'memory', 'connections', 'threads', 'queue', 'storage', 'network']), NULL, 'UNKNOWN'""",
    "a16_cost_drivers": f"""{V}, s AS (SELECT CAST(count(*) AS DOUBLE) AS a, sum(duration_ms) AS b,
        CAST(sum(response_bytes) AS DOUBLE) AS c, CAST(sum(request_bytes + response_bytes) AS DOUBLE) AS d FROM executions)
      SELECT 'request_count' AS driver, round(a, 6) AS amount FROM s UNION ALL SELECT 'compute_duration_ms', round(b, 6) FROM s
      UNION ALL SELECT 'egress_bytes', round(c, 6) FROM s UNION ALL SELECT 'transfer_bytes', round(d, 6) FROM s""",
    "a17_error_budget": f"""{V}, objectives(name, metric, target, "window") AS (VALUES
        ('availability', 'error_rate', 0.7::DOUBLE, NULL), ('latest', 'error_rate', 0.9, '2024-01-30'),
        ('speed', 'latency_p95', 0.9, NULL), ('empty', 'error_rate', 0.9, '1999-01-01')),
      s AS (SELECT o.name, o.metric, o.target, o."window", count(e.exec_id) AS total,
          count(*) FILTER (coalesce({ERROR}, FALSE)) AS errors
        FROM objectives o LEFT JOIN executions e ON o."window" IS NULL OR o."window" = e.day_window GROUP BY ALL)
      SELECT name, metric, round(target, 6) AS target, "window", total, errors,
        CASE WHEN total >= 8 AND contains(metric, 'error') THEN round((1 - target) * total - errors, 6) END AS remaining,
        NOT (total >= 8 AND contains(metric, 'error')) AS insufficient FROM s""",
    "a18_runtime_fanout": f"""{V}, r AS (SELECT exec_operation AS subject, count(DISTINCT coalesce(callee, operation)) AS observed FROM calls GROUP BY 1),
      d(subject, declared) AS (VALUES ('click', 3::BIGINT), ('refund', 2))
      SELECT subject, observed, declared, CASE WHEN observed IS NULL THEN 'CANDIDATE' ELSE 'CONFIRMED' END AS state
      FROM r FULL JOIN d USING (subject)""",
    "t2_exported_executions": f"""{V} SELECT row_number() OVER (ORDER BY coalesce(start_unix_nano, 0), request_id, coalesce(service, ''), operation) - 1 AS at, request_id FROM executions""",
    "p10_history": f"""{V} SELECT day_window AS "window", request_id, service, operation, start_unix_nano FROM executions
      WHERE service = 'svc1' AND operation = 'click' AND day_window = '2024-01-30'""",
    "p12_p13_payload_classes": f"""{V} SELECT response_bytes >= 262144 AS large, CASE WHEN duration_ms IS NULL THEN 'UNKNOWN'
        WHEN duration_ms >= 100 THEN 'SATURATED' WHEN duration_ms >= 50 THEN 'ELEVATED' ELSE 'NORMAL' END AS state,
        count(*) AS n FROM executions GROUP BY ALL""",
    "w1_split_windows": f"""{V}, {SPLIT_SQL} SELECT service, operation, side, day_window AS "window", count(*) AS n FROM split GROUP BY ALL""",
    "w2_latency_regression": _shift_sql("APIPERF001", "split", "duration_ms"),
    "w3_error_regression": _rate_sql("APIPERF002", ERROR, 0.05),
    "w4_downstream_regression": _shift_sql("APIPERF003", "split_calls", "duration_ms", True).replace("event_type AS operation", "'all' AS operation"),
    "w5_retry_regression": _rate_sql("APIPERF004", "retries > 0", 0.10),
    "w6_timeout_regression": _rate_sql("APIPERF005", "timed_out", 0.05),
    "w7_payload_regression": _shift_sql("APIPERF006", "split", "response_bytes"),
    "w8_fanout_regression": _rate_sql("APIPERF007", "n_calls", 1.0),
    "w9_cache_regression": _rate_sql("APIPERF008", "contains(lower(cache_status), 'hit')", 0.10, True),
    "w10_regressing_endpoints": f"""{V} SELECT service AS repo, operation AS subject, count(*) AS windows
      FROM (SELECT service, operation, day_window FROM executions GROUP BY ALL
            HAVING avg(CAST(status = '503' AS DOUBLE)) > 0.1) GROUP BY ALL HAVING count(*) > 1""",
    "w14_first_observations": f"""{V} SELECT exec_operation AS subject, callee, exec_id, operation FROM (
        SELECT c.*, row_number() OVER (PARTITION BY exec_operation, callee
          ORDER BY e.start_unix_nano NULLS FIRST, c.exec_id, c.operation) AS place
        FROM calls c JOIN executions e USING (exec_id) WHERE callee IS NOT NULL) WHERE place = 1""",
}



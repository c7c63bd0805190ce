"""Views of the provided tables in the shape of the library's inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From this day on some services behave worse, so that regressions are there to be found.
WORSE = "2024-01-30"

CALL = "struct<caller:string,callee:string,operation:string,duration_ms:double,status:string,retries:bigint,protocol:string>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes contracts of; a document has some thousand bytes.
PARTS = 20_000
SHUFFLES = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the parts, dealt over partitions in number of the rows: the file has a few
    bytes a row, so by its size a million documents would be made and parsed in two or three tasks.

    What is made of a key is larger than Spark expects of it, so tables of contracts are joined
    with the hint "merge" throughout; by expected sizes they would be gathered in the driver and broadcast. Sets the session's SHUFFLES."""
    keys = read(spark, sf_dir, "part").select("p_partkey")
    dealt = max(1, math.ceil(keys.count() / PARTS))
    # shuffles of contracts grow in number with them, so a task's share does not; adaptive execution joins small ones
    spark.conf.set(SHUFFLES, max(2 * dealt, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return keys.repartition(dealt, "p_partkey")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One execution per event."""
    return executions_of(read(spark, sf_dir, "events"))


def executions_of(rows: DataFrame) -> DataFrame:
    k, user = F.col("k"), F.col("user_id")
    events = rows.withColumns(
        {"k": F.get_json_object("props", "$.k").cast("long"), "late": F.col("ts") >= F.lit(WORSE).cast("timestamp_ntz")}
    )
    service = F.when(k % 29 != 0, F.concat(F.lit("svc"), (user % 5).cast("string")))
    late = F.col("late")
    count = k % 5 + F.when(late & (user % 5 == 0), 3).otherwise(0)
    calls = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0).cast("long"), count - 1),
            lambda i: F.struct(
                service.alias("caller"),
                F.when((k + i * (k % 2)) % 7 != 6, F.concat(F.lit("dep"), ((k + i * (k % 2)) % 7).cast("string"))).alias("callee"),
                F.concat(F.lit("op"), i.cast("string")).alias("operation"),
                F.when((k + i) % 5 != 4, F.col("value") / (i + 1) * F.when(late & (user % 5 == 1), 40).otherwise(1)).alias("duration_ms"),
                F.when((k + i) % 9 == 0, "error").otherwise("ok").alias("status"),
                F.when((k + i) % 4 != 3, (k + i) % 2).alias("retries"),
                F.lit("http").alias("protocol"),
            ),
        ),
    ).otherwise(F.array().cast(f"array<{CALL}>"))
    return events.select(
        F.col("event_id").alias("exec_id"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.lit(None).cast("string").alias("trace_id"),
        service.alias("service"),
        F.col("event_type").alias("operation"),
        F.lit("GET").alias("method"),
        F.when(k % 2 == 0, F.concat(F.lit("/"), "event_type")).alias("route"),
        F.when(k % 37 != 0, F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("start_unix_nano"),
        F.when(k % 31 != 0, F.col("value") * F.when(late & (user % 5 == 1), 4).otherwise(1)).alias("duration_ms"),
        F.when(k % 23 == 0, None)
        .when((F.col("event_type") == "error") | (late & (user % 5 == 2) & (k % 2 == 0)), "error")
        .when(k % 17 == 0, "503")
        .otherwise("200")
        .alias("status"),
        (k * 1024).alias("request_bytes"),
        (k * 4096 * F.when(late & (user % 5 == 1), 6).otherwise(1)).alias("response_bytes"),
        F.when(k % 7 != 0, k % 3 + F.when(late & (user % 5 == 3), 1).otherwise(0)).alias("retries"),
        F.when(late & (user % 5 == 2), "MISS")
        .when(k % 4 == 0, "HIT")
        .when(k % 4 == 1, "miss")
        .when(k % 4 == 2, "expired")
        .alias("cache_status"),
        F.when(late & (user % 5 == 4), True).when(k % 13 != 0, k % 11 == 0).alias("timed_out"),
        calls.alias("downstream_calls"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


#: The same view for the SQL oracles, with the calls as a table of their own.
EXECUTIONS_SQL = """
e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              ts >= TIMESTAMP '2024-01-30' AS late FROM events),
executions AS (
  SELECT event_id AS exec_id, 'r' || event_id AS request_id,
    CASE WHEN k % 29 <> 0 THEN 'svc' || (user_id % 5) END AS service,
    event_type AS operation,
    CASE WHEN k % 2 = 0 THEN '/' || event_type END AS route,
    CASE WHEN k % 37 <> 0 THEN epoch_us(ts) * 1000 END AS start_unix_nano,
    CASE WHEN k % 37 <> 0 THEN strftime(ts, '%Y-%m-%dT%H') ELSE '(unwindowed)' END AS hour_window,
    CASE WHEN k % 37 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE '(unwindowed)' END AS day_window,
    CASE WHEN k % 31 <> 0 THEN value * CASE WHEN late AND user_id % 5 = 1 THEN 4 ELSE 1 END END AS duration_ms,
    CASE WHEN k % 23 = 0 THEN NULL
         WHEN event_type = 'error' OR (late AND user_id % 5 = 2 AND k % 2 = 0) THEN 'error'
         WHEN k % 17 = 0 THEN '503' ELSE '200' END AS status,
    k * 1024 AS request_bytes,
    k * 4096 * CASE WHEN late AND user_id % 5 = 1 THEN 6 ELSE 1 END AS response_bytes,
    CASE WHEN k % 7 <> 0 THEN k % 3 + CASE WHEN late AND user_id % 5 = 3 THEN 1 ELSE 0 END END AS retries,
    CASE WHEN late AND user_id % 5 = 2 THEN 'MISS' WHEN k % 4 = 0 THEN 'HIT'
         WHEN k % 4 = 1 THEN 'miss' WHEN k % 4 = 2 THEN 'expired' END AS cache_status,
    CASE WHEN late AND user_id % 5 = 4 THEN TRUE WHEN k % 13 <> 0 THEN k % 11 = 0 END AS timed_out,
    k % 5 + CASE WHEN late AND user_id % 5 = 0 THEN 3 ELSE 0 END AS n_calls,
    k, value, late, user_id
  FROM e0),
calls AS (
  SELECT exec_id, service, operation AS exec_operation, hour_window, day_window, service AS caller,
    CASE WHEN (k + i * (k % 2)) % 7 <> 6 THEN 'dep' || ((k + i * (k % 2)) % 7) END AS callee, 'op' || i AS operation,
    CASE WHEN (k + i) % 5 <> 4 THEN value / (i + 1) * CASE WHEN late AND user_id % 5 = 1 THEN 40 ELSE 1 END END AS duration_ms,
    CASE WHEN (k + i) % 9 = 0 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN (k + i) % 4 <> 3 THEN (k + i) % 2 END AS retries
  FROM (SELECT *, unnest(range(n_calls)) AS i FROM executions))
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per conversation turn: a turn's parent is the one before; some parents are
    missing, doubled or the span itself, and some spans have no trace."""
    return spans_of(read(spark, sf_dir, "conversations"))


def spans_of(turns: DataFrame) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    trace = F.when(conv % 19 != 0, F.concat(F.lit("t"), conv.cast("string")))

    def name(of) -> F.Column:
        return F.concat(F.lit("s"), of.cast("string"))

    parent = (
        F.when(turn == 0, None)
        .when((conv % 11 == 0) & (turn == 2), "lost")
        .when((conv % 13 == 0) & (turn == 1), name(turn))
        .otherwise(name(F.floor((turn - 1) / 2)))
    )
    return turns.select(
        F.concat(F.lit("svc"), ((conv + turn) % 4).cast("string")).alias("service"),
        F.concat(F.col("role"), F.lit("-op"), (turn % 3).cast("string")).alias("operation"),
        parent.alias("parent_id"),
        F.when((conv % 17 == 0) & (turn == 3), "s2").otherwise(name(turn)).alias("span_id"),
        trace.alias("trace_id"),
        (F.lit(1_700_000_000_000_000_000) + conv * 1_000_000_000 + turn * 1_000_000).alias("start_unix_nano"),
        F.when((conv + turn) % 7 != 0, F.length("text").cast("double")).alias("duration_ms"),
        F.when((conv + turn) % 6 == 0, "error").when((conv + turn) % 3 == 0, "ok").otherwise("unset").alias("status"),
        F.when(F.col("role") == "assistant", "client").when((conv % 5 == 0) & (turn > 0), "internal").otherwise("server").alias("kind"),
        F.map_filter(
            F.create_map(
                F.lit("http.status_code"), F.when((conv + turn) % 4 == 0, "504").when((conv + turn) % 4 == 1, "200"),
                F.lit("peer.service"), F.when(F.col("role") == "assistant", F.concat(F.lit("svc"), ((conv + turn + 1) % 4).cast("string"))),
                F.lit("http.method"), F.lit("GET"),
                F.lit("traceparent"), F.when(turn % 2 == 0, "00-1"),
                F.lit("X-Request-ID"), F.when(conv % 3 == 0, F.concat(F.lit("r"), conv.cast("string"))),
                F.lit("http.resend_count"), F.when(turn == 3, "2"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("attributes"),
        F.lit("conversations").alias("source_path"),
        (conv * 100 + turn).alias("source_offset"),
    )

"""Streaming queries, run over all that is there, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.jobs.tracing import COUNTERS_SQL, SPANS_SQL
from spanloom.jobs.traffic import V
from spanloom.sources.views import executions_of, read, spans_of
from spanloom.streaming import jobs


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files; the pattern lets it be one file or a folder of them."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    def over(events: DataFrame) -> DataFrame:
        return jobs.hourly(executions_of(events).withColumn("ts", F.col("ts").cast("timestamp")))

    found = jobs.drained(stream(spark, sf_dir, "events"), over, "hourly").rows
    return found.drop("p95").withColumn("hour", F.date_format("hour", "yyyy-MM-dd'T'HH"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(stream(spark, sf_dir, "conversations"))
    return rows.withColumn("ts", F.timestamp_micros(F.floor(F.col("start_unix_nano") / 1000)))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.assembled(jobs.drained(spans(spark, sf_dir), jobs.trace_pieces, "traces").rows).drop("cut", "late", "forgotten")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(spans(spark, sf_dir), jobs.counters, "counters", None).rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "x2_streaming_traces": traces,
    "x5_streaming_hourly": hourly,
    "x6_streaming_counters": counters,
}

ORACLES = {
    "x2_streaming_traces": f"{SPANS_SQL} SELECT trace_id, span_count, errors, duration_ms, incomplete FROM traces",
    "x5_streaming_hourly": f"""{V} SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, x.service, x.operation, count(*) AS requests,
      count(*) FILTER (x.status = 'error' OR x.status LIKE '5%') AS errors, count(*) FILTER (x.timed_out) AS timeouts
      FROM executions x JOIN events e ON e.event_id = x.exec_id GROUP BY ALL""",
    "x6_streaming_counters": f"{SPANS_SQL} SELECT {COUNTERS_SQL} FROM spans",
}

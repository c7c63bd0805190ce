"""Aggregates and signals of executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.stats import (
    HOUR,
    aggregate_error,
    baseline_error,
    percentile_summary,
    window_key,
)
from spanloom.operators.quantiles import same
from spanloom.operators.quantiles import summaries as summarised

LARGE_PAYLOAD = 256 * 1024
HIGH_FANOUT = 4
REPEATED_CALLS = 3


def operation_aggregates(executions: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Counts, rates and percentile summaries per (service, operation); a null service is a
    group of its own. Percentiles are exact at any size (see quantiles); accuracy: by sketch, in
    one pass and marked `approximate`."""
    status, retries = F.col("status"), F.coalesce("retries", F.lit(0))
    calls = F.sum(F.size("downstream_calls"))
    requests = F.count("*")
    keys, values = ["service", "operation"], {
        "latency": F.col("duration_ms"), "request_bytes": F.col("request_bytes"), "response_bytes": F.col("response_bytes"),
    }
    sketches = [c for n, v in values.items() for c in percentile_summary(v, n, accuracy)] if accuracy else []
    counts = executions.groupBy(*keys).agg(
        requests.alias("requests"),
        F.count_if(aggregate_error(status)).alias("errors"),
        (F.count_if(aggregate_error(status)) / requests).alias("error_rate"),
        F.count_if(F.col("timed_out")).alias("timeouts"),
        F.sum(retries).alias("retries"),
        (F.sum(retries) / requests).alias("retry_rate"),
        calls.alias("downstream_calls"),
        (calls / requests).alias("fanout_per_request"),
        *sketches,
        F.lit(accuracy is not None).alias("approximate"),
    )
    if accuracy:
        return counts
    exact = same(counts, summarised(executions, keys, values), keys, "left")
    return exact.na.fill(0, [f"{n}_count" for n in values])


def window_counts(executions: DataFrame, pattern: str = HOUR) -> DataFrame:
    """Per (service, operation) the sorted pairs (window, requests)."""
    window = window_key(F.col("start_unix_nano"), pattern)
    counts = executions.groupBy("service", "operation", window.alias("window")).agg(
        F.count("*").alias("requests")
    )
    return counts.groupBy("service", "operation").agg(
        F.array_sort(F.collect_list(F.struct("window", "requests"))).alias("windows")
    )


def path_latency(summaries: DataFrame) -> DataFrame:
    """Latency percentiles per path of access-log rows that have a duration."""
    path = F.when(F.coalesce("path", F.lit("")) == "", "(unknown)").otherwise(F.col("path"))
    timed = summaries.where("duration_ms is not null").select(path.alias("path"), "duration_ms")
    return summarised(timed, ["path"], {"latency": F.col("duration_ms")})


def calls_of(executions: DataFrame, *keys: str) -> DataFrame:
    """A row per downstream call, with the given columns of its execution."""
    return executions.select(*keys, F.explode("downstream_calls").alias("call")).select(
        *keys, "call.*"
    )


def retry_signal(executions: DataFrame) -> DataFrame:
    """Requests that were retried and what their calls resent; no row without any."""
    resent = F.aggregate(
        F.transform("downstream_calls", lambda c: F.coalesce(c["retries"], F.lit(0))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return executions.agg(
        F.count_if(F.col("retries") > 0).alias("requests"), F.sum(resent).alias("resends")
    ).where("requests > 0 or resends > 0")


def payload_signal(executions: DataFrame) -> DataFrame:
    """The largest response, if it is large."""
    return executions.agg(F.max("response_bytes").alias("largest")).where(
        F.col("largest") >= LARGE_PAYLOAD
    )


def fanout_signal(executions: DataFrame) -> DataFrame:
    """Requests with a wide fan-out and the widest; no row without any."""
    wide = executions.select(F.size("downstream_calls").alias("n")).where(
        F.col("n") >= HIGH_FANOUT
    )
    return wide.agg(F.count("*").alias("requests"), F.max("n").alias("widest")).where(
        "requests > 0"
    )


def repeated_calls(executions: DataFrame, key: str = "exec_id") -> DataFrame:
    """Requests that call one callee three times or more: (key, detail 'callee x n, ..')."""
    counts = (
        calls_of(executions, key)
        .where(F.coalesce("callee", F.lit("")) != "")
        .groupBy(key, "callee")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= REPEATED_CALLS)
    )
    detail = F.concat("callee", F.lit(" x "), F.col("n").cast("string"))
    return counts.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(detail)), ", ").alias("detail")
    )


def timeout_signal(executions: DataFrame) -> DataFrame:
    return executions.agg(F.count_if(F.col("timed_out")).alias("requests")).where("requests > 0")


def cache_signal(executions: DataFrame) -> DataFrame:
    """Share of cache statuses that say miss or expired; no row without a status."""
    miss = F.lower("cache_status").rlike("miss|expired")
    return executions.agg(
        F.count("cache_status").alias("statuses"),
        F.count_if(miss).alias("misses"),
        F.avg(miss.cast("double")).alias("miss_share"),
    ).where("statuses > 0")


def capacity(executions: DataFrame, pattern: str = HOUR) -> DataFrame:
    """(dimension, value, state): peak requests a second by window, widest fan-out as a proxy of
    concurrency, and the dimensions that executions cannot tell, as UNKNOWN."""
    window = window_key(F.col("start_unix_nano"), pattern)
    peak = (
        executions.groupBy(window.alias("window"))
        .agg(F.count("*").alias("n"))
        .where(F.col("window") != "(unwindowed)")
        .agg((F.max("n") / 3600).alias("value"))
        .select(F.lit("throughput").alias("dimension"), "value")
    )
    wide = executions.agg(F.max(F.size("downstream_calls")).cast("double").alias("value"))
    wide = wide.select(F.lit("concurrency").alias("dimension"), "value")
    rest = executions.sparkSession.createDataFrame(
        [(d,) for d in ("cpu", "memory", "connections", "threads", "queue", "storage", "network")],
        "dimension string",
    ).withColumn("value", F.lit(None).cast("double"))
    state = F.when(F.col("value").isNull(), "UNKNOWN").otherwise("OBSERVED")
    return peak.unionByName(wide).unionByName(rest).withColumn("state", state)


def saturation(value: F.Column, elevated: F.Column, saturated: F.Column) -> F.Column:
    """Class of a value against two thresholds; UNKNOWN if any is missing."""
    missing = value.isNull() | elevated.isNull() | saturated.isNull()
    return (
        F.when(missing, "UNKNOWN")
        .when(value >= saturated, "SATURATED")
        .when(value >= elevated, "ELEVATED")
        .otherwise("NORMAL")
    )


def cost_drivers(executions: DataFrame, log_lines: int = 0) -> DataFrame:
    """(driver, amount) of what costs follow; drivers of 0 are left out."""
    both = F.coalesce("request_bytes", F.lit(0)) + F.coalesce("response_bytes", F.lit(0))
    sums = executions.agg(
        F.count("*").cast("double").alias("request_count"),
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("compute_duration_ms"),
        F.coalesce(F.sum("response_bytes"), F.lit(0)).cast("double").alias("egress_bytes"),
        F.coalesce(F.sum(both), F.lit(0)).cast("double").alias("transfer_bytes"),
        F.lit(float(log_lines)).alias("log_lines"),
    )
    return sums.unpivot([], sums.columns, "driver", "amount").where("amount > 0")


def error_budget(
    executions: DataFrame, objectives: DataFrame, pattern: str = HOUR, least: int = 8
) -> DataFrame:
    """Per objective (name, metric, target, window?): requests in its window (null: all), errors,
    remaining budget (1 - target) * total - errors; insufficient below `least` requests or if
    the metric is not an error rate. A null status is a success. Objectives are a
    configuration table, joined to counts per window, and of all windows as one without a name."""
    window = window_key(F.col("start_unix_nano"), pattern)
    counts = executions.groupBy(window.alias("at")).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(baseline_error(F.col("status")), F.lit(False))).alias("bad"),
    )
    whole = counts.agg(F.lit(None).cast("string").alias("at"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sums = objectives.join(counts.unionByName(whole), F.col("window").eqNullSafe(F.col("at")), "left").groupBy("name", "metric", "target", "window").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("errors"),
    )
    usable = (F.col("total") >= least) & F.lower("metric").contains("error")
    return sums.withColumns(
        {
            "remaining": F.when(usable, (1 - F.col("target")) * F.col("total") - F.col("errors")),
            "insufficient": ~usable,
        }
    )


def runtime_fanout(executions: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct targets per operation: a call's callee, or its operation without one."""
    target = F.when(F.coalesce("callee", F.lit("")) != "", F.col("callee")).otherwise(
        F.col("operation")
    )
    calls = calls_of(executions.withColumnRenamed("operation", "subject"), "subject")
    count = F.approx_count_distinct if approximate else F.count_distinct
    return calls.groupBy("subject").agg(count(target).alias("fanout"))


def fanout_state(runtime: DataFrame, static: DataFrame) -> DataFrame:
    """runtime (subject, fanout) and static (subject, fanout) side by side: CONFIRMED if a
    subject was seen at run time, else CANDIDATE."""
    one = runtime.select("subject", F.col("fanout").alias("observed"))
    other = static.select("subject", F.col("fanout").alias("declared"))
    state = F.when(F.col("observed").isNotNull(), "CONFIRMED").otherwise("CANDIDATE")
    return one.join(other, "subject", "full").withColumn("state", state)


def static_fanout(routes: DataFrame, call_sites: DataFrame) -> DataFrame:
    """routes (handler, path, file), call_sites (target, file): distinct targets per handler,
    only of files with one handler; null where the file has several."""
    handlers = routes.groupBy("file").agg(
        F.count_distinct("handler").alias("handlers"), F.min("handler").alias("subject")
    )
    targets = call_sites.groupBy("file").agg(F.count_distinct("target").alias("targets"))
    single = handlers.join(targets, "file", "left")
    return single.where("handlers = 1").select(
        "subject", F.coalesce("targets", F.lit(0)).alias("fanout")
    )


def large_payload(size: F.Column) -> F.Column:
    """True or false by size, null without one."""
    return size >= LARGE_PAYLOAD

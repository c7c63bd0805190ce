"""Baselines per dimension and window, and regressions against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.functions.stats import HOUR, MIN_SAMPLES, baseline_error, share, window_key
from spanloom.operators.quantiles import exact_quantiles, same

#: The bounds of the regression checks.
LATENCY_FACTOR, LATENCY_MADS, MEDIAN_SHIFT = 1.5, 3.0, 0.10
ERROR_DELTA, RETRY_DELTA, TIMEOUT_DELTA, CACHE_DROP, FANOUT_DELTA = 0.05, 0.10, 0.05, 0.10, 1.0


def robust(rows: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Per key: count, p50, p90, p95, p99, mean and MAD (median distance from the median) of
    the non-null values, exact and without a group in one place: medians first, then distances.
    `rows` are read four times."""
    narrow = rows.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null")
    found = exact_quantiles(narrow, keys, "x", (0.5, 0.9, 0.95, 0.99))
    names = [f"{prefix}_{n}" for n in ("p50", "p90", "p95", "p99")]
    found = found.select(
        *keys, F.col("n").alias(f"{prefix}_count"), F.col("mean").alias(f"{prefix}_mean"), *(F.col("q")[i].alias(n) for i, n in enumerate(names))
    )
    found = settled(found, "quantiles")
    middle = found.select(*keys, F.col(names[0]).alias("__m"))
    apart = same(narrow, middle, keys).select(*keys, F.abs(F.col("x") - F.col("__m")).alias("x"))
    mad = exact_quantiles(apart, keys, "x", (0.5,)).select(*keys, F.col("q")[0].alias(f"{prefix}_mad"))
    return same(found, mad, keys)


def baselines(executions: DataFrame, pattern: str = HOUR) -> DataFrame:
    """Per (dimension, key, window) of service, operation and route: what requests looked like.
    Rows whose own key is missing count in the other dimensions only."""
    operation = F.when(F.col("operation") != "", F.col("operation"))
    keyed = executions.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(d).alias("dimension"), k.alias("key"))
                    for d, k in (
                        ("service", F.col("service")),
                        ("operation", operation),
                        ("route", F.col("route")),
                    )
                )
            )
        ).alias("of"),
        window_key(F.col("start_unix_nano"), pattern).alias("window"),
        F.col("duration_ms"),
        baseline_error(F.col("status")).alias("error"),
        (F.col("retries") > 0).alias("retried"),
        "timed_out",
        F.col("response_bytes").cast("double").alias("bytes"),
        F.size("downstream_calls").alias("calls"),
        F.lower("cache_status").contains("hit").alias("hit"),
    ).select("of.*", "*").drop("of").where("key is not null")
    keys = ["dimension", "key", "window"]
    rates = keyed.groupBy(*keys).agg(
        F.count("*").alias("count"),
        share(F.col("error")).alias("error_rate"),
        F.count("*").cast("double").alias("throughput_per_hour"),
        share(F.col("retried")).alias("retry_rate"),
        share(F.col("timed_out")).alias("timeout_rate"),
        F.avg("calls").alias("fanout_mean"),
        share(F.col("hit")).alias("cache_hit_rate"),
    )
    keyed = settled(keyed, "keyed")
    payload = exact_quantiles(keyed, keys, "bytes", (0.95,)).select(*keys, F.col("q")[0].alias("payload_p95_bytes"))
    found = rates.join(payload, keys, "left").join(robust(keyed, keys, "duration_ms", "latency"), keys, "left")
    return found.withColumn("confidence", confidence(F.col("count")))


def confidence(count: Column) -> Column:
    return F.when(count >= MIN_SAMPLES, "MEDIUM").otherwise("UNKNOWN")


def dependency_baselines(executions: DataFrame, pattern: str = HOUR) -> DataFrame:
    """Per (callee, window) with at least one timed call; count counts all its calls."""
    window = window_key(F.col("start_unix_nano"), pattern).alias("window")
    callee = F.when(F.coalesce("call.callee", F.lit("")) != "", F.col("call.callee"))
    calls = executions.select(window, F.explode("downstream_calls").alias("call")).select(
        "window",
        F.coalesce(callee, F.lit("(unknown)")).alias("key"),
        F.col("call.duration_ms").alias("duration_ms"),
        (F.col("call.retries") > 0).alias("retried"),
    )
    keys = ["key", "window"]
    counts = calls.groupBy(*keys).agg(
        F.count("*").alias("count"), share(F.col("retried")).alias("retry_rate")
    )
    timed = settled(calls.select(*keys, "duration_ms"), "calls")
    found = counts.join(robust(timed, keys, "duration_ms", "latency"), keys)
    return found.withColumn("confidence", confidence(F.col("latency_count")))


def split_windows(executions: DataFrame, pattern: str = HOUR) -> DataFrame:
    """Executions with their `window` and `side`: current for the latest window of their
    (service, operation), baseline for all earlier ones; keys with one window drop out. The
    latest windows are aggregated and joined back, so a hot operation is not one task."""
    with_window = executions.withColumn("window", window_key(F.col("start_unix_nano"), pattern))
    ends = with_window.groupBy("service", "operation").agg(
        F.max("window").alias("latest"), F.min("window").alias("earliest")
    ).where("latest <> earliest").withColumnsRenamed({"service": "s", "operation": "o"})
    same = with_window["service"].eqNullSafe(ends["s"]) & (with_window["operation"] == ends["o"])
    side = F.when(F.col("window") == F.col("latest"), "current").otherwise("baseline")
    return with_window.join(ends, same).withColumn("side", side).drop("s", "o", "latest", "earliest")


def _beside(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the baseline's columns as b_ and the current window's as c_."""
    values = [c for c in stats.columns if c not in (*keys, "side")]
    picked = [
        F.max(F.when(F.col("side") == side, F.col(v))).alias(f"{side[0]}_{v}")
        for side in ("baseline", "current")
        for v in values
    ]
    return stats.groupBy(*keys).agg(*picked)


def shifted(split: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose current p95 is past max(1.5 p95, p95 + 3 MAD) of the baseline and whose median
    rose by more than max(MAD, 10 %), with 8 values on either side: (keys, baseline, current)."""
    narrow = settled(split.select(*keys, "side", value).where(F.col(value).isNotNull()), "sides")
    both = _beside(robust(narrow, [*keys, "side"], value, "x"), keys)
    limit = F.greatest(
        F.col("b_x_p95") * LATENCY_FACTOR, F.col("b_x_p95") + LATENCY_MADS * F.col("b_x_mad")
    )
    rise = F.greatest(F.col("b_x_mad"), F.col("b_x_p50") * MEDIAN_SHIFT)
    enough = (F.col("b_x_count") >= MIN_SAMPLES) & (F.col("c_x_count") >= MIN_SAMPLES)
    fired = enough & (F.col("c_x_p95") > limit) & (F.col("c_x_p50") > F.col("b_x_p50") + rise)
    return both.where(fired).select(
        *keys, F.col("b_x_p95").alias("baseline"), F.col("c_x_p95").alias("current")
    )


#: The checks on rates, with their bounds.
RATE_BOUNDS = {
    "APIPERF002": ERROR_DELTA, "APIPERF004": RETRY_DELTA, "APIPERF005": TIMEOUT_DELTA,
    "APIPERF007": FANOUT_DELTA, "APIPERF008": CACHE_DROP,
}
CHECKS = ("APIPERF001", "APIPERF003", "APIPERF006", *RATE_BOUNDS)


def rate_changes(split: DataFrame, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """Those of APIPERF002, 004, 005, 007 and 008 that are asked for, in one pass: (service,
    operation, check_id, baseline, current)."""
    flags = {
        "APIPERF002": baseline_error(F.col("status")),
        "APIPERF004": F.col("retries") > 0,
        "APIPERF005": F.col("timed_out"),
        "APIPERF008": F.lower("cache_status").contains("hit"),
    }
    values = {k: v.cast("double") for k, v in flags.items()}
    values["APIPERF007"] = F.size("downstream_calls").cast("double")
    values = {k: v for k, v in values.items() if k in checks}
    keys = ["service", "operation"]
    stats = split.groupBy(*keys, "side").agg(
        *(F.avg(v).alias(f"{k}_rate") for k, v in values.items()),
        *(F.count(v).alias(f"{k}_n") for k, v in values.items()),
    )
    found = F.array(
        *(
            F.struct(
                F.lit(k).alias("check_id"),
                F.col(f"b_{k}_rate").alias("baseline"),
                F.col(f"c_{k}_rate").alias("current"),
                F.least(f"b_{k}_n", f"c_{k}_n").alias("n"),
                F.lit(RATE_BOUNDS[k]).alias("bound"),
            )
            for k in values
        )
    )
    worse = F.when(
        F.col("check_id") == "APIPERF008", F.col("baseline") - F.col("current")
    ).otherwise(F.col("current") - F.col("baseline"))
    return (
        _beside(stats, keys)
        .select(*keys, F.inline(found))
        .where((F.col("n") >= MIN_SAMPLES) & (worse > F.col("bound")))
        .select(*keys, "check_id", "baseline", "current")
    )


def regressions(executions: DataFrame, pattern: str = HOUR, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """The performance checks asked for: (check_id, service, operation, callee, baseline, current).
    Only what they need is computed."""
    split = split_windows(executions, pattern)
    keys, parts = ["service", "operation"], []
    for check_id, value in (("APIPERF001", "duration_ms"), ("APIPERF006", "response_bytes")):
        if check_id in checks:
            parts.append(shifted(split, keys, value).withColumn("check_id", F.lit(check_id)))
    if "APIPERF003" in checks:
        calls = split.select(*keys, "side", F.explode("downstream_calls").alias("call"))
        calls = calls.select(*keys, "side", F.col("call.callee").alias("callee"), F.col("call.duration_ms").alias("duration_ms"))
        calls = calls.where(F.coalesce("callee", F.lit("")) != "")
        parts.append(shifted(calls, [*keys, "callee"], "duration_ms").withColumn("check_id", F.lit("APIPERF003")))
    if any(c in RATE_BOUNDS for c in checks):
        parts.append(rate_changes(split, checks))
    columns = ("check_id", "service", "operation", "callee", "baseline", "current")
    given = [p if "callee" in p.columns else p.withColumn("callee", F.lit(None).cast("string")) for p in parts]
    found = given[0].select(*columns)
    for more in given[1:]:
        found = found.unionByName(more.select(*columns))
    return found


def regressing_endpoints(findings: DataFrame) -> DataFrame:
    """Subjects that regressed in more than one window, per repo: findings (repo, subject,
    window)."""
    counts = findings.groupBy("repo", "subject").agg(F.count_distinct("window").alias("windows"))
    return counts.where("windows > 1")


def first_observations(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, as evidence."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return calls.withColumn("place", place).where("place = 1").drop("place")

"""From regressions to candidate causes: what the calls below a service show in the last window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.stats import MIN_SAMPLES, baseline_error
from spanloom.operators import graph
from spanloom.operators.quantiles import exact_quantiles

#: Event types that can explain a regression, and the order of tiers.
HINTS = ("TIMEOUT_CHANGED", "RETRY_CHANGED", "DEPENDENCY_CHANGED", "RATE_LIMIT_CHANGED", "VERSION_CHANGED")
TIERS = ("DERIVED", "RUNTIME", "STATIC", "UNKNOWN")
SLOWER = 1.5


def _edges(calls: DataFrame, *keys: str) -> DataFrame:
    """Per keys and callee: calls now and before, those that failed now, and retries now."""
    totals = calls.groupBy(*keys).agg(F.count_if(~F.col("now")).alias("before_any"))
    each = calls.where("callee is not null").groupBy(*keys, "callee").agg(
        F.count_if("now").alias("n"), F.count_if(~F.col("now")).alias("before"),
        F.count_if(F.col("now") & F.coalesce(baseline_error(F.col("status")), F.lit(False))).alias("failed"),
        F.sum(F.when(F.col("now"), F.coalesce("retries", F.lit(0))).otherwise(0)).alias("resent"),
    )
    return each.where("n > 0").join(totals, list(keys))


def cascade(executions: DataFrame, regressions: DataFrame, window: Column) -> DataFrame:
    """(service, operation, source, hop, signal): signals on the calls that each regression
    (service, operation) leads to in the latest window of all, against all earlier windows.

    The first calls are those of the operation, further ones those of the services that they
    reach, each service once. TIMEOUT failed calls, RETRY resent ones, LOAD twice the calls and
    MIN_SAMPLES or more, LATENCY a median of the called service 1.5 times the one before. Calls are
    summed per edge first, so the walk runs on a table of services.
    """
    rows = executions.withColumn("window", window)
    last = rows.agg(F.max("window").alias("last"))
    rows = rows.join(F.broadcast(last)).withColumn("now", F.col("window") == F.col("last"))  # one row
    calls = rows.select(F.coalesce("service", F.lit("(unknown)")).alias("service"), "operation", "now", F.explode("downstream_calls").alias("c"))
    calls = calls.select("service", "operation", "now", "c.callee", "c.status", "c.retries")
    timed = rows.where("duration_ms <> 0").select(F.coalesce("service", F.lit("(unknown)")).alias("callee"), "now", "duration_ms")
    timed = exact_quantiles(timed, ["callee", "now"], "duration_ms", (0.5,)).groupBy("callee").agg(
        F.max(F.when(F.col("now"), F.col("q")[0])).alias("slow"), F.max(F.when(~F.col("now"), F.col("q")[0])).alias("usual")
    )
    first = _edges(calls, "service", "operation").join(regressions.select("service", "operation").distinct(), ["service", "operation"], "left_semi")
    whole = _edges(calls, "service")
    starts = first.select("service", "operation", F.col("callee").alias("node")).distinct()
    below = graph.reachable(whole.select(F.col("service").alias("source"), F.col("callee").alias("target")), starts.select("node").distinct())
    deeper = starts.join(below.select(F.col("start").alias("node"), F.col("node").alias("at")), "node").select("service", "operation", "at")
    visited = starts.select("service", "operation", F.col("node").alias("at")).union(deeper).distinct().where("at <> service")
    more = visited.join(whole.withColumnRenamed("service", "at"), "at")
    columns = ["service", "operation", "at", "callee", "n", "before", "failed", "resent", "before_any"]
    every = first.withColumn("at", F.col("service")).select(*columns).union(more.select(*columns)).join(timed, "callee", "left")
    signals = F.array_compact(F.array(
        F.when(F.col("failed") > 0, "TIMEOUT"), F.when(F.col("resent") > 0, "RETRY"),
        F.when((F.col("before_any") > 0) & (F.col("n") > 2 * F.col("before")) & (F.col("n") >= MIN_SAMPLES), "LOAD"),
        F.when(F.col("slow") > SLOWER * F.col("usual"), "LATENCY"),
    ))
    return every.select("service", "operation", F.col("at").alias("source"), F.col("callee").alias("hop"), F.explode(signals).alias("signal"))


def candidates(regressions: DataFrame, hops: DataFrame, events: DataFrame) -> DataFrame:
    """(service, operation, rank, tier, subject, kind): candidate causes of each regression.

    events: (type, kind, subject). A change of the service, of one of its calls 'service->other',
    or of a hop's service counts: DERIVED if a hop shows a signal there, else STATIC. Failing or
    resent calls to a service that nothing changed are RUNTIME.
    """
    ways = hops.select("service", "operation", F.col("hop").alias("node"), F.lit(True).alias("signalled")).distinct()
    own = regressions.select("service", "operation", F.col("service").alias("node"), F.lit(False).alias("signalled")).distinct()
    hints = events.where(F.col("type").isin(*HINTS)).select("kind", "subject").distinct()
    direct = ways.join(hints.withColumn("node", F.col("subject")), "node")
    mine = own.join(hints.withColumn("node", F.explode(F.array_distinct(F.array("subject", F.split("subject", "->")[0])))), "node")
    named = direct.union(mine.select(*direct.columns)).groupBy("service", "operation", "subject", "kind").agg(F.bool_or("signalled").alias("signalled"))
    named = named.select("service", "operation", F.when(F.col("signalled"), "DERIVED").otherwise("STATIC").alias("tier"), "subject", "kind")
    silent = hops.where(F.col("signal").isin("TIMEOUT", "RETRY")).join(events.select(F.col("subject").alias("hop")).distinct(), "hop", "left_anti")
    seen = silent.select("service", "operation", F.lit("RUNTIME").alias("tier"), F.col("hop").alias("subject"), F.concat(F.lit("runtime_"), F.lower("signal")).alias("kind"))
    tier = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    place = W.partitionBy("service", "operation").orderBy(tier, "subject", "kind")
    return named.union(seen).distinct().withColumn("rank", F.row_number().over(place)).select("service", "operation", "rank", "tier", "subject", "kind")


def objectives_of(regressions: DataFrame, objectives: DataFrame) -> DataFrame:
    """(service, operation, objective): objectives (name) whose name holds the service or the operation of
    a regression. Names are short: the texts within each are listed and meet by equality."""
    name = F.col("name")
    starts = F.sequence(F.lit(1), F.length(name))
    texts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substr(name, i, n))))
    held = objectives.where("name <> ''").select(name.alias("objective"), F.explode(F.array_distinct(texts)).alias("text"))
    own = regressions.select("service", "operation", F.explode(F.array("service", "operation")).alias("text")).where("text <> ''")
    return own.join(held, "text").select("service", "operation", "objective").distinct()


def episodes(regressions: DataFrame, hops: DataFrame, causes: DataFrame, most: int = 10) -> DataFrame:
    """One row a regression: signals, affected services (the first `most` and their number), and
    the number and first of the candidate causes."""
    key = ["service", "operation"]
    own = regressions.select(*key, F.col("service").alias("node"))
    nodes = own.union(hops.select(*key, "hop")).distinct()
    place = W.partitionBy(*key).orderBy("node")
    listed = nodes.withColumn("at", F.row_number().over(place)).groupBy(*key).agg(
        F.count("*").alias("affected"), F.array_sort(F.collect_list(F.when(F.col("at") <= most, F.col("node")))).alias("first_affected")
    )
    signals = hops.groupBy(*key).agg(F.count("*").alias("signals"))
    top = causes.groupBy(*key).agg(F.count("*").alias("candidates"), F.min_by(F.struct("tier", "subject", "kind"), "rank").alias("top"))
    rows = listed.join(signals, key, "left").join(top, key, "left").na.fill(0, ["signals", "candidates"])
    return rows.select(*key, "signals", "affected", "first_affected", "candidates", "top.tier", "top.subject", "top.kind")

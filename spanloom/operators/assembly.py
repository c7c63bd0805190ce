"""Requests and traces from spans, as joins and aggregates.

Spans of one trace are never gathered in one place: parents are found by joins on (trace,
span id), and walks up or down a trace double their step each round. So a trace of any size,
and the bucket of all spans without a trace, spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled, settled_counting
from spanloom.functions.ordering import numbered

TRACELESS = "(none)"
#: Attribute keys, first found first.
REQUEST_ID = ("x-request-id", "x-correlation-id", "request_id", "http.request.header.x-request-id")
RETRIES = ("http.resend_count", "retry.count", "grpc.retries")
ATTEMPTS = ("x-envoy-attempt-count", "upstream_attempt")
CACHE = ("http.cache_status", "x-cache", "cache.status")
METHOD = ("http.request.method", "http.method")
REQUEST_BYTES = ("http.request.body.size", "http.request_content_length")
RESPONSE_BYTES = ("http.response.body.size", "http.response_content_length")
STATUS = ("http.status_code", "http.response.status_code")
ERRORS = ("error.type", "otel.status_description", "error.message")
CALLEE = ("peer.service", "server.address", "rpc.service", "http.host", "db.system", "messaging.destination")
CORRELATION = ("traceparent", "x-request-id", "x-correlation-id", "request_id", "trace_id", "b3")
ERROR_CONTEXT = ("error", "error.type", "error.message", "exception.type", "otel.status_description")
SEGMENT_CALLEE = ("peer.service", "server.address", "rpc.service", "http.host")
ROUNDS = 30  # doublings: walks of up to 2**30 steps


def first_of(attributes: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key present, whatever its case."""
    lower = F.map_from_entries(
        F.array_distinct(
            F.transform(F.map_entries(attributes), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        )
    )
    return F.coalesce(*(F.try_element_at(lower, F.lit(k)) for k in keys))


def observed_retries(attributes: Column) -> Column:
    direct, attempts = first_of(attributes, RETRIES), first_of(attributes, ATTEMPTS)
    zero = F.lit(0).cast("long")

    def at_least_zero(value: Column) -> Column:
        return F.when(value.isNotNull(), F.greatest(zero, value))

    return F.when(direct.isNotNull(), at_least_zero(direct.try_cast("long"))).otherwise(
        at_least_zero(attempts.try_cast("long") - 1)
    )


def protocol(attributes: Column, kind: Column) -> Column:
    def at(key: str) -> Column:
        value = F.try_element_at(attributes, F.lit(key))
        return F.when(value != "", value)

    name, version = at("network.protocol.name"), at("network.protocol.version")
    url = F.array_contains(F.map_keys(attributes), F.lit("http.url"))
    for key in ("http.route", "url.full"):
        url = url | F.array_contains(F.map_keys(attributes), F.lit(key))
    return F.coalesce(
        at("rpc.system"),
        at("messaging.system"),
        F.when(version.isNotNull(), F.concat(name, F.lit("/"), version)).otherwise(name),
        F.when((kind == "client") & url, F.lit("http")),
    )


def span_status(attributes: Column, status: Column) -> Column:
    return F.coalesce(first_of(attributes, STATUS), F.when(status.isin("error", "ok"), status))


def timed_out(attributes: Column) -> Column:
    code, error = first_of(attributes, STATUS), F.lower(first_of(attributes, ERRORS))
    by_code = F.coalesce(code.isin("408", "504"), F.lit(False))
    by_text = F.coalesce(error.rlike("timeout|deadline|timed out"), F.lit(False))
    return F.when(code.isNotNull() | error.isNotNull(), by_code | by_text)


def placed(spans: DataFrame) -> DataFrame:
    """Spans with `tid` (trace, or the bucket of spans without one), `place` in their trace's
    order, `id` and `parent` (null for empty), and `is_exec`: a server span, or the first root
    of a trace without server spans."""
    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    order = F.struct("operation", "source_path", "source_offset")
    rows = spans.withColumns(
        {
            "tid": F.coalesce(filled("trace_id"), F.lit(TRACELESS)),
            "place": order,
            "id": filled("span_id"),
            "parent": filled("parent_id"),
        }
    )
    traces = rows.groupBy("tid").agg(
        F.bool_or(F.col("kind") == "server").alias("has_server"),
        F.min(F.when(F.col("parent").isNull(), F.col("place"))).alias("first_root"),
    )
    is_exec = F.when(F.col("has_server"), F.col("kind") == "server").otherwise(
        F.coalesce(F.col("place") == F.col("first_root"), F.lit(False))
    )
    return by_trace(rows, traces).withColumn("is_exec", is_exec).drop("has_server", "first_root")


def by_trace(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """rows joined with traces, one row a tid. The spans without a trace share one tid, which may
    be a third of all: its one row is sent to them, and the other traces meet theirs by key."""
    bucket = F.broadcast(traces.where(F.col("tid") == TRACELESS))  # one row
    rest = traces.where(F.col("tid") != TRACELESS)
    return rows.where(F.col("tid") != TRACELESS).join(rest, "tid").unionByName(rows.where(F.col("tid") == TRACELESS).join(bucket, "tid"))


def first_spans(rows: DataFrame) -> DataFrame:
    """One row per (tid, id): the first of doubled ids, and whether any of them is_exec."""
    return rows.where("id is not null").groupBy("tid", "id").agg(
        F.min_by(F.struct("place", "parent", "service", "is_exec", "operation"), "place").alias("of"),
        F.bool_or("is_exec").alias("id_is_exec"),
        F.count("*").alias("times"),
    )


def doubled_ids(spans: DataFrame) -> DataFrame:
    """(tid, id, times): span ids that occur more than once in a trace, a row each."""
    return first_spans(placed(spans)).where("times > 1").select("tid", "id", "times")


def executions(rows: DataFrame) -> DataFrame:
    """An execution row per span with is_exec; rows as from placed()."""
    a = F.col("attributes")
    route = F.try_element_at(a, F.lit("http.route"))
    return rows.where("is_exec").select(
        "tid",
        "place",
        first_of(a, REQUEST_ID).alias("request_id"),
        "trace_id",
        "service",
        "operation",
        first_of(a, METHOD).alias("method"),
        F.coalesce(F.when(route != "", route), F.col("operation")).alias("route"),
        "start_unix_nano",
        "duration_ms",
        span_status(a, F.col("status")).alias("status"),
        first_of(a, REQUEST_BYTES).try_cast("long").alias("request_bytes"),
        first_of(a, RESPONSE_BYTES).try_cast("long").alias("response_bytes"),
        observed_retries(a).alias("retries"),
        first_of(a, CACHE).alias("cache_status"),
        timed_out(a).alias("timed_out"),
    )


def _nearest(nodes: DataFrame) -> DataFrame:
    """(tid, id, owner): for each span id the nearest one at or above it whose id is_exec.

    Steps to the parent stop at such ids and are doubled each round. Whatever is 2**r steps or more
    away has an id on its way that stops in round r; so where a round stops none, those that
    still walk go round in circles, and have no owner.
    """
    walks = "not done and `to` is not null"
    start = nodes.select(
        "tid",
        "id",
        F.when(F.col("id_is_exec"), F.col("id")).otherwise(F.col("of.parent")).alias("to"),
        F.col("id_is_exec").alias("done"),
    )
    step, walking = settled_counting(start, "walk", walks)
    for _ in range(ROUNDS):
        if not walking:
            break
        ahead = step.select("tid", F.col("id").alias("to"), F.col("to").alias("next"), F.col("done").alias("ends"))
        further = step.join(ahead, ["tid", "to"], "left").select(
            "tid",
            "id",
            F.when(F.col("done"), F.col("to")).otherwise(F.col("next")).alias("to"),
            (F.col("done") | F.coalesce("ends", F.lit(False))).alias("done"),
        )
        before = walking
        step, walking = settled_counting(further, "walk", walks)
        if walking == before:
            break
    return step.where("done").select("tid", "id", F.col("to").alias("owner"))


def downstream_calls(rows: DataFrame) -> DataFrame:
    """Each client and producer span with the execution it belongs to: its nearest ancestor that
    is one, or the trace's first execution (`orphan`). Traces without executions have none."""
    rows = settled(rows, "placed")  # read by each of the branches below
    nodes = settled(first_spans(rows), "nodes")
    owners = _nearest(nodes)
    firsts = rows.where("is_exec").groupBy("tid").agg(F.min("place").alias("first_exec"))
    a = F.col("attributes")
    calls = rows.where(F.col("kind").isin("client", "producer")).select(
        "tid",
        F.col("place").alias("call_place"),
        "parent",
        first_of(a, CALLEE).alias("callee"),
        "operation",
        "duration_ms",
        span_status(a, F.col("status")).alias("status"),
        observed_retries(a).alias("retries"),
        protocol(a, F.col("kind")).alias("protocol"),
    )
    above = owners.withColumnRenamed("id", "parent")
    owner = nodes.where("of.is_exec").select(
        "tid", F.col("id").alias("owner"), F.col("of.place").alias("owner_place")
    )
    parents = nodes.select("tid", F.col("id").alias("parent"), F.col("of.service").alias("caller"))
    return (
        calls.join(above, ["tid", "parent"], "left")
        .join(owner, ["tid", "owner"], "left")
        .join(parents, ["tid", "parent"], "left")
        .transform(lambda found: by_trace(found, firsts))
        .select(
            "tid",
            F.coalesce("owner_place", "first_exec").alias("place"),
            F.col("owner_place").isNull().alias("orphan"),
            *("caller", "callee", "operation", "duration_ms", "status", "retries", "protocol"),
        )
    )


def call_counts(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Executions with the number of their `calls` and `operations`, an array of (operation, n) in
    order. Calls are counted before they meet in a row, which grows with the distinct
    operations and not with the calls."""
    each = calls.groupBy("tid", "place", "operation").agg(F.count("*").alias("n"))
    lists = each.groupBy("tid", "place").agg(
        F.sum("n").alias("calls"), F.array_sort(F.collect_list(F.struct("operation", "n"))).alias("operations")
    )
    none = F.array().cast(lists.schema["operations"].dataType)
    return found.join(lists, ["tid", "place"], "left").withColumns(
        {"calls": F.coalesce("calls", F.lit(0).cast("long")), "operations": F.coalesce("operations", none)}
    )


def ordered_calls(calls: DataFrame) -> DataFrame:
    """calls as from downstream_calls, with `at`: their place, from 1, among the calls of their
    execution, by operation and callee (null first). Calls stay rows, and are numbered in ranges, so
    an execution with a third of all calls, as that of the spans without a trace, is spread."""
    keyed = calls.withColumn("to", F.coalesce("callee", F.lit("")))
    order = ["operation", "to", "caller", "duration_ms", "status", "retries", "protocol"]
    return numbered(keyed, ["tid", "place"], order).withColumnRenamed("rank", "at").drop("to")


def traces(spans: DataFrame, keep: int | None = None) -> DataFrame:
    """(trace_id, root_service, duration_ms, errors, span_count, orphans, incomplete, cut): a
    trace is incomplete unless it has one root and every parent is another span of it. keep:
    the spans a trace may keep, of which `cut` counts the excess."""
    return traces_of(placed(spans), keep)


def traces_of(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """traces of rows as from placed()."""
    ids = rows.where("id is not null").select("tid", F.col("id").alias("parent"), F.lit(True).alias("there")).distinct()
    joined = rows.join(ids, ["tid", "parent"], "left")
    lost = F.col("parent").isNotNull() & F.col("there").isNull()
    broken = lost | F.coalesce(F.col("parent") == F.col("id"), F.lit(False))
    roots = F.count_if(F.col("parent").isNull())
    found = joined.groupBy(F.col("tid").alias("trace_id")).agg(
        F.when(roots == 1, F.max(F.when(F.col("parent").isNull(), F.col("service")))).alias("root_service"),
        F.max(F.coalesce("duration_ms", F.lit(0.0))).alias("duration_ms"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count("*").alias("span_count"),
        F.count_if(lost).alias("orphans"),
        (F.bool_or(broken) | (roots != 1)).alias("incomplete"),
    )
    over = F.greatest(F.lit(0).cast("long"), F.col("span_count") - keep) if keep is not None else F.lit(0).cast("long")
    return found.withColumn("cut", over)


def kept_spans(spans: DataFrame, keep: int) -> DataFrame:
    """The first `keep` spans of each trace, by their place, with `rank` from 1; `traces` counts the
    others. No trace is gathered: ranks are dealt in ranges of places."""
    return numbered(placed(spans), ["tid"], ["place"]).where(F.col("rank") <= keep)


def critical_paths(spans: DataFrame) -> DataFrame:
    """(trace_id, path): operations from the root of each complete trace along the longest
    child, ties to the larger operation. Steps to that child double each round and add to the
    root's path the places that they reach, so only paths are listed, in the end."""
    columns = ("tid", "id", "parent", "operation", "duration_ms", "place", "service", "status")
    rows = settled(placed(spans).select(*columns), "placed")
    whole = traces_of(rows).where("not incomplete").select(F.col("trace_id").alias("tid"), "span_count")
    rows = rows.join(settled(whole, "complete"), "tid")
    best = F.struct(F.coalesce("duration_ms", F.lit(0.0)), "operation", "place")
    longest = rows.where("parent is not null").groupBy("tid", F.col("parent").alias("id")).agg(
        F.max_by(F.struct("id", "operation"), best).alias("of")
    )
    longest = settled(longest.select("tid", "id", F.col("of.id").alias("to"), F.col("of.operation").alias("operation")), "longest")
    step = longest  # with the operation of the span that it ends at: a doubled id has one under each parent
    members = rows.where("parent is null").select("tid", "id", F.lit(0).cast("long").alias("at"), "operation", "span_count")
    for k in range(ROUNDS):
        more = members.drop("operation").join(step, ["tid", "id"])
        more = more.select("tid", F.col("to").alias("id"), (F.col("at") + (1 << k)).alias("at"), "operation", "span_count")
        more, found = settled_counting(more.where("at < span_count"), "members", F.lit(True))  # doubled ids may lead round in a circle
        if not found:
            break
        members = members.union(more)
        ahead = step.select("tid", F.col("id").alias("to"), F.col("to").alias("next"), "operation")
        step = settled(step.drop("operation").join(ahead, ["tid", "to"]).select("tid", "id", F.col("next").alias("to"), "operation"), "steps")
    listed = members.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("at", "operation"))).alias("path"))
    return listed.select(F.col("tid").alias("trace_id"), F.col("path.operation").alias("path"))


def latency_segments(spans: DataFrame) -> DataFrame:
    """(trace_id, label, duration_ms, share): a trace's time by label; a service's time is what
    its spans' children leave, at least 0, and calls count in full by callee. Shares are of
    the trace's longest span; labels without time are left out."""
    rows = placed(spans)
    a = F.col("attributes")
    children = rows.where("parent is not null").groupBy("tid", F.col("parent").alias("id")).agg(
        F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("below")
    )
    filled = [F.try_element_at(a, F.lit(k)) for k in SEGMENT_CALLEE]
    callee = F.coalesce(*(F.when(v != "", v) for v in filled), F.lit("(unknown)"))
    words = F.lower(F.concat_ws(" ", "operation", F.map_keys(a)))
    label = (
        F.when(F.col("kind").isin("client", "producer"), F.concat(F.lit("downstream:"), callee))
        .when(words.rlike("auth|oauth|jwt|token"), "auth")
        .when(words.rlike("serializ|marshal|encode|decode|codec"), "serialization")
        .otherwise(F.concat(F.lit("service:"), F.col("service")))
    )
    own = F.coalesce("duration_ms", F.lit(0.0))
    rest = F.greatest(F.lit(0.0), own - F.coalesce("below", F.lit(0.0)))
    sums = (
        rows.join(children, ["tid", "id"], "left")
        .withColumn("label", label)
        .groupBy("tid", "label")
        .agg(F.sum(F.when(F.col("label").startswith("service:"), rest).otherwise(own)).alias("duration_ms"))
    )
    total = rows.groupBy("tid").agg(F.max(own).alias("total"))
    return by_trace(sums, total).where("duration_ms > 0").select(
        F.col("tid").alias("trace_id"),
        "label",
        "duration_ms",
        F.when(F.col("total") > 0, F.col("duration_ms") / F.col("total")).otherwise(0.0).alias("share"),
    )


def budget_check(segments: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (hop, limit_ms) against segments: a hop means service:<hop>, downstream:<hop> or
    the label itself, in that order; (trace_id, hop, label, verdict)."""
    tried = budgets.select("hop", "limit_ms", F.posexplode(F.array(
        F.concat(F.lit("service:"), "hop"), F.concat(F.lit("downstream:"), "hop"), F.col("hop"),
    )).alias("rank", "label"))
    every = segments.select("trace_id").distinct()
    found = segments.join(tried, "label").groupBy("trace_id", "hop").agg(
        F.min_by(F.struct("label", "duration_ms", "limit_ms"), "rank").alias("of")
    )
    verdict = (
        F.when(F.col("of").isNull(), "unknown")
        .when(F.col("of.duration_ms") > F.col("of.limit_ms"), "over")
        .otherwise("within")
    )
    hops = budgets.agg(F.array_sort(F.collect_set("hop")).alias("hops")).scalar()
    pairs = every.withColumn("hops", hops).select("trace_id", F.explode("hops").alias("hop"))
    return pairs.join(found, ["trace_id", "hop"], "left").select("trace_id", "hop", "of.label", verdict.alias("verdict"))


def _names() -> Column:
    return F.map_keys("attributes")


def _has(*wanted: str) -> Column:
    return F.arrays_overlap(_names(), F.array(*(F.lit(n) for n in wanted)))


def correlating() -> Column:
    """The correlation keys among a span's attributes, as they are or in lower case."""
    both = F.array_union(_names(), F.transform(_names(), lambda n: F.lower(n)))
    return F.array_intersect(both, F.array(*(F.lit(k) for k in CORRELATION)))


def span_counters(parent: Column) -> dict[str, Column]:
    """Counters over spans, by name; correlation_ids counts one per span and matching key. A column
    for each key tells how many spans have it."""
    found = correlating()
    counters = {
        "tracing": F.count("*"),
        "metrics": F.count("duration_ms"),
        "correlation_ids": F.sum(F.size(found)),
        "trace_propagation": F.count_if(parent.isNotNull() | _has("traceparent", "b3")),
        "errors_without_context": F.count_if((F.col("status") == "error") & ~_has(*ERROR_CONTEXT)),
        "without_duration": F.count_if(F.col("duration_ms").isNull()),
    }
    keys = {f"with_{k.replace('-', '_')}": F.count_if(F.array_contains(found, k)) for k in CORRELATION}
    return {n: F.coalesce(c, F.lit(0)).cast("long") for n, c in (counters | keys).items()}


def log_counters(summaries: DataFrame) -> DataFrame:
    """One row of counters over access-log rows (request_id, trace_id, duration_ms)."""
    return summaries.agg(
        F.count("*").alias("structured_logs"),
        F.count_if(F.coalesce("request_id", F.lit("")) != "").alias("request_ids"),
        F.count_if(F.coalesce("trace_id", F.lit("")) != "").alias("trace_propagation"),
        F.count("duration_ms").alias("metrics"),
    )


def signals(spans: DataFrame, summaries: DataFrame) -> DataFrame:
    """(signal, n): the counters of spans and logs, those of one name added, and orphans."""
    def long(one: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).cast("long").alias("n")) for c in one.columns))
        return one.select(F.inline(pairs))

    traced = observability(spans)
    both = long(traced.select(*(c for c, t in traced.dtypes if t == "bigint"))).union(long(log_counters(summaries)))
    return both.groupBy("signal").agg(F.sum("n").alias("n"))


def operation_names(spans: DataFrame) -> DataFrame:
    """(operation, n): the distinct operation names, a row each."""
    return spans.groupBy("operation").agg(F.count("*").alias("n"))


def observability(spans: DataFrame) -> DataFrame:
    """One row of counters over all spans; see span_counters. orphans: spans whose parent is no
    span of their trace. Names, which may be many, are rows of `operation_names`."""
    rows = placed(spans)
    parents = rows.where("id is not null").select("tid", F.col("id").alias("parent"), F.lit(True).alias("there")).distinct()
    joined = rows.join(parents, ["tid", "parent"], "left")
    lost = F.count_if(F.col("parent").isNotNull() & F.col("there").isNull()).alias("orphans")
    return joined.agg(*(c.alias(n) for n, c in span_counters(F.col("parent")).items()), lost)

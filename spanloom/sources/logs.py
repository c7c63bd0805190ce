"""Trace exports and access logs as typed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import redact_map

#: The line forms of two access logs, and of a request id within a line.
NGINX = r'^\S+ \S+ \S+ \[[^\]]+\] "([A-Z]+) (\S+)[^"]*" (\d{3}) (\d+)'
ENVOY = r'^\[[^\]]+\] "([A-Z]+) (\S+) [^"]*" (\d{3})'
REQUEST_ID = r'(?i)\b(x-request-id|x-correlation-id|request_id|traceparent)\b[:=]\s*"?([\w-]+)'
KINDS = ("internal", "internal", "server", "client", "producer", "consumer")
STATUSES = ("unset", "ok", "error")

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,attributes:{ATTRIBUTES},status:struct<code:int>>"
)
EXPORT = f"resourceSpans array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{SPAN}>>>>>"

#: Readers by name: (session, path) -> spans or summaries.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str) -> Callable:
    """Registers a reader of a format of one's own."""

    def keep(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        READERS[name] = function
        return function

    return keep


def attribute_map(attributes: Column) -> Column:
    """A list of typed attributes as a map of texts, the last of equal keys; secrets masked."""

    def text(value: Column) -> Column:
        return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"))

    known = F.filter(attributes, lambda a: a["key"].isNotNull() & text(a["value"]).isNotNull())
    pairs = F.transform(known, lambda a: F.struct(a["key"].alias("key"), text(a["value"]).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return redact_map(F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>")))


@reader("otlp-json")
def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Spans of trace exports, one JSON document a line; others give no rows. A start of 0 is
    unknown, and a duration needs an end that is not before the start.

    source_offset rises with a span's place in its file and is its own there, whatever its line,
    resource and scope: it is the byte at which its part of the file begins and the number of
    spans read in the task before it, which are fewer than a part's bytes.
    """
    docs = spark.read.schema(EXPORT).json(path)
    docs = docs.select("resourceSpans", F.input_file_name().alias("source_path"), F.col("_metadata.file_block_start").alias("begin"))
    each = docs.select("source_path", "begin", F.explode("resourceSpans").alias("r"))
    each = each.select("source_path", "begin", F.col("r.resource.attributes").alias("of"), F.explode("r.scopeSpans").alias("s"))
    each = each.select("source_path", "begin", "of", F.explode("s.spans").alias("x"))
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    each = each.select("source_path", "of", "x", (F.col("begin") + number).alias("source_offset"))
    own, outer = attribute_map(F.col("x.attributes")), attribute_map(F.col("of"))
    each = each.withColumns({"attributes": own, "outer": outer, "start": F.col("x.startTimeUnixNano").try_cast("long"), "end": F.col("x.endTimeUnixNano").try_cast("long")})

    def at(name: str, column: str = "attributes") -> Column:
        value = F.try_element_at(column, F.lit(name))
        return F.when(value != "", value)

    def code(names: tuple[str, ...], number: Column) -> Column:
        listed = F.array(*(F.lit(n) for n in names))
        return F.when(number.between(0, len(names) - 1), F.element_at(listed, number + 1)).otherwise(names[0])

    rpc = F.when(at("rpc.service").isNotNull() & at("rpc.method").isNotNull(), F.concat(at("rpc.service"), F.lit("/"), at("rpc.method")))
    timed = (F.col("end") > 0) & (F.col("end") >= F.coalesce("start", F.lit(0)))
    return each.select(
        F.coalesce(at("service.name", "outer"), at("service.name"), F.lit("(unknown)")).alias("service"),
        F.coalesce(at("http.route"), rpc, F.when(F.col("x.name") != "", F.col("x.name")), F.lit("(unnamed)")).alias("operation"),
        F.when(F.col("x.parentSpanId") != "", F.col("x.parentSpanId")).alias("parent_id"),
        F.when(F.col("x.spanId") != "", F.col("x.spanId")).alias("span_id"),
        F.when(F.col("x.traceId") != "", F.col("x.traceId")).alias("trace_id"),
        F.when(F.col("start") != 0, F.col("start")).alias("start_unix_nano"),
        F.when(timed, (F.col("end") - F.col("start")) / 1e6).alias("duration_ms"),
        code(STATUSES, F.col("x.status.code")).alias("status"),
        code(KINDS, F.col("x.kind")).alias("kind"),
        "attributes",
        "source_path",
        F.col("source_offset").cast("long").alias("source_offset"),
    )


@reader("access-log")
def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Request summaries of nginx and envoy lines; other lines are dropped."""
    lines = spark.read.text(path).withColumn("source_path", F.input_file_name())

    def part(group: int) -> Column:
        one, other = F.regexp_extract("value", NGINX, group), F.regexp_extract("value", ENVOY, min(group, 3))
        return F.when(one != "", one).otherwise(F.when(other != "", other))

    sent, rid = F.regexp_extract("value", NGINX, 4), F.regexp_extract("value", REQUEST_ID, 2)
    return lines.where(F.col("value").rlike(NGINX) | F.col("value").rlike(ENVOY)).select(
        part(1).alias("method"),
        part(2).alias("path"),
        part(3).cast("int").alias("status"),
        F.lit(None).cast("double").alias("duration_ms"),
        F.when(rid != "", rid).alias("request_id"),
        F.lit(None).cast("string").alias("trace_id"),
        F.when(sent != "", sent).cast("long").alias("bytes_sent"),
        "source_path",
    )


def executions_of_summaries(summaries: DataFrame) -> DataFrame:
    """Access-log rows as executions: the path is the operation, the service unknown. `unknowns`
    names what a row lacks: its service, and a request id."""
    path = F.when(F.col("path") != "", F.col("path"))
    lacks = F.array_compact(F.array(F.lit("service"), F.when(F.col("request_id").isNull(), "request_id")))
    return summaries.select(
        "request_id", "trace_id", F.lit(None).cast("string").alias("service"),
        F.coalesce(path, F.lit("(unknown)")).alias("operation"), "method", path.alias("route"),
        F.col("status").cast("string").alias("status"), "duration_ms", F.col("bytes_sent").alias("response_bytes"), lacks.alias("unknowns"),
    )


def all_executions(traced: DataFrame, logged: DataFrame) -> DataFrame:
    """Executions of traces and of access logs as one table with their `origin`; columns that
    logs lack are null, and traces have no unknowns of their own."""
    none = F.array().cast("array<string>")
    both = traced.withColumns({"origin": F.lit("trace"), "unknowns": none}).unionByName(
        logged.withColumn("origin", F.lit("log")), allowMissingColumns=True
    )
    return both

"""Contract operations against implemented routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import drift_path, path_variables
from spanloom.operators.contracts import identity

#: Methods that write; severities of a one-sided operation or route by authority.
WRITES = ("POST", "PUT", "PATCH", "DELETE")
LOST = {"OPENAPI": "HIGH", "IMPLEMENTATION": "LOW"}
EXTRA = {"OPENAPI": "MEDIUM", "IMPLEMENTATION": "LOW"}
KEY = ("project", "method", "norm_path")
PARAMETERS = "array<struct<name:string,location_in:string,required:boolean>>"


def _normal(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"method": F.upper(F.trim("method")), "norm_path": drift_path(F.col("path"))})


def pairs(operations: DataFrame, routes: DataFrame) -> DataFrame:
    """(project, op, route, how) of every operation and route, the other one null where it has
    no partner.

    operations: (project, method, path, operation_id, ..). routes: (project, method, path,
    handler, ..). Of rows with equal method and normalised path the least counts. They pair by
    that key; what is left pairs by operation id and the last name of the handler, of equal
    ones the least.
    """
    ops = _normal(operations).withColumn("identity", identity(F.col("method"), F.col("path"), F.col("operation_id")))
    ways = _normal(routes).withColumn("tail", F.element_at(F.split("handler", r"\."), -1))
    own = ["identity", "operation_id", *(c for c in ops.columns if c not in (*KEY, "identity", "operation_id"))]
    theirs = ["handler", "tail", *(c for c in ways.columns if c not in (*KEY, "handler", "tail"))]
    a = ops.groupBy(*KEY).agg(F.min(F.struct(*own, "method", "norm_path")).alias("op"))
    b = ways.groupBy(*KEY).agg(F.min(F.struct(*theirs, "method", "norm_path")).alias("route"))
    both = a.join(b.hint("merge"), list(KEY), "full")
    by_path = both.where("op is not null and route is not null").select("project", "op", "route", F.lit("path").alias("how"))
    left = both.where("route is null").select("project", "op")
    right = both.where("op is null").select("project", "route")
    named = left.where("op.operation_id is not null").groupBy("project", F.col("op.operation_id").alias("name")).agg(F.min("op").alias("op"))
    tailed = right.groupBy("project", F.col("route.tail").alias("name")).agg(F.min("route").alias("route"))
    by_name = named.join(tailed.hint("merge"), ["project", "name"]).select("project", "op", "route", F.lit("identity").alias("how"))

    def rest(rows: DataFrame, side: str) -> DataFrame:
        taken = by_name.select("project", *(F.col(f"{side}.{c}").alias(c) for c in KEY[1:]))
        keyed = rows.select("project", side, *(F.col(f"{side}.{c}").alias(c) for c in KEY[1:]))
        return keyed.join(taken.hint("merge"), list(KEY), "left_anti").select("project", side)

    null_op, null_route = (F.lit(None).cast(both.schema[c].dataType).alias(c) for c in ("op", "route"))
    alone = rest(left, "op").select("project", "op", null_route, F.lit("none").alias("how"))
    extra = rest(right, "route").select("project", null_op, "route", F.lit("none").alias("how"))
    return by_path.union(by_name).union(alone).union(extra)


def _found(rows: DataFrame, check: Column | str, severity: Column | str, of: str) -> DataFrame:
    check, severity = (F.lit(x) if isinstance(x, str) else x for x in (check, severity))
    return rows.select(
        "project", check.alias("id"), severity.alias("severity"), F.col(f"{of}.method").alias("method"), F.col(f"{of}.path").alias("path")
    )


def one_sided(paired: DataFrame, operations: DataFrame, routes: DataFrame, authority: str = "UNKNOWN") -> DataFrame:
    """(project, id, severity, method, path). DRIFT001: an operation without route. DRIFT002: a
    route without operation, and DRIFT010 too if it writes. DRIFT003 instead if the other side
    has the path with other methods, and for pairs by name whose method or path differ.
    authority (OPENAPI, IMPLEMENTATION, UNKNOWN) says which side is right."""

    def methods(rows: DataFrame) -> DataFrame:
        return _normal(rows).select("project", "norm_path", "method").distinct()

    def elsewhere(rows: DataFrame, side: str, other: DataFrame) -> DataFrame:
        own = rows.select("project", side, F.col(f"{side}.norm_path").alias("norm_path"), F.col(f"{side}.method").alias("own"))
        there = own.join(other.hint("merge"), ["project", "norm_path"]).where("method <> own").select("project", "norm_path", "own").distinct()
        return own.join(there.withColumn("elsewhere", F.lit(True)).hint("merge"), ["project", "norm_path", "own"], "left")

    ops = elsewhere(paired.where("route is null"), "op", methods(routes))
    ways = elsewhere(paired.where("op is null"), "route", methods(operations))
    moved = paired.where((F.col("how") == "identity") & (
        (F.col("op.method") != F.col("route.method")) | (F.col("op.norm_path") != F.col("route.norm_path"))
    ))
    at = F.when(F.col("elsewhere"), "DRIFT003")
    return reduce(DataFrame.union, [
        _found(ops, F.coalesce(at, F.lit("DRIFT001")), F.when(F.col("elsewhere"), "MEDIUM").otherwise(LOST.get(authority, "MEDIUM")), "op"),
        _found(ways, F.coalesce(at, F.lit("DRIFT002")), F.when(F.col("elsewhere"), "MEDIUM").otherwise(EXTRA.get(authority, "MEDIUM")), "route"),
        _found(ways.where(F.col("elsewhere").isNull() & F.col("route.method").isin(*WRITES)), "DRIFT010", "MEDIUM", "route"),
        _found(moved, "DRIFT003", "MEDIUM", "route"),
    ])


def pair_details(paired: DataFrame) -> DataFrame:
    """(project, id, method, path) of pairs that differ.

    Operations also have parameters (array of name, location_in, required), body_names (array),
    has_body_schema, response_names (of 2xx), statuses, secured, deprecated; routes parameters,
    request_schema, response_schema, status_codes, auth (array). DRIFT004 parameters, DRIFT005
    body, DRIFT006 response schema, DRIFT007 statuses, DRIFT008 auth, DRIFT009 a deprecated
    operation that has a route.
    """
    rows = paired.where("op is not null and route is not null")
    o, r = F.col("op"), F.col("route")

    def keys(parameters: Column, flag: bool = False) -> Column:
        parts = [lambda p: p["location_in"], lambda p: p["name"]]
        more = [lambda p: p["required"].cast("string")] if flag else []
        return F.transform(parameters, lambda p: F.concat_ws("|", *(f(p) for f in parts + more)))

    theirs = F.filter(r["parameters"], lambda p: p["location_in"] != "dependency")
    own_vars, their_vars = path_variables(o["path"]), path_variables(r["path"])

    def without(parameters: Column, mine: Column, others: Column) -> Column:
        """Path parameters that the differing variables account for are left out."""
        only = F.array_except(mine, others)
        return F.filter(parameters, lambda p: ~((p["location_in"] == "path") & F.array_contains(only, p["name"])))

    a, b = without(o["parameters"], own_vars, their_vars), without(theirs, their_vars, own_vars)
    one_way = (F.size(F.array_except(keys(a), keys(theirs))) > 0) | (F.size(F.array_except(keys(b), keys(o["parameters"]))) > 0)
    common = F.array_intersect(keys(o["parameters"]), keys(theirs))
    required = F.exists(common, lambda c: F.exists(o["parameters"], lambda p: (F.concat_ws("|", p["location_in"], p["name"]) == c)
                        & ~F.array_contains(keys(theirs, True), F.concat_ws("|", p["location_in"], p["name"], p["required"].cast("string")))))
    variables = F.array_sort(F.array_distinct(own_vars)) != F.array_sort(F.array_distinct(their_vars))

    def last(name: Column) -> Column:
        return F.element_at(F.split(name, r"\."), -1)

    body, answer = last(r["request_schema"]), last(r["response_schema"])
    codes = F.flatten(F.transform(r["status_codes"], lambda s: F.regexp_extract_all(s, F.lit(r"(\d{3})"), F.lit(1))))
    secured, guarded = F.coalesce(o["secured"], F.lit(False)), F.size(F.coalesce(r["auth"], F.array().cast("array<string>"))) > 0
    has_body = F.coalesce(o["has_body_schema"], F.lit(False))
    checks = [
        ("DRIFT004", variables | one_way | required),
        ("DRIFT005", (has_body != body.isNotNull()) | (body.isNotNull() & (F.size(o["body_names"]) > 0) & ~F.array_contains(o["body_names"], body))),
        ("DRIFT006", (F.size(o["response_names"]) > 0) & answer.isNotNull() & ~F.array_contains(o["response_names"], answer)),
        ("DRIFT007", F.size(F.array_except(codes, o["statuses"])) > 0),
        ("DRIFT008", secured != guarded),
        ("DRIFT009", F.coalesce(o["deprecated"], F.lit(False))),
    ]
    ids = F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in checks)))
    return rows.select("project", F.explode(ids).alias("id"), o["method"].alias("method"), o["path"].alias("path"))

"""Declared, observed and configured states of an API side by side, and the life of its versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import drift_path
from spanloom.operators.workspace import state_view
from spanloom.sources.pointers import extensions

#: Span attributes that name a version, the states of a life by their words, and the
#: extensions that tell them.
VERSIONS = ("service.version", "api.version", "app.version", "service_version")
LIVES = {
    "EXPERIMENTAL": ("experimental", "beta", "alpha", "preview"), "ACTIVE": ("active", "ga", "stable"), "DEPRECATED": ("deprecated",),
    "SUNSET": ("sunset",), "RETIRED": ("eol", "retired", "removed"),
}
LIFE_KEYS = ("x-api-status", "x-lifecycle", "x-status")
STATES = ("desired", "declared", "implemented", "observed", "hypothetical")


def observed_operations(executions: DataFrame) -> DataFrame:
    """(subject, form, operation): what was observed, by route or else by operation; form is the path
    without the names of variables."""
    subject = F.coalesce(F.nullif("route", F.lit("")), "operation")
    form = F.when(subject.startswith("/"), drift_path(subject)).otherwise(subject)
    return executions.select(subject.alias("subject"), form.alias("form"), "operation").distinct()


def state_drift(
    operations: DataFrame, versions: DataFrame, hosts: DataFrame, executions: DataFrame, spans: DataFrame, routes: DataFrame,
    budgets: DataFrame, planes: DataFrame,
) -> DataFrame:
    """(kind, subject) of observed or configured things that the contract does not declare.

    runtime: executions (route, operation, downstream_calls) of no declared path or operation id
    (operations: path, operation_id); any execution of a subject that is not declared makes it so.
    version: versions in spans' attributes that are neither a document's (versions: version) nor
    v<n> of a path, if any is declared. dependency: callees that are no declared host (hosts: host, a
    server's url or a name). routing: gateway routes (path) without an operation. slo: objectives whose
    error budget (from aggregate.error_budget) is known and used up. auth: operations whose planes
    (from security.auth_planes) disagree.
    """
    def found(rows: DataFrame, kind: str, subject: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), subject.alias("subject")).distinct()

    paths = operations.select(drift_path(F.col("path")).alias("form")).distinct()
    names = operations.where("operation_id <> ''").select(F.col("operation_id").alias("operation")).distinct()
    strange = observed_operations(executions).join(paths, "form", "left_anti").join(names, "operation", "left_anti")
    in_path = F.regexp_extract("path", r"/v(\d+)(?:/|$)", 1)
    known = versions.where("version <> ''").select("version").union(operations.where(in_path != "").select(F.concat(F.lit("v"), in_path)))
    known = known.distinct()
    attributes = F.array_compact(F.array(*(F.try_element_at("attributes", F.lit(a)) for a in VERSIONS)))
    seen = spans.select(F.explode(attributes).alias("version")).where("version <> ''").distinct()
    some = known.limit(1).select(F.lit(1).alias("one"))
    unknown = seen.join(known, "version", "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(some), "one")  # one row
    declared = hosts.select(F.regexp_replace(F.regexp_replace("host", "^https?://", ""), "/.*$", "").alias("callee")).where("callee <> ''").distinct()
    calls = executions.select(F.explode("downstream_calls.callee").alias("callee")).where("callee <> ''").distinct()
    fronts = routes.select("path", drift_path(F.col("path")).alias("form")).where("form <> '/'")
    return reduce(DataFrame.union, [
        found(strange, "runtime", F.col("subject")), found(unknown, "version", F.col("version")),
        found(calls.join(declared, "callee", "left_anti"), "dependency", F.col("callee")), found(fronts.join(paths, "form", "left_anti"), "routing", F.col("path")),
        found(budgets.where("not insufficient and remaining < 0"), "slo", F.col("name")),
        found(planes.where("drift"), "auth", F.concat_ws(" ", "project", "method", "path")),
    ])


def state_views(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each of STATES: what state_view says of its table (identifier, source, ..), its sources,
    first 64, and `missing` where there is no table or no row."""
    first = next(iter(tables.values()))
    none = first.limit(0)
    views = []
    for state in STATES:
        rows = tables.get(state, none)
        names = rows.select("source").dropna().distinct().orderBy("source").limit(64)
        sources = names.agg(F.array_sort(F.collect_list("source")).alias("sources"), F.lit(state).alias("state"))
        views.append(state_view(rows.drop("source"), state).join(sources, "state"))
    return reduce(DataFrame.unionByName, views).withColumn("missing", ~F.col("present"))


def said(nodes: DataFrame) -> DataFrame:
    """(project, name, value): texts and booleans that extensions of a project give, the first of each
    name, in lower case, by document and pointer."""
    rows = extensions(nodes).where("kind in ('string', 'boolean')")
    text = F.when(F.col("kind") == "string", F.try_variant_get(F.try_parse_json("value"), "$", "string")).otherwise(F.col("value"))
    return rows.groupBy("project", F.lower("name").alias("name")).agg(F.min_by(text, F.struct("doc", "owner")).alias("value"))


def lifecycles(operations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, deprecated, since, sunset, replacement, state): what a contract says of its own life.
    deprecated: an operation is, or an extension says so or since when. state: as an extension names
    it, else SUNSET with a date of that, DEPRECATED, or UNKNOWN."""
    told = said(nodes)

    def of(*names: str) -> Column:
        return F.coalesce(*(F.max(F.when(F.col("name") == n, F.nullif("value", F.lit("")))) for n in names))

    state = F.lit(None).cast("string")
    for name, words in LIVES.items():
        state = F.when(F.lower("value").isin(*words), name).otherwise(state)
    first = F.array_position(F.array(*(F.lit(k) for k in LIFE_KEYS)), F.col("name"))
    known = told.withColumns({"state": F.when(first > 0, state), "first": first})
    by_extension = known.groupBy("project").agg(
        F.coalesce(F.max((F.col("name") == "x-deprecated") & (F.col("value") == "true")), F.lit(False)).alias("marked"),
        of("x-deprecation", "x-deprecation-date").alias("since"), of("x-sunset", "x-sunset-date").alias("sunset"),
        of("x-replacement", "x-replaced-by").alias("replacement"), F.min_by("state", F.when(F.col("state").isNotNull(), F.col("first"))).alias("named"),
    )
    own = operations.groupBy("project").agg(F.bool_or("deprecated").alias("any"))
    rows = own.join(by_extension, "project", "full")
    deprecated = F.coalesce("any", F.lit(False)) | F.coalesce("marked", F.lit(False)) | F.col("since").isNotNull()
    rows = rows.withColumn("deprecated", deprecated)
    life = F.coalesce("named", F.when(F.col("sunset").isNotNull(), "SUNSET"), F.when(F.col("deprecated"), "DEPRECATED"), F.lit("UNKNOWN"))
    return rows.select("project", "deprecated", "since", "sunset", "replacement", life.alias("state"))


def deployed_as(manifests: DataFrame, services: DataFrame) -> DataFrame:
    """(deployment, kind, service): manifests (name, namespace?, kind) of deployments and services whose
    name is that of a service entity 'service:domain:name' (services: id)."""
    wanted = services.select(F.col("id").alias("service"), F.regexp_extract("id", r"^[a-z][a-z0-9_]*:[^:]*:(.+)$", 1).alias("name"))
    wanted = wanted.where("name <> ''").groupBy("name").agg(F.max("service").alias("service"))
    rows = manifests.where("kind in ('Deployment', 'Service')").join(wanted, "name")
    place = F.when(F.coalesce("namespace", F.lit("")) != "", F.concat_ws(".", "namespace", "name")).otherwise(F.col("name"))
    return rows.select(F.concat(F.lit("deployment:k8s:"), place).alias("deployment"), F.lower("kind").alias("kind"), "service").distinct()


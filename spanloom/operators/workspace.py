"""Many repositories, gateways and environments: edges between them and what disagrees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.functions.text import path_prefixes, route_path, sanitized_host, version_segment
from spanloom.operators import graph
from spanloom.operators.contracts import fingerprints, suffix_pairs

SHOWN = 64  # identifiers that a state view lists
Check = Callable[[dict[str, DataFrame]], DataFrame]
_checks: dict[str, Check] = {}


def package_key(name: Column) -> Column:
    """Package names are equal whatever their case and separators."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def repo_edges(operations: DataFrame, routes: DataFrame, sites: DataFrame, gateways: DataFrame, packages: DataFrame, imports: DataFrame) -> DataFrame:
    """(kind, from_repo, to_repo, subject) between different repositories.

    operations (repo, method, path), routes (repo, method, path): IMPLEMENTS for equal method and
    path. sites (repo, site_method?, path): CALLS for an operation whose path ends theirs. gateways
    (repo, path): ROUTES to operations at or below a path. packages (repo, name) and imports (repo,
    name): IMPORTS by normalised name. Prefixes are joined by equality.
    """
    def to_edges(rows: DataFrame, kind: str) -> DataFrame:
        return rows.where("from_repo <> to_repo").select(F.lit(kind).alias("kind"), "from_repo", "to_repo", "subject").distinct()

    subject = F.concat_ws(" ", F.upper("method"), "path")
    ops = operations.select(
        F.col("repo").alias("to_repo"), F.upper("method").alias("m"), route_path(F.col("path")).alias("p"), "path", subject.alias("subject")
    )
    ways = routes.select(F.col("repo").alias("from_repo"), F.upper("method").alias("m"), route_path(F.col("path")).alias("p"))
    templates = ops.select("to_repo", "m", "subject", F.col("path").alias("template"))
    called = suffix_pairs(templates, sites.select(F.col("repo").alias("from_repo"), "site_method", "path"))
    called = called.where(F.col("site_method").isNull() | (F.upper("site_method") == F.col("m")))
    fronts = gateways.select(F.col("repo").alias("from_repo"), route_path(F.col("path")).alias("prefix")).distinct()
    below = ops.select("to_repo", "subject", F.explode(F.array_distinct(path_prefixes(F.col("p")))).alias("prefix"))
    own = packages.select(F.col("repo").alias("to_repo"), package_key(F.col("name")).alias("subject")).distinct()
    used = imports.select(F.col("repo").alias("from_repo"), package_key(F.col("name")).alias("subject")).distinct()
    return reduce(DataFrame.union, [
        to_edges(ways.join(ops, ["m", "p"]), "IMPLEMENTS"), to_edges(called, "CALLS"),
        to_edges(fronts.join(below, "prefix"), "ROUTES"), to_edges(used.join(own, "subject"), "IMPORTS"),
    ])


def repo_blast(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """changed (repo, subject): (repo, subject, dependent, hops): repositories with an edge to the
    changed subject, then all that depend on them; a change that none depends on has one row
    without a dependent. All dependents of a change spread as one, so a row is found once and not by way of
    each direct dependent."""
    asked = settled(changed.select("repo", "subject").distinct().withColumn("start", F.monotonically_increasing_id()), "asked")
    ends = edges.select(F.col("to_repo").alias("repo"), "subject", F.col("from_repo").alias("node")).distinct()
    ends = settled(ends, "ends")
    pairs = settled(ends.where("repo <> node").select(F.col("repo").alias("source"), F.col("node").alias("target")).distinct(), "pairs")
    found = graph.spread(pairs, asked.join(ends, ["repo", "subject"]).select("start", "node"))
    found = found.toDF("of", "dependent", "hops")
    return asked.join(found, (F.col("start") == F.col("of")) & (F.col("dependent") != F.col("repo")), "left").select("repo", "subject", "dependent", "hops")


def twin_drift(declared: DataFrame, implemented: DataFrame, observed: DataFrame, gateway: DataFrame) -> DataFrame:
    """(kind, subject) of states that disagree: all tables are (subject)."""
    def missing(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        return a.select("subject").distinct().join(b.select("subject"), "subject", "left_anti").select(F.lit(kind).alias("kind"), "subject")

    return reduce(DataFrame.union, [
        missing(declared, implemented, "declared_not_implemented"), missing(implemented, declared, "implemented_not_declared"),
        missing(observed, declared, "observed_not_declared"), missing(gateway, declared, "routed_not_declared"),
    ])


def state_view(rows: DataFrame, state: str) -> DataFrame:
    """One row (state, present, records, fingerprint, identifiers): the first SHOWN identifiers of rows
    (identifier, ..) in order, and a hash of all that their order does not change."""
    prints = fingerprints(rows.withColumn("__all", F.lit(state)), "__all")
    first = rows.select("identifier").distinct().orderBy("identifier").limit(SHOWN)
    names = first.agg(F.array_sort(F.collect_list("identifier")).alias("identifiers"), F.lit(state).alias("state"))
    counts = rows.agg(F.count("*").alias("records"), F.lit(state).alias("state"))
    found = counts.join(names, "state").join(prints.select(F.col("contract").alias("state"), "fingerprint"), "state", "left")
    return found.select("state", (F.col("records") > 0).alias("present"), "records", "fingerprint", "identifiers")


def upstreams(routes: DataFrame, services: DataFrame) -> DataFrame:
    """Gateway routes (path, upstream?) with the declared service (service, host) of their upstream's
    host; a route without one has a null service and is `unresolved`."""
    known = services.groupBy(sanitized_host(F.col("host")).alias("__host")).agg(F.min("service").alias("service"))
    rows = routes.withColumn("__host", sanitized_host(F.col("upstream"))).join(known, "__host", "left").drop("__host")
    return rows.withColumn("unresolved", F.col("service").isNull())


def deployment_chain(ingresses: DataFrame, services: DataFrame, deployments: DataFrame) -> DataFrame:
    """(ingress, service, deployment): ingresses (name, namespace, backends array) to services (name,
    namespace, selectors array) to deployments (name, namespace, labels array) that share a selector;
    null where the chain ends."""
    backs = ingresses.select("namespace", F.col("name").alias("ingress"), F.explode_outer("backends").alias("service"))
    known = services.select("namespace", F.col("name").alias("service"), F.lit(True).alias("there"), F.explode_outer("selectors").alias("selector"))
    labelled = deployments.select("namespace", F.col("name").alias("deployment"), F.explode("labels").alias("selector"))
    chain = backs.join(known, ["namespace", "service"], "left").join(labelled, ["namespace", "selector"], "left")
    ends = chain.groupBy("namespace", "ingress", "service").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("there"), F.collect_set("deployment").alias("deployments"))
    return ends.select("namespace", "ingress", F.when(F.col("there"), F.col("service")).alias("service"), F.explode_outer("deployments").alias("deployment"))


def error_conformance(required: DataFrame, observed: DataFrame) -> DataFrame:
    """required (contract: types, fields arrays), one row; observed (operation, types, fields): VIOLATION
    with what is missing, CONFORMS, or UNKNOWN for operations without evidence."""
    want = required.select(F.col("types").alias("t"), F.col("fields").alias("f"))
    rows = observed.join(F.broadcast(want))  # one row
    types, fields = F.array_except("t", "types"), F.array_except("f", "fields")
    verdict = F.when(F.col("types").isNull() | F.col("fields").isNull(), "UNKNOWN").when((F.size(types) > 0) | (F.size(fields) > 0), "VIOLATION").otherwise("CONFORMS")
    return rows.select("operation", verdict.alias("verdict"), F.array_join(types, ",").alias("missing_types"), F.array_join(fields, ",").alias("missing_fields"))


def version_signals(operations: DataFrame) -> DataFrame:
    """(operation, mechanism, version) of operations (operation, path, header_names array, media_types
    array): v<n> in the path, a version header, v<n> in a vendor media type."""
    header = F.filter("header_names", lambda h: h.rlike(r"(?i)^(x-)?(api-)?version$"))
    media = F.filter(F.transform("media_types", lambda m: F.regexp_extract(m, r"application/vnd\..*?[.+-](v\d+)", 1)), lambda v: v != "")
    path = version_segment(F.col("path"))

    def signals(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("mechanism"), v.alias("version")))

    every = F.concat(signals("URI", F.array_compact(F.array(path))), signals("HEADER", header), signals("MEDIA_TYPE", F.array_distinct(media)))
    return operations.select("operation", F.inline(every))


def register_baseline(rows: DataFrame, contract: str, path: str, label: str) -> DataFrame:
    """Appends (contract, fingerprint, elements, label, recorded) of each contract to the register."""
    found = fingerprints(rows, contract).withColumns({"label": F.lit(label), "recorded": F.current_timestamp()})
    found.write.mode("append").parquet(path)
    return found


def registered(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, contract, elements, labels): the register by fingerprint."""
    return spark.read.parquet(path).groupBy("fingerprint", "contract").agg(F.max("elements").alias("elements"), F.array_sort(F.collect_set("label")).alias("labels"))


def check(name: str, checks: dict[str, Check] | None = None) -> Callable[[Check], Check]:
    """Registers a custom check, in `checks` or for the whole process: a function of named tables that
    gives findings (id, severity, subject)."""
    def add(function: Check) -> Check:
        (_checks if checks is None else checks)[name] = function
        return function

    return add


def run_checks(tables: dict[str, DataFrame], findings: DataFrame, checks: dict[str, Check] | None = None) -> DataFrame:
    """findings with those of `checks`, or of all that the process has registered, by the name of the
    check (null: built in)."""
    columns = ["id", "severity", "subject"]
    every = findings.select(*columns, F.lit(None).cast("string").alias("check"))
    for name, function in sorted((_checks if checks is None else checks).items()):
        every = every.unionByName(function(tables).select(*columns, F.lit(name).alias("check")))
    return every

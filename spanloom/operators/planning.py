"""Scenarios, remediation, policies, capabilities and the declared graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import route_path

#: Fix classes from mild to strict, and the checks that are not for manual work only.
CLASSES = ("SAFE", "REVIEW_REQUIRED", "MANUAL_ONLY")
FIXES = {
    "SAFE": ("OAS001", "OAS002", "OAS003", "OAS004", "OAS005", "OAS006", "OAS007", "OAS009", "OAS014", "OAS015", "OAS018", "OAS020"),
    "REVIEW_REQUIRED": ("RELAPI001", "RELAPI002", "RELAPI003", "RELAPI004", "APIPERF004", "APIPERF005", "APIPERF008"),
}
METRICS = ("p50", "p90", "p95", "p99")


def holds(value: Column, op: Column, bound: Column) -> Column:
    """value op bound for <, <=, > and >=; null without a value."""
    return F.when(op == "<", value < bound).when(op == "<=", value <= bound).when(op == ">", value > bound).when(op == ">=", value >= bound)


def scenarios(experiments: DataFrame, baselines: DataFrame) -> DataFrame:
    """(name, verdict, violated) of experiments (name, route, adjustments and rates map<string,double>,
    payload_bytes?, constraints array<struct<metric,op,value>>, hypothesis? struct of the same) over
    baselines (route, p50, p90, p95, p99): percentiles and rates times their factors.

    INCONCLUSIVE without a baseline, CONSTRAINT_VIOLATED if a constraint fails, NOT_SUPPORTED if the
    hypothesis does, INCONCLUSIVE if either cannot be decided or nothing is asked, else SUPPORTED.
    """
    rows = experiments.join(baselines.withColumn("known", F.lit(True)), "route", "left")
    none = F.create_map().cast("map<string,double>")
    percentiles = F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(m).cast("double"))))
    payload = F.when(F.col("payload_bytes").isNotNull(), F.create_map(F.lit("payload_bytes"), F.col("payload_bytes").cast("double")))
    rates = F.map_filter(F.coalesce("rates", none), lambda k, _: ~k.isin(*METRICS, "payload_bytes"))
    factor = F.coalesce("adjustments", none)
    base = F.transform_values(F.map_concat(percentiles, rates), lambda k, v: v * F.coalesce(F.try_element_at(factor, k), F.lit(1.0)))
    rows = rows.withColumn("projected", F.map_concat(base, F.coalesce(payload, none)))

    def held(c: Column) -> Column:
        return holds(F.try_element_at("projected", c["metric"]), c["op"], c["value"])

    asked = F.coalesce("constraints", F.array().cast("array<struct<metric:string,op:string,value:double>>"))
    violated = F.transform(F.filter(asked, lambda c: ~F.coalesce(held(c), F.lit(True))), lambda c: c["metric"])
    believed = F.col("hypothesis")
    open_ended = F.exists(asked, lambda c: held(c).isNull()) | (believed.isNotNull() & held(believed).isNull())
    verdict = (
        F.when(F.col("known").isNull(), "INCONCLUSIVE").when(F.size(violated) > 0, "CONSTRAINT_VIOLATED")
        .when(believed.isNotNull() & ~held(believed), "NOT_SUPPORTED").when(F.coalesce(open_ended, F.lit(False)), "INCONCLUSIVE")
        .when((F.size(asked) == 0) & believed.isNull(), "INCONCLUSIVE").otherwise("SUPPORTED")
    )
    return rows.select("name", verdict.alias("verdict"), F.when(F.col("known"), violated).alias("violated"))


def fix_classes(findings: DataFrame) -> DataFrame:
    """(subject, class, findings): the strictest fix class of each subject's findings (subject, id)."""
    rank = F.lit(3)
    for i, name in enumerate(CLASSES[:2]):
        rank = F.when(F.col("id").isin(*FIXES[name]), i + 1).otherwise(rank)
    sums = findings.groupBy("subject").agg(F.max(rank).alias("rank"), F.count("*").alias("findings"))
    return sums.select("subject", F.element_at(F.array(*(F.lit(c) for c in CLASSES)), F.col("rank")).alias("class"), "findings")


def policy_violations(operations: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy, subject): operations (subject, path, has_security, operation_id, owner) that miss what a
    policy (policy, requires: auth, operation_id or owner; applies_to array of path beginnings with
    an optional * at the end, all if empty) asks for. Beginnings are joined by equality: a path
    gives one key for each length that a policy has."""
    every = F.when(F.size(F.coalesce("applies_to", F.array().cast("array<string>"))) == 0, F.array(F.lit("*"))).otherwise(F.col("applies_to"))
    begins = policies.select("policy", "requires", F.explode(every).alias("begin"))
    begins = begins.select("policy", "requires", F.regexp_replace("begin", r"\*+$", "").alias("begin")).distinct()
    lengths = begins.agg(F.array_sort(F.collect_set(F.length("begin")))).scalar()
    keyed = operations.withColumn("lengths", lengths).select("*", F.explode("lengths").alias("size")).where(F.length("path") >= F.col("size"))
    met = keyed.withColumn("begin", F.expr("substring(path, 1, size)")).join(begins, "begin")
    missing = (
        F.when(F.col("requires") == "auth", ~F.coalesce("has_security", F.lit(False)))
        .when(F.col("requires") == "operation_id", F.coalesce("operation_id", F.lit("")) == "")
        .when(F.col("requires") == "owner", F.col("owner").isNull())
    )
    return met.where(missing).select("policy", "subject").distinct()


def capabilities(evidence: DataFrame) -> DataFrame:
    """(capability, evidence, sources) of evidence rows (capability, source)."""
    return evidence.groupBy("capability").agg(F.count("*").alias("evidence"), F.count_distinct("source").alias("sources"))


def capability_gaps(detected: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, trigger, requires): rules whose trigger is detected while what it requires is not."""
    there = detected.select("capability")
    found = rules.join(there.withColumnRenamed("capability", "trigger"), "trigger", "left_semi")
    return found.join(there.withColumnRenamed("capability", "requires"), "requires", "left_anti").select("rule", "trigger", "requires")


def declared_graph(routes: DataFrame, sites: DataFrame, contents: DataFrame, schemas: DataFrame) -> DataFrame:
    """(source, kind, target, places, first): services EXPOSE endpoints and handlers IMPLEMENT them
    (service, handler, method, path, place), clients CONSUME them (client, method, path, place), APIs
    EXPOSE operations that ACCEPT or RETURN the declared schemas (project, doc, operation, side, name,
    place; schemas: project, doc, name). An edge counts the places that
    show it and names the first."""
    endpoint = F.concat(F.lit("endpoint:"), F.upper("method"), F.lit(" "), route_path(F.col("path")))

    def edge(rows: DataFrame, source: Column, kind: Column | str, target: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select(source.alias("source"), kind.alias("kind"), target.alias("target"), "place")

    def node(kind: str, *parts: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.concat_ws("#", *parts))

    known = contents.join(schemas, ["project", "doc", "name"], "left_semi")
    side = F.when(F.col("side") == "REQUEST", "ACCEPTS").otherwise("RETURNS")
    every = reduce(DataFrame.union, [
        edge(routes, node("service", "service"), "EXPOSES", endpoint), edge(routes, node("operation", "handler"), "IMPLEMENTS", endpoint),
        edge(sites, node("client", "client"), "CONSUMES", endpoint), edge(contents, node("api", "project", "doc"), "EXPOSES", node("operation", "operation")),
        edge(known, node("operation", "operation"), side, node("schema", "project", "doc", "name")),
    ])
    each = every.groupBy("source", "kind", "target", "place").agg(F.count("*").alias("n"))
    return each.groupBy("source", "kind", "target").agg(F.count("*").alias("places"), F.min("place").alias("first"))


def flat_edges(edges: DataFrame, evidence: DataFrame, most: int = 10) -> DataFrame:
    """(line, more): edges (source, kind, target) as text with the first `most` ids 'kind:place' of their
    evidence (source, kind, target, evidence_kind, place) in order, and the number left out."""
    key = ["source", "kind", "target"]
    ids = evidence.select(*key, F.concat_ws(":", "evidence_kind", "place").alias("id")).distinct()
    counts = ids.groupBy(*key).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*key).orderBy("id"))
    first = ids.withColumn("at", place).where(F.col("at") <= most).groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = edges.select(*key).distinct().join(first, key, "left").join(counts, key, "left")
    line = F.concat_ws("|", *key, F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","))
    return rows.select(line.alias("line"), F.greatest(F.lit(0).cast("long"), F.coalesce("n", F.lit(0)) - most).alias("more"))


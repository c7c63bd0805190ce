"""Change events, their reach, and what they mean for clients and migrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import iso_date, leaf, segments
from spanloom.operators.contracts import BREAKING, HARMLESS, POTENTIAL, suffix_pairs

#: Event types of contract changes, response changes that a client's fields can meet,
#: migration classes by classification and their ranks.
TYPES = {
    "endpoint_added": "ENDPOINT_ADDED", "endpoint_removed": "ENDPOINT_REMOVED", "method_removed": "METHOD_CHANGED",
    "auth_tightened": "AUTH_CHANGED", "auth_loosened": "AUTH_CHANGED",
}
FIELD_KINDS = ("response_field_removed", "type_changed_response", "enum_removed")
MIGRATION = {HARMLESS: "DIRECT", POTENTIAL: "APPROXIMATE", BREAKING: "REDESIGN_REQUIRED", "UNKNOWN": "UNKNOWN"}
RANKS = ("DIRECT", "APPROXIMATE", "UNKNOWN", "REDESIGN_REQUIRED", "NO_EQUIVALENT")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def contract_events(changes: DataFrame) -> DataFrame:
    """(type, kind, classification, subject) of contract changes."""
    kind = F.coalesce(_lookup(TYPES, F.col("kind")), F.lit("SCHEMA_CHANGED"))
    return changes.select(kind.alias("type"), "kind", "classification", "subject")


def setting_events(old: DataFrame, new: DataFrame, name: str, more_is_worse: bool, removed: str = POTENTIAL) -> DataFrame:
    """(type, kind, classification, subject) of a setting with one number: old and new (scope, value?,
    rest?) by scope. A smaller number (or a larger one, if more_is_worse) may break; what cannot be
    compared, or differs in the rest only, is UNKNOWN. Of equal scopes the least row counts."""
    def of(rows: DataFrame, flag: str) -> DataFrame:
        return rows.groupBy("scope").agg(F.min(F.struct("value", "rest")).alias(flag))

    both = of(old, "was").join(of(new, "now"), "scope", "full")
    worse = F.col("now.value") > F.col("was.value") if more_is_worse else F.col("now.value") < F.col("was.value")
    differ = ~F.col("was.value").eqNullSafe(F.col("now.value"))
    kind = (
        F.when(F.col("was").isNull(), f"{name}_added").when(F.col("now").isNull(), f"{name}_removed")
        .when(differ | ~F.col("was.rest").eqNullSafe(F.col("now.rest")), f"{name}_changed")
    )
    classification = (
        F.when(F.col("was").isNull(), POTENTIAL).when(F.col("now").isNull(), removed)
        .when(~differ | F.col("was.value").isNull() | F.col("now.value").isNull(), "UNKNOWN")
        .when(worse, POTENTIAL).otherwise(HARMLESS)
    )
    found = both.withColumns({"kind": kind, "classification": classification}).where("kind is not null")
    return found.select(F.lit(f"{name.upper()}_CHANGED").alias("type"), "kind", "classification", F.col("scope").alias("subject"))


def set_events(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Events of named things that come (harmless) and go, or whose `settings` differ (UNKNOWN):
    old and new (subject, settings?)."""
    def of(rows: DataFrame, flag: str) -> DataFrame:
        return rows.groupBy("subject").agg(F.min("settings").alias(flag), F.lit(True).alias(f"has_{flag}"))

    both = of(old, "was").join(of(new, "now"), "subject", "full")
    kind = (
        F.when(F.col("has_was").isNull(), f"{name}_added").when(F.col("has_now").isNull(), f"{name}_removed")
        .when(~F.col("was").eqNullSafe(F.col("now")), f"{name}_changed")
    )
    classification = F.when(F.col("has_was").isNull(), HARMLESS).when(F.col("has_now").isNull(), POTENTIAL).otherwise("UNKNOWN")
    found = both.withColumns({"kind": kind, "classification": classification}).where("kind is not null")
    return found.select(F.lit(f"{name.upper()}_CHANGED").alias("type"), "kind", "classification", "subject")


def client_findings(changes: DataFrame, operations: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(id, client, subject, kind, site): client impact of contract changes.

    changes: (kind, classification, side, subject, path). operations of the old contract: (subject,
    method, template). call_sites: (site, client, site_method?, path?, fields array). CLIENT001 if
    a breaking change of the response meets a field that the site reads, else CLIENT002; sites
    without a path are CLIENT003, once each.
    """
    risky = changes.where(F.col("classification") != HARMLESS).select(
        "kind", "classification", "side", "subject", leaf(F.col("path")).alias("field")
    ).distinct()
    placed = operations.join(risky.select("subject").distinct(), "subject", "left_semi")
    reached = suffix_pairs(placed, call_sites.where("path is not null"))
    same = F.col("method").isNull() | F.col("site_method").isNull() | (F.col("method") == F.col("site_method"))
    hits = reached.where(same).select("subject", "site", "client", "fields").join(risky, "subject")
    sure = (F.col("classification") == BREAKING) & (F.col("side") == "RESPONSE") & F.col("kind").isin(*FIELD_KINDS)
    check = F.when(sure & F.coalesce(F.array_contains("fields", F.col("field")), F.lit(False)), "CLIENT001").otherwise("CLIENT002")
    known = hits.select(check.alias("id"), "client", "subject", "kind", "site")
    null = F.lit(None).cast("string")
    lost = call_sites.where("path is null").select(F.lit("CLIENT003").alias("id"), "client", null.alias("subject"), null.alias("kind"), "site")
    return known.union(lost)


def blast_radius(changes: DataFrame, operations: DataFrame, call_sites: DataFrame, flows: DataFrame) -> DataFrame:
    """(subject, known, clients, sites, flows) per subject of a change that is not harmless: all
    clients, each once, and the number of their sites.

    operations also have `declared`, an array of flow names; flows: (name). A flow is reached if
    the operation declares it or its path has a segment of that name. A subject that the old
    contract lacks is not `known` and reaches nothing.
    """
    subjects = changes.where(F.col("classification") != HARMLESS).select("subject").distinct()
    own = operations.groupBy("subject").agg(F.min(F.struct("method", "template", "declared")).alias("o")).select("subject", "o.*")
    placed = subjects.join(own, "subject").select("subject", "method", "template", "declared")
    reached = suffix_pairs(placed.drop("declared"), call_sites.where("path is not null"))
    same = F.col("method").isNull() | F.col("site_method").isNull() | (F.col("method") == F.col("site_method"))
    reached = reached.where(same)
    clients = reached.groupBy("subject").agg(F.array_sort(F.collect_set("client")).alias("clients"))
    met = reached.select("subject", "site").distinct().groupBy("subject").agg(F.count("*").alias("sites")).join(clients, "subject", "left")
    none = F.array().cast("array<string>")
    names = placed.select("subject", F.explode(F.array_distinct(F.concat(F.coalesce("declared", none), segments(F.col("template"))))).alias("name"))
    linked = names.join(flows.select("name").distinct(), "name").groupBy("subject").agg(F.array_sort(F.collect_set("name")).alias("flows"))
    known = own.select("subject", F.lit(True).alias("known"))
    rows = subjects.join(known, "subject", "left").join(met, "subject", "left").join(linked, "subject", "left")
    return rows.select(
        "subject", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("clients", none).alias("clients"),
        F.coalesce("sites", F.lit(0)).alias("sites"), F.coalesce("flows", none).alias("flows"),
    )


def migrations(changes: DataFrame) -> DataFrame:
    """(subject, class, changes, sdk): the worst migration class of each changed subject, and
    whether generated clients change (null if all its changes are unresolved)."""
    one = F.when(F.col("kind") == "endpoint_removed", "NO_EQUIVALENT").otherwise(_lookup(MIGRATION, F.col("classification")))
    rank = F.array_position(F.array(*(F.lit(r) for r in RANKS)), one)
    sdk = F.when(F.col("kind") != "unresolvable", True)
    sums = changes.groupBy("subject").agg(F.max(rank).alias("rank"), F.count("*").alias("changes"), F.bool_or(sdk).alias("sdk"))
    worst = F.element_at(F.array(*(F.lit(r) for r in RANKS)), F.col("rank").cast("int"))
    return sums.select("subject", worst.alias("class"), "changes", "sdk")


def readiness(deprecated: DataFrame, sites: DataFrame, traffic: DataFrame, today: str) -> DataFrame:
    """deprecated (api, template, since, sunset?, replacement?) with the clients that still call it,
    its requests, its age in days, the days to its sunset, its replacement, and `ready`: nobody
    calls it, or null without a known date."""
    for name in ("sunset", "replacement"):
        if name not in deprecated.columns:
            deprecated = deprecated.withColumn(name, F.lit(None).cast("string"))
    reached = suffix_pairs(deprecated.select("api", "template"), sites.where("path is not null"))
    clients = reached.groupBy("api").agg(F.count_distinct("client").alias("clients"))
    seen = suffix_pairs(deprecated.select("api", "template"), traffic.select(F.col("route").alias("path"), "requests")).groupBy("api").agg(F.sum("requests").alias("requests"))
    rows = deprecated.join(clients, "api", "left").join(seen, "api", "left").na.fill(0, ["clients", "requests"])
    day = F.lit(today).cast("date")
    age, rest = F.datediff(day, iso_date(F.substring("since", 1, 10))), F.datediff(iso_date(F.substring("sunset", 1, 10)), day)
    return rows.select("api", "clients", "requests", age.alias("age_days"), rest.alias("sunset_in_days"), "replacement", F.when(age.isNotNull(), (F.col("clients") == 0) & (F.col("requests") == 0)).alias("ready"))


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, tables)

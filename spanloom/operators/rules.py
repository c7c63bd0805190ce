"""Reliability verdicts, policies, ownership and contract rules as set-based queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled

#: Where an owner may be declared, strongest first.
OWNER_SOURCES = ("extension", "catalog", "codeowners", "service-config")


def idempotency(sources: DataFrame) -> DataFrame:
    """sources (subject, supports?): one denial makes a subject NON_IDEMPOTENT, no assertion
    UNKNOWN."""
    verdict = F.bool_and("supports")
    return sources.groupBy("subject").agg(
        F.when(verdict.isNull(), "UNKNOWN").when(verdict, "IDEMPOTENT").otherwise("NON_IDEMPOTENT").alias("verdict")
    )


def retry_amplification(hops: DataFrame, policies: DataFrame) -> DataFrame:
    """hops (chain, position, hop), policies (scope, max_attempts, statuses): per chain the
    product of declared attempts, null if a hop declares none, and the statuses that all
    retry."""
    bound = hops.join(policies, hops["hop"] == policies["scope"], "left")
    attempts = F.collect_list(F.coalesce("max_attempts", F.lit(1)))
    sums = bound.groupBy("chain").agg(
        F.count_if(F.col("scope").isNull()).alias("undeclared"),
        F.aggregate(attempts, F.lit(1).cast("long"), lambda a, x: a * x).alias("product"),
        F.collect_list(F.when(F.size("statuses") > 0, F.col("statuses"))).alias("sets"),
        F.count("scope").alias("declared"),
    )
    common = F.aggregate(
        F.slice("sets", 2, F.greatest(F.lit(1), F.size("sets"))), F.try_element_at("sets", F.lit(1)), F.array_intersect
    )
    known = (F.size("sets") > 0) & (F.size("sets") == F.col("declared"))
    return sums.select(
        "chain",
        F.when((F.col("undeclared") == 0), F.col("product")).alias("attempts"),
        F.when(known, F.array_sort(common)).otherwise(F.array().cast("array<int>")).alias("overlap"),
    )


def timeout_budget(edges: DataFrame) -> DataFrame:
    """edges (caller, caller_ms?, downstream, ms?): what downstream calls may need one after the
    other and at once, against the caller's own limit."""
    sums = edges.groupBy("caller").agg(
        F.max("caller_ms").alias("limit"), F.sum("ms").alias("sequential"), F.max("ms").alias("parallel"),
        F.count_if(F.col("ms").isNull()).alias("open"),
    )
    verdict = (
        F.when(F.col("limit").isNull() | F.col("parallel").isNull(), "UNKNOWN")
        .when(F.col("parallel") > F.col("limit"), "IMPOSSIBLE")
        .when((F.col("sequential") > F.col("limit")) | (F.col("open") > 0), "AT_RISK")
        .otherwise("FEASIBLE")
    )
    return sums.select("caller", "sequential", "parallel", verdict.alias("verdict"))


def owner(hits: DataFrame) -> DataFrame:
    """hits (subject, source, owner): the owner that the strongest source names."""
    rank = F.array_position(F.array(*(F.lit(s) for s in OWNER_SOURCES)), F.col("source"))
    known = hits.withColumn("rank", rank).where("rank > 0")
    return known.groupBy("subject").agg(F.min_by("owner", F.struct("rank", "owner")).alias("owner"))


def correlations(changes: DataFrame, regressions: DataFrame) -> DataFrame:
    """changes (change, entities), regressions (regression, entities): pairs that share
    entities, with those; sharing is required and says nothing of causes. The result has a row for
    each pair, so an entity of m changes and n regressions gives m times n of them; entities should
    be as narrow as orders or endpoints, not regions."""
    a = changes.select("change", F.explode(F.array_distinct("entities")).alias("entity"))
    b = regressions.select("regression", F.explode(F.array_distinct("entities")).alias("entity"))
    return a.join(b, "entity").groupBy("change", "regression").agg(
        F.array_sort(F.collect_set("entity")).alias("shared")
    )


def valid_exception(expires: Column, approval: Column, today: Column) -> Column:
    day = F.try_to_date(F.substring(expires, 1, 10), "yyyy-MM-dd")
    approved = ~F.lower(F.trim(approval)).isin("", "pending", "denied", "none")
    return F.coalesce((day >= today) & approved, F.lit(False))


def violations(found: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """found (rule, subject) without those that a valid exception (rule, scope, expires,
    approval) covers: '*', a prefix and '*', or the subject itself. Each is a join by equality: a
    subject meets prefixes in the lengths that its rule's exceptions have."""
    valid = exceptions.where(valid_exception(F.col("expires"), F.col("approval"), F.lit(today).cast("date"))).select("rule", "scope").distinct()
    starred = F.col("scope").endswith("*")
    prefixes = valid.where(starred).select("rule", F.regexp_replace("scope", r"\*$", "").alias("prefix")).distinct()
    open_rules = prefixes.where("prefix = ''").select("rule")
    named = valid.where(~starred).select("rule", F.col("scope").alias("subject"))
    some = prefixes.where("prefix <> ''")
    sizes = some.groupBy("rule").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("sizes"))  # lengths of a rule's scopes
    left = found.join(open_rules, "rule", "left_anti").join(named, ["rule", "subject"], "left_anti")
    subjects = left.select("rule", "subject").distinct().join(sizes, "rule").select("rule", "subject", F.explode("sizes").alias("size"))
    begun = subjects.where(F.length("subject") >= F.col("size")).withColumn("prefix", F.expr("substring(subject, 1, size)"))
    covered = begun.join(some, ["rule", "prefix"], "left_semi").select("rule", "subject").distinct()
    return left.join(covered, ["rule", "subject"], "left_anti").select(*found.columns)


def exception_validity(expires: Column, approval: Column, today: Column) -> Column:
    """Why an exception does not hold: not_a_date, expired or not_approved; null if it does."""
    day = F.try_to_date(F.substring(expires, 1, 10), "yyyy-MM-dd")
    approved = ~F.lower(F.trim(F.coalesce(approval, F.lit("")))).isin("", "pending", "denied", "none")
    return F.when(day.isNull(), "not_a_date").when(day < today, "expired").when(~approved, "not_approved")


def policy_issues(exceptions: DataFrame, effective: DataFrame, unreadable: DataFrame, today: str) -> DataFrame:
    """(id, subject, detail): POLICY008 exceptions (rule, scope, expires, approval) that do not hold, 009
    rules of effective_policies that a narrower level tried to weaken, 010 policy files (file, issue)
    that could not be used."""
    why = exception_validity(F.col("expires"), F.col("approval"), F.lit(today).cast("date"))
    invalid = exceptions.withColumn("why", why).where("why is not null")
    return (
        invalid.select(F.lit("POLICY008").alias("id"), F.concat_ws(" ", "rule", "scope").alias("subject"), F.col("why").alias("detail"))
        .union(effective.where("issue").select(F.lit("POLICY009"), F.col("rule").cast("string"), F.lit("widened")))
        .union(unreadable.select(F.lit("POLICY010"), "file", "issue"))
    )


GATES = ("breaking", "security", "policy")


def gate(findings: DataFrame, changes: DataFrame | None, fail_on: tuple[str, ...] = GATES) -> DataFrame:
    """(category, n) of what blocks, of the categories asked for: breaking changes, APISEC findings of
    HIGH confidence and POLICY findings of any but UNKNOWN. To ask for breaking changes without
    a comparison (None) is an error."""
    if "breaking" in fail_on and changes is None:
        raise ValueError("breaking changes need a comparison with a baseline")
    category = (
        F.when(F.col("id").startswith("APISEC") & (F.col("confidence") == "HIGH"), "security")
        .when(F.col("id").startswith("POLICY") & (F.col("confidence") != "UNKNOWN"), "policy")
    )
    every = findings.select(category.alias("category")).where("category is not null")
    if changes is not None:
        every = every.union(changes.where("classification = 'BREAKING'").select(F.lit("breaking").alias("category")))
    return every.where(F.col("category").isin(*fail_on)).groupBy("category").agg(F.count("*").alias("n"))


def doubled_operation_ids(operations: DataFrame) -> DataFrame:
    """OAS003: operation ids that a document uses more than once."""
    named = operations.where("operation_id is not null")
    return named.groupBy("project", "operation_id").agg(F.count("*").alias("uses")).where("uses > 1")


def path_parameter_issues(operations: DataFrame, parameters: DataFrame) -> DataFrame:
    """OAS013: a variable of the path without parameter. OAS012: a path parameter that the path
    lacks or that is not required, or a variable declared elsewhere. operations (op, path),
    parameters (op, name, location_in, required)."""
    variables = operations.select(
        "op", F.explode(F.array_distinct(F.regexp_extract_all("path", F.lit(r"\{([^{}/]+)\}"), F.lit(1)))).alias("name")
    ).withColumn("variable", F.lit(True))
    one = parameters.where("name is not null").groupBy("op", "name").agg(
        F.max("location_in").alias("location_in"), F.bool_and(F.coalesce("required", F.lit(False))).alias("required")
    )
    both = variables.join(one, ["op", "name"], "full")
    in_path = F.col("location_in") == "path"
    check = (
        F.when(F.col("location_in").isNull(), "OAS013")
        .when(in_path & (F.col("variable").isNull() | ~F.col("required")), "OAS012")
        .when(~in_path & F.col("variable").isNotNull(), "OAS012")
    )
    return both.select(check.alias("id"), "op", "name").where("id is not null")


#: Pairs that one task makes, and that one key's chunk of earlier units makes.
PAIRS = 5_000_000


def version_pairs(operations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """operations (keys, unit, path): pairs of units of adjacent versions of one path after /v<n>/,
    of the same keys.

    There are as many pairs as units times units of the next version, so they are dealt by their
    number, not by the bytes of the units: the earlier units of a step lie in chunks of about
    PAIRS pairs, each with all later ones, and a task makes about as many."""
    version = F.regexp_extract("path", r"^/+v(\d+)/", 1)
    rows = operations.select(*keys, "unit", version.alias("v"), F.regexp_extract("path", r"^/+v\d+(/.*)$", 1).alias("tail"))
    rows = rows.where("v <> '' and tail <> '/'").withColumn("v", F.col("v").cast("int"))
    order = W.partitionBy(*keys, "tail").orderBy("v")
    steps = rows.groupBy(*keys, "tail", "v").agg(F.count("*").alias("n"))
    steps = steps.select(*keys, "tail", "v", F.lead("v").over(order).alias("next"), (F.col("n") * F.lead("n").over(order)).alias("pairs"))
    steps = settled(steps.where("next is not null").withColumn("chunks", F.ceil(F.col("pairs") / PAIRS)), "steps")
    earlier = rows.join(steps.hint("merge"), [*keys, "tail", "v"]).withColumn("chunk", F.pmod(F.xxhash64("unit"), "chunks"))
    later = rows.withColumnsRenamed({"v": "next", "unit": "later"}).join(steps.drop("v").hint("merge"), [*keys, "tail", "next"])
    later = later.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    place = [*keys, "tail", "next", "chunk"]
    earlier, later = earlier.select(*place, F.col("unit").alias("earlier")), later.select(*place, "later")
    if (tasks := math.ceil((steps.agg(F.sum("pairs")).first()[0] or 0) / PAIRS)) > 1:
        tasks = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        earlier, later = earlier.repartition(tasks, *place), later.repartition(tasks, *place)
    return earlier.join(later.hint("merge"), place).select(*keys, "earlier", "later", "tail")


#: Changes of settings that matter to an objective of the same name.
SETTINGS = ("TIMEOUT_CHANGED", "RETRY_CHANGED", "RATE_LIMIT_CHANGED")


def pull_request(changes: DataFrame, impact: DataFrame, objectives: DataFrame, extra_unknowns: int = 0) -> DataFrame:
    """Counters of a change. changes (type, classification, subject), impact (client), objectives (name).
    slo_relevant: changed dependencies, and settings of a subject that an objective names."""
    names = objectives.select(F.col("name").alias("subject"), F.lit(True).alias("named")).distinct()
    rows = changes.join(names, "subject", "left")
    relevant = (F.col("type") == "DEPENDENCY_CHANGED") | (F.col("type").isin(*SETTINGS) & F.col("named"))
    one = rows.agg(
        F.count_if(F.col("classification") == "BREAKING").alias("breaking"),
        F.count_if(F.col("type") == "ENDPOINT_ADDED").alias("new_endpoints"),
        F.count_if(F.col("type") == "AUTH_CHANGED").alias("auth_changes"),
        F.count_if(relevant).alias("slo_relevant"),
        (F.count_if(F.col("classification") == "UNKNOWN") + extra_unknowns).alias("unknowns"),
    )
    return one.join(F.broadcast(impact.agg(F.count_distinct("client").alias("clients"))))  # one row each


def effective_policies(policies: DataFrame, excepted: DataFrame) -> DataFrame:
    """policies (rule, level_rank: larger is narrower, strength), excepted (rule): the narrowest
    level of each rule counts, unless it is weaker than the widest and the rule has no
    exception; then the widest counts and `issue` is set."""
    ends = policies.groupBy("rule").agg(
        F.max_by(F.struct("level_rank", "strength"), F.struct("level_rank", "strength")).alias("narrow"),
        F.min_by(F.struct("level_rank", "strength"), F.struct("level_rank", "strength")).alias("wide"),
    )
    marked = ends.join(excepted.select("rule").distinct().withColumn("free", F.lit(True)), "rule", "left")
    issue = (F.col("narrow.strength") < F.col("wide.strength")) & F.col("free").isNull()
    chosen = F.when(issue, F.col("wide")).otherwise(F.col("narrow"))
    return marked.select("rule", chosen["level_rank"].alias("level_rank"), chosen["strength"].alias("strength"), issue.alias("issue"))

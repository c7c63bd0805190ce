"""Declared retries and timeouts against the calls that are there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.rules import timeout_budget

#: Methods whose replay needs evidence.
WRITES = ("POST", "PUT", "PATCH", "DELETE")


def bound_policies(edges: DataFrame, policies: DataFrame) -> DataFrame:
    """edges (caller, callee) with the `policy` (scope, max_attempts) that counts for the caller: the
    one of its scope, else of the edge 'caller->callee', else of the first edge scope that starts
    with the caller; null if there is none. Of equal scopes the one with most attempts counts."""
    one = policies.groupBy("scope").agg(F.max("max_attempts").alias("max_attempts"))
    value = F.struct("scope", "max_attempts").alias("policy")
    exact = one.select(F.col("scope").alias("caller"), F.lit(0).alias("rank"), value)
    side = F.trim(F.split("scope", "->", 2)[0])
    any_edge = one.where(F.col("scope").contains("->")).groupBy(side.alias("caller")).agg(F.min(F.struct("scope", "max_attempts")).alias("policy"))
    by_caller = exact.union(any_edge.select("caller", F.lit(2).alias("rank"), "policy"))
    first = edges.select("caller", "callee").distinct()
    edge = F.concat("caller", F.lit("->"), "callee")
    by_edge = first.join(one.select(F.col("scope").alias("edge"), value), edge == F.col("edge")).select("caller", "callee", F.lit(1).alias("rank"), "policy")
    found = first.join(by_caller, "caller").union(by_edge.select("caller", "callee", "rank", "policy"))
    best = found.groupBy("caller", "callee").agg(F.min_by("policy", "rank").alias("policy"))
    return first.join(best, ["caller", "callee"], "left")


def depth_checks(edges: DataFrame, policies: DataFrame, timeouts: DataFrame) -> DataFrame:
    """(id, caller, callee, bound): APIREL001 both ends of a call retry, with the product of
    their attempts; APIREL002 the caller's timeout is below the callee's, or the callee declares
    none (bound null). timeouts: (scope, ms?); a caller may declare its own for the edge."""
    calls = bound_policies(edges, policies)
    ends = calls.select(F.col("callee").alias("caller"), F.lit("").alias("callee")).distinct()
    own = bound_policies(ends, policies).select(F.col("caller").alias("callee"), F.col("policy").alias("other"))
    both = calls.join(own, "callee").where("policy.max_attempts > 1 and other.max_attempts > 1")
    product = F.col("policy.max_attempts") * F.col("other.max_attempts")
    retried = both.select(F.lit("APIREL001").alias("id"), "caller", "callee", product.cast("double").alias("bound"))
    limits = timeouts.groupBy("scope").agg(F.min("ms").alias("ms"))

    def limit(name: str) -> DataFrame:
        return limits.select(F.col("scope").alias(f"{name}_scope"), F.col("ms").alias(f"{name}_ms"))

    edge = F.concat("caller", F.lit("->"), "callee")
    timed = calls.select("caller", "callee").join(limit("caller"), F.col("caller") == F.col("caller_scope"), "left")
    timed = timed.join(limit("edge"), edge == F.col("edge_scope"), "left").join(limit("callee"), F.col("callee") == F.col("callee_scope"), "left")
    mine = F.when(F.col("caller_scope").isNotNull(), F.col("caller_ms")).otherwise(F.col("edge_ms"))
    declared = F.col("caller_scope").isNotNull() | F.col("edge_scope").isNotNull()
    open_end = declared & F.col("callee_scope").isNull()
    short = mine < F.col("callee_ms")
    slow = timed.where(open_end | F.coalesce(short, F.lit(False))).select(
        F.lit("APIREL002").alias("id"), "caller", "callee", F.when(F.col("callee_scope").isNotNull(), F.col("callee_ms").cast("double")).alias("bound")
    )
    return retried.union(slow)


def reliability_issues(tables: dict[str, DataFrame], operations: DataFrame) -> DataFrame:
    """(id, subject). tables: retries (scope, max_attempts), timeouts (scope, ms, propagated),
    breakers, health, shutdown (one row a declaration), idempotency (subject, verdict).

    RELAPI001 stacked retries of all scopes with their product, exact: from 2**53 on as factors
    (2^40*3^7), RELAPI002 retried scopes that are
    not known to be idempotent, RELAPI003 callers whose declared chain of calls cannot keep their
    timeout (if tables has chains: chain, place, scope), RELAPI004 timeouts without propagation, RELAPI005 to 007 no
    breakers, health checks or shutdown although reliability is configured, RELAPI008 writing
    operations (method, path, identity) without idempotency. Presence is read from one-row
    aggregates, joined on a constant.
    """
    retries, timeouts, verdicts = tables["retries"], tables["timeouts"], tables["idempotency"]
    safe = verdicts.where("verdict = 'IDEMPOTENT'").select("subject").distinct()
    scopes = retries.groupBy(F.col("scope").alias("subject")).agg(F.max("max_attempts").alias("n"))
    factors = scopes.where("n > 1").groupBy("n").agg(F.count("*").alias("times"))
    listed = F.array_sort(F.collect_list(F.struct("n", "times")))  # a factor for each number of attempts
    product = factors.agg(F.sum(F.log2("n") * F.col("times")).alias("bits"), listed.alias("factors")).where("bits > 0")
    exact = F.aggregate(
        F.flatten(F.transform("factors", lambda f: F.array_repeat(f["n"], F.when(F.col("bits") < 53, f["times"]).otherwise(0).cast("int")))),
        F.lit(1).cast("long"), lambda a, n: a * n,
    )
    powers = F.array_join(F.transform("factors", lambda f: F.concat(f["n"].cast("string"), F.lit("^"), f["times"].cast("string"))), "*")
    stacked = product.select(F.lit("RELAPI001").alias("id"), F.when(F.col("bits") < 53, exact.cast("string")).otherwise(powers).alias("subject"))

    def there(table: DataFrame, name: str) -> DataFrame:
        return table.agg((F.count("*") > 0).alias(name), F.lit(1).alias("one"))

    presence = reduce(
        lambda a, b: a.join(b, "one"),
        [there(tables[n], n) for n in ("retries", "timeouts", "breakers", "health", "shutdown")],
    )
    some = F.col("retries") | F.col("timeouts")
    any_of = some | F.col("breakers")
    missing = F.array_compact(F.array(
        F.when(some & ~F.col("breakers"), "RELAPI005"), F.when(any_of & ~F.col("health"), "RELAPI006"), F.when(any_of & ~F.col("shutdown"), "RELAPI007"),
    ))
    absent = presence.select(F.explode(missing).alias("id"), F.lit("(config)").alias("subject"))
    retried = scopes.join(safe, "subject", "left_anti").select(F.lit("RELAPI002").alias("id"), "subject")
    silent = timeouts.groupBy(F.col("scope").alias("subject")).agg(F.bool_or("propagated").alias("sent")).where("not sent")
    writes = operations.where(F.upper("method").isin(*WRITES))
    named = writes.select(F.col("identity").alias("subject"), F.concat_ws(" ", F.upper("method"), "path").alias("at"))
    unsafe = named.join(safe, "subject", "left_anti").join(safe.withColumnRenamed("subject", "at"), "at", "left_anti")
    late = chain_budgets(tables["chains"], timeouts) if "chains" in tables else absent.limit(0)
    return reduce(DataFrame.union, [
        stacked, retried, late, silent.select(F.lit("RELAPI004").alias("id"), "subject"), absent, unsafe.select(F.lit("RELAPI008").alias("id"), "subject"),
    ])


def chain_budgets(chains: DataFrame, timeouts: DataFrame) -> DataFrame:
    """(id, subject): RELAPI003 for chains (chain, place, scope) of a caller, at the first place, and
    what it calls, whose timeouts exceed the caller's, even at once or one after the other."""
    limits = timeouts.groupBy("scope").agg(F.min("ms").alias("ms"))
    met = chains.join(limits, "scope", "left")
    first = met.groupBy("chain").agg(F.min_by(F.struct("scope", "ms"), "place").alias("of"), F.min("place").alias("first"))
    calls = met.join(first, "chain").where("place > first").select(
        F.col("chain").alias("caller"), F.col("of.ms").alias("caller_ms"), F.col("scope").alias("downstream"), F.col("ms").cast("double").alias("ms")
    )
    verdicts = timeout_budget(calls).where("verdict in ('IMPOSSIBLE', 'AT_RISK')")
    return verdicts.select(F.lit("RELAPI003").alias("id"), F.concat_ws(" ", F.col("caller").cast("string"), "verdict").alias("subject"))


def observability_issues(summary: DataFrame, names: DataFrame) -> DataFrame:
    """(id, n) from one row of counters (see assembly.observability) and operation names
    (operation): OBSAPI001 no correlation ids, 002 no propagation, or orphans, 003 more than one
    naming style among more than two names, 004 errors without context, 005 spans without
    duration."""
    name = F.col("operation")
    patterns = ("^[a-z]+[A-Z]", "_", "-")  # camel, snake, kebab
    styles = names.select("operation").distinct().agg(
        F.count("*").alias("names"), sum(F.max(name.rlike(p).cast("long")) for p in patterns).alias("styles")
    )
    many = styles.where("names > 2 and styles > 1").select(F.lit("OBSAPI003").alias("id"), F.col("styles").alias("n"))

    def issue(check: str, when: Column, n: Column) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("id"), n.cast("long").alias("n")))

    c = F.col
    found = F.array_compact(F.array(
        issue("OBSAPI001", (c("tracing") > 0) & (c("correlation_ids") == 0), c("tracing")),
        issue("OBSAPI002", (c("tracing") > 0) & ((c("trace_propagation") == 0) | (c("orphans") > 0)), c("orphans")),
        issue("OBSAPI004", c("errors_without_context") > 0, c("errors_without_context")),
        issue("OBSAPI005", (c("tracing") > 0) & (c("without_duration") > 0), c("without_duration")),
    ))
    return summary.select(F.inline(found)).union(many)

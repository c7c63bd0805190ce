"""Roll-ups over many repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import sanitized_host


def public_apis(operations: DataFrame) -> DataFrame:
    """Repos with operations that declare no security: (repo, open, operations, share 'k/n')."""
    counts = operations.groupBy("repo").agg(
        F.count_if(~F.col("has_security")).alias("open"), F.count("*").alias("operations")
    ).where("open > 0")
    share = F.concat(F.col("open").cast("string"), F.lit("/"), F.col("operations").cast("string"))
    return counts.withColumn("share", share)


def unowned(apis: DataFrame, owners: DataFrame) -> DataFrame:
    """Repos of apis without a row in owners."""
    return apis.select("repo").distinct().join(owners.select("repo"), "repo", "left_anti")


def shared_hosts(external: DataFrame) -> DataFrame:
    """External hosts that more than one repo calls: (host, repos, n)."""
    pairs = external.select(sanitized_host(F.col("host")).alias("host"), "repo").distinct()
    counts = pairs.groupBy("host").agg(
        F.array_sort(F.collect_list("repo")).alias("repos"), F.count("*").alias("n")
    )
    return counts.where("n > 1")


def portfolio(operations: DataFrame, external: DataFrame, owners: DataFrame) -> DataFrame:
    """Per repo: operations, APIs, external hosts, owner."""
    base = operations.groupBy("repo").agg(
        F.count("*").alias("operations"), F.count_distinct("api").alias("apis")
    )
    hosts = external.groupBy("repo").agg(F.count_distinct("host").alias("external"))
    return base.join(hosts, "repo", "left").join(owners.select("repo", "owner"), "repo", "left").select(
        "repo", "operations", "apis", F.coalesce("external", F.lit(0)).alias("external"), "owner"
    )


def health(findings: DataFrame) -> DataFrame:
    """(group, findings, unknowns): findings per group of check ids, and the facts that are unknown
    to them: findings (id, unknowns, a number)."""
    group = (
        F.when(F.col("id").rlike("^(COMPAT|DRIFT)"), "breaking_changes")
        .when(F.col("id").startswith("RELAPI"), "reliability_gaps")
        .when(F.col("id").startswith("APISEC"), "security_candidates")
        .when(F.col("id").rlike("^(APIPERF|OBSAPI)"), "runtime_regressions")
        .otherwise("other")
    )
    return findings.groupBy(group.alias("group")).agg(F.count("*").alias("findings"), F.sum("unknowns").alias("unknowns"))


def quality(operations: DataFrame) -> DataFrame:
    """(repo, dimension, covered, total): operation ids, security and documentation."""
    sums = operations.groupBy("repo").agg(
        F.count("*").alias("total"),
        F.count("operation_id").alias("operation_id"),
        F.count_if("has_security").alias("security"),
        F.count("description").alias("documentation"),
    )
    return sums.unpivot(["repo", "total"], ["operation_id", "security", "documentation"], "dimension", "covered")


def external_gaps(external: DataFrame) -> DataFrame:
    """External APIs with what they lack of timeout, retry and authentication."""
    gaps = F.array_compact(
        F.array(
            F.when(F.col("timeout_ms").isNull(), "no timeout"),
            F.when(~F.coalesce("has_retry", F.lit(False)), "no retry"),
            F.when(~F.coalesce("has_auth", F.lit(False)), "no auth"),
        )
    )
    return external.select("repo", "host", gaps.alias("gaps")).where(F.size("gaps") > 0)


def check_scores(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Precision and recall per family (the check id without digits): expected (scenario, entry
    with an optional * at its end) against observed (scenario, check_id)."""
    def family(name: str):
        return F.regexp_replace(F.regexp_replace(name, r"\*$", ""), r"\d+$", "")

    want = expected.withColumns({"prefix": F.regexp_replace("entry", r"\*$", ""), "glob": F.col("entry").endswith("*")})
    fits = F.when(F.col("glob"), F.col("check_id").startswith(F.col("prefix"))).otherwise(F.col("check_id") == F.col("prefix"))
    pairs = want.join(observed, "scenario").where(fits)
    hit = want.join(pairs.select("scenario", "entry").distinct().withColumn("hit", F.lit(1)), ["scenario", "entry"], "left")
    left = hit.groupBy(family("entry").alias("family")).agg(F.count("*").alias("expected"), F.count("hit").alias("hits"))
    extra = observed.join(pairs.select("scenario", "check_id"), ["scenario", "check_id"], "left_anti")
    false = extra.groupBy(family("check_id").alias("family")).agg(F.count("*").alias("false_positives"))
    both = left.join(false, "family", "full").na.fill(0, ["expected", "hits", "false_positives"])
    return both.withColumns(
        {
            "precision": F.when(F.col("hits") + F.col("false_positives") > 0, F.col("hits") / (F.col("hits") + F.col("false_positives"))),
            "recall": F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")),
        }
    )


def without_security(operations: DataFrame) -> DataFrame:
    return operations.where(~F.col("has_security"))


def deprecated(versions: DataFrame) -> DataFrame:
    """Deprecated versions with the days from today to their sunset (null: no date): versions
    (repo, version, deprecated, sunset text, today date)."""
    day = F.try_to_date(F.substring("sunset", 1, 10), "yyyy-MM-dd")
    return versions.where("deprecated").select(
        "repo", "version", F.datediff(day, F.col("today")).alias("days_left")
    )


def complexity(operations: DataFrame, external: DataFrame, gateways: DataFrame) -> DataFrame:
    """(signal, subject): repos with several styles, hosts that several repos call, routes behind
    two gateways or more, and repos with two kinds of authentication or more."""
    def signal(name: str, rows: DataFrame, subject: str, counted: str) -> DataFrame:
        counts = rows.groupBy(F.col(subject).alias("subject")).agg(F.count_distinct(counted).alias("n"))
        return counts.where("n > 1").select(F.lit(name).alias("signal"), F.col("subject").cast("string").alias("subject"))

    found = signal("multi-protocol", operations, "repo", "style")
    for more in (
        signal("shared-host", external, "host", "repo"),
        signal("several-gateways", gateways, "route", "gateway"),
        signal("mixed-auth", operations, "repo", "auth"),
    ):
        found = found.union(more)
    return found

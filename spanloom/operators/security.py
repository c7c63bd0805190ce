"""Security evidence of operations: who may call, what limits apply, what comes in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import path_prefixes, path_variables, route_path

#: Names of object ids, urls and bounded pages, and administrative paths.
OBJECT_ID = r"^(id|uuid|guid|pk|[a-z0-9_]*_id|[a-z0-9]*Id|[a-z0-9]*Uuid)$"
ADMIN = r"(?i)(^|[/_.-])admin([/_.-]|$)"
URL_NAME = (
    r"(?i)^(url|uri|endpoint|target|callback|webhook|redirect(_uri|_url)?|feed|fetch|image_url|avatar_url|source|dest|destination|link|site)$"
)
LIMITS = ("limit", "per_page", "page_size", "pagesize", "max_results", "maxresults", "top", "count", "size")
OFFSETS = ("offset", "page", "p", "start", "skip")
CURSORS = ("cursor", "after", "before", "next", "continuation")
TOKENS = ("page_token", "pagetoken", "continuation_token", "next_token", "token")


def pagination(operations: DataFrame, parameters: DataFrame) -> DataFrame:
    """(project, method, path, kind, bounded) from the names of an operation's parameters: TOKEN and
    CURSOR pages are bounded, OFFSET pages if a limit can be given; NONE is not known to be."""
    key = ["project", "method", "path"]
    names = parameters.groupBy(*key).agg(F.collect_set(F.lower("name")).alias("names"))
    rows = operations.select(*key).join(names, key, "left")

    def has(wanted: tuple[str, ...]) -> Column:
        return F.coalesce(F.arrays_overlap("names", F.array(*(F.lit(w) for w in wanted))), F.lit(False))

    limit = has(LIMITS)
    kind = F.when(has(TOKENS), "TOKEN").when(has(CURSORS), "CURSOR").when(has(OFFSETS) | limit, "OFFSET").otherwise("NONE")
    bounded = F.when(has(TOKENS) | has(CURSORS), True).when(has(OFFSETS) | limit, limit)
    return rows.select(*key, kind.alias("kind"), bounded.alias("bounded"))


def operation_risks(operations: DataFrame, parameters: DataFrame, grants: DataFrame, limits: DataFrame) -> DataFrame:
    """(project, id, method, path).

    operations: (project, method, path, operation_id, anonymous, sensitive, deprecated, collection).
    parameters: (project, method, path, name, location_in). grants: (project, scope) with scope '*',
    a path, or 'METHOD path': who may call is declared. limits: (project, scope): '*' or a path
    prefix at a segment. APISEC001 an object id in the path without grant, 002 an administrative
    operation without, 003 anonymous and sensitive, 005 anonymous without rate limit, 006 a list
    without bounded pages, 007 a url as input, 009 deprecated and still there. Scopes are joined
    by equality: a path meets all its prefixes.
    """
    key = ["project", "method", "path"]
    bare = route_path(F.col("path"))

    def covered(rows: DataFrame, scopes: DataFrame, names: Column) -> DataFrame:
        each = rows.select(*key, F.explode(F.concat(F.array(F.lit("*")), names)).alias("scope"))
        return each.join(scopes.select("project", "scope").distinct(), ["project", "scope"], "left_semi").select(*key).distinct()

    own = operations.withColumns({"id_names": F.filter(path_variables(F.col("path")), lambda v: v.rlike(OBJECT_ID))})
    admin = F.col("path").rlike(ADMIN) | F.coalesce(F.col("operation_id").rlike(ADMIN), F.lit(False))
    granted = covered(own, grants, F.array_distinct(F.array(F.col("path"), bare, F.concat_ws(" ", "method", "path"))))
    open_ops = own.join(granted, key, "left_anti")
    limited = covered(own, limits, F.array_distinct(F.concat(path_prefixes(F.col("path")), path_prefixes(bare))))
    pages = pagination(own, parameters).where("bounded").select(*key)
    urls = parameters.where(F.col("location_in").isin("query", "header") & F.col("name").rlike(URL_NAME)).select(*key).distinct()

    def found(rows: DataFrame, check: str) -> DataFrame:
        return rows.select("project", F.lit(check).alias("id"), "method", "path")

    return reduce(DataFrame.union, [
        found(open_ops.where(F.size("id_names") > 0), "APISEC001"),
        found(open_ops.where(admin), "APISEC002"),
        found(own.where("anonymous and sensitive"), "APISEC003"),
        found(own.where("anonymous").join(limited, key, "left_anti"), "APISEC005"),
        found(own.where("method = 'GET' and collection").join(pages, key, "left_anti"), "APISEC006"),
        found(own.join(urls, key, "left_semi"), "APISEC007"),
        found(own.where("deprecated"), "APISEC009"),
    ])


def auth_planes(contract: DataFrame, routes: DataFrame, guards: DataFrame) -> DataFrame:
    """(project, method, path, contract, implementation, gateway, drift, chain, enforced_at) of the
    operations with a known plane. Planes are three-valued.

    contract: (project, method, path, requires?). routes: (project, method, path, guarded), matched by
    method and path without the names of variables; an operation of a project with routes that has
    none is not guarded. guards: (project, subject) of a gateway, for operations whose path lies in
    the subject, or the other way round, or all ('*'); likewise. drift: two known planes disagree.
    chain: COMPLETE if what the contract declares is enforced on either plane, BROKEN if there is
    one without the other, else UNKNOWN. enforced_at: the implementation before the gateway, else
    contract-only or none.

    Guards are a configuration table: each operation is held against those of its project, and of
    them only whether one fits is kept.
    """
    key, route = ["project", "method", "path"], ["project", "verb", "form"]
    rows = contract.select(*key, F.col("requires").alias("contract")).withColumns({"verb": F.upper("method"), "form": route_path(F.col("path"))})
    built = routes.groupBy("project", F.upper("method").alias("verb"), route_path(F.col("path")).alias("form")).agg(F.bool_or("guarded").alias("guarded"))
    fits = guards.select("project", F.when(F.col("subject") == "*", "*").otherwise(route_path(F.col("subject"))).alias("subject")).distinct()
    asked = rows.select("project", "form").distinct()
    within = (F.col("subject") == "*") | F.contains(F.col("form"), F.col("subject")) | F.contains(F.col("subject"), F.col("form"))
    held = asked.join(fits.withColumnRenamed("project", "of"), (F.col("project") == F.col("of")) & within, "left_semi").withColumn("held", F.lit(True))
    for table, name in ((routes, "has_routes"), (guards, "has_guards")):
        rows = rows.join(table.select("project").distinct().withColumn(name, F.lit(True)), "project", "left")
    rows = rows.join(built, route, "left").join(held, ["project", "form"], "left")
    rows = rows.withColumns(
        {"implementation": F.coalesce("guarded", F.when(F.col("has_routes"), False)), "gateway": F.coalesce("held", F.when(F.col("has_guards"), False))}
    )
    rows = rows.withColumn("known", F.array_compact(F.array("contract", "implementation", "gateway"))).where(F.size("known") > 0)
    declared, no = F.coalesce("contract", F.lit(False)), F.lit(False)
    enforced = F.coalesce("implementation", no) | F.coalesce("gateway", no)
    chain = F.when(declared & enforced, "COMPLETE").when(declared != enforced, "BROKEN").otherwise("UNKNOWN")
    point = (
        F.when(F.col("implementation"), "implementation").when(F.col("gateway"), "gateway")
        .when(declared, "contract-only").otherwise("none")
    )
    drift = F.size(F.array_distinct("known")) > 1
    return rows.select(*key, "contract", "implementation", "gateway", drift.alias("drift"), chain.alias("chain"), point.alias("enforced_at"))

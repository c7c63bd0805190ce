"""Rules over contract tables (see sources.openapi): findings as (project, doc, id, severity,
subject), each rule a filter, an aggregate or a semi-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.operators import graph
from spanloom.operators.schemas import shape
from spanloom.sources.openapi import Contracts
from spanloom.sources.pointers import pointer_steps

KEY = ("project", "doc")
OPERATION = (*KEY, "method", "path")
#: Keys that tell a schema's type, keys whose values are data, host patterns by environment.
TYPE_KEYS = (
    "type", "$ref", "properties", "items", "enum", "const", "allOf", "anyOf", "oneOf", "not", "format",
    "additionalProperties", "patternProperties", "prefixItems",
)
LOCAL = r"^(localhost|127\.|0\.0\.0\.0|\[?::1\]?)|\.(local|localhost|internal|lan|test|invalid|example)$"
PRIVATE = r"^(10\.\d{1,3}|192\.168|172\.(1[6-9]|2\d|3[01]))\.\d{1,3}$|^\d{1,3}(\.\d{1,3}){3}$"
STAGING = r"(?i)(^|[.\-_])(stg|stage|staging|qa|uat|preprod|preview)([.\-_]|$)"
DEVELOPMENT = r"(?i)(^|[.\-_])dev(elopment|el)?([.\-_]|$)|sandbox"
SUNSET_NAME = r"(?i)^x-(sunset|deprecat)"
SUNSET_HEADER = r"(?i)^(sunset|deprecation)$"
DOMINANT, LEAST_SHAPED = 0.6, 3


def _found(rows: DataFrame, check: str, severity: Column | str, subject: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(*KEY, F.lit(check).alias("id"), severity.alias("severity"), subject.alias("subject"))


def _several(rows: DataFrame, *checks: tuple[Column, str, str, Column]) -> DataFrame:
    """The findings of several checks (condition, id, severity, subject) from one pass over the rows."""
    each = (F.when(condition, F.struct(F.lit(check).alias("id"), F.lit(severity).alias("severity"), subject.alias("subject"))) for condition, check, severity, subject in checks)
    return rows.select(*KEY, F.inline(F.array_compact(F.array(*each))))


def _name() -> Column:
    return F.concat_ws(" ", "method", "path")


def _all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, tables)


def document_issues(c: Contracts) -> DataFrame:
    """OAS001: documents that cannot be used. OAS002: references without target, each once."""
    bad = c.documents.where("status <> 'PARSED'")
    severity = F.when(F.col("status") == "UNSUPPORTED_VERSION", "MEDIUM").otherwise("HIGH")
    lost = c.references.where(F.col("status").isin("MISSING", "INVALID"))
    return _all(_found(bad, "OAS001", severity, F.col("doc")), _found(lost, "OAS002", "HIGH", F.col("ref")))


def operation_issues(c: Contracts) -> DataFrame:
    """OAS004 no operation id, OAS005 a response without description or an operation without
    responses, OAS006 only a default response, OAS008 and OAS009 bodies and responses with
    content but without schema, OAS020 no tags, OAS007 unusual error shapes."""
    ops, answers = c.operations, c.responses
    answer = F.concat_ws(" ", "method", "path", "status")
    only = answers.groupBy(*OPERATION).agg(F.bool_and(F.col("status") == "default").alias("only"))
    bare = c.bodies.where((F.size("schemas") == 0) & (F.col("ref").isNull() | (F.size("content_types") > 0)))
    return _all(
        _several(
            ops, (F.coalesce("operation_id", F.lit("")) == "", "OAS004", "LOW", _name()), (F.col("responses") == 0, "OAS005", "LOW", _name()),
            (F.size("tags") == 0, "OAS020", "INFO", _name()),
        ),
        _several(
            answers, (F.col("description").isNull() & F.col("ref").isNull(), "OAS005", "LOW", answer),
            ((F.size("schemas") == 0) & (F.size("content_types") > 0), "OAS009", "MEDIUM", answer),
        ),
        _found(only.where("only"), "OAS006", "LOW", _name()),
        _found(bare, "OAS008", "MEDIUM", _name()),
        unusual_errors(c),
    )


def unusual_errors(c: Contracts) -> DataFrame:
    """OAS007: operations whose 4xx and 5xx shapes differ from those that most operations of
    their document have, if three or more have any and at least 60 % agree."""
    errors = c.responses.where(F.substring("status", 1, 1).isin("4", "5"))
    named = errors.select(*OPERATION, F.explode("schemas").alias("schema"))
    own = named.groupBy(*OPERATION).agg(F.array_sort(F.collect_set(shape(F.col("schema")))).alias("shapes"))
    counts = own.groupBy(*KEY, "shapes").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*KEY).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("kinds"))
    odd = totals.where((F.col("total") >= LEAST_SHAPED) & (F.col("most") >= DOMINANT * F.col("total")) & (F.col("kinds") > 1))
    rare = counts.join(odd.hint("merge"), list(KEY)).where("n < most").select(*KEY, "shapes")
    return _found(own.join(rare.hint("merge"), [*KEY, "shapes"], "left_semi"), "OAS007", "LOW", _name())


def security_issues(c: Contracts) -> DataFrame:
    """OAS010: a document that requires no security, unless each operation does. OAS011: schemes
    that the document does not define, and operations that lift its requirement."""
    named = c.requirements.where(F.size("schemes") > 0)
    whole = named.where("method is null").select(*KEY).distinct()
    own = named.where("method is not null").select(*OPERATION).distinct()
    open_ops = c.operations.join(own.hint("merge"), list(OPERATION), "left_anti")
    exposed = open_ops.select(*KEY).distinct().join(whole.hint("merge"), list(KEY), "left_anti")
    used = named.select(*KEY, F.explode("schemes").alias("name")).distinct()
    lifted = open_ops.where("has_security").join(whole.hint("merge"), list(KEY), "left_semi")
    return _all(
        _found(exposed, "OAS010", "MEDIUM", F.col("doc")),
        _found(used.join(c.schemes.hint("merge"), [*KEY, "name"], "left_anti"), "OAS011", "HIGH", F.col("name")),
        _found(lifted, "OAS011", "HIGH", _name()),
    )


def open_sites(nodes: DataFrame) -> DataFrame:
    """(project, doc, name, sites): component schemas that allow any additional property, and
    at how many places; examples, other data and extensions have none. nodes: see sources.pointers;
    all rules on additional properties and the values directly in them."""
    at = nodes.where("plain and key = 'additionalProperties' and parent like '/components/schemas/_%'")
    within = nodes.where("parent like '%/additionalProperties'").select(*KEY, F.col("parent").alias("pointer"), F.lit(True).alias("filled")).distinct()
    free = at.join(within.hint("merge"), [*KEY, "pointer"], "left").where("value = 'true' or (kind = 'object' and filled is null)")
    token = F.element_at(F.split("parent", "/"), 4)
    name = F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return free.groupBy(*KEY, name.alias("name")).agg(F.count("*").alias("sites"))


def reference_cycles(sites: DataFrame) -> DataFrame:
    """(project, doc, pointer, circle, alias): values that references lead back to. A value leads to
    the targets of all references at or below it. circle: the first value of the set; alias: the set
    is made of bare references, which no value can stand for."""
    sites = settled(sites.where("status = 'RESOLVED'").select(*KEY, "pointer", "target_doc", "target"), "sites")
    ends = sites.select("project", F.col("target_doc").alias("doc"), F.col("target").alias("node")).distinct()
    around = sites.withColumn("node", F.explode(F.array_union(F.array(F.lit("")), pointer_steps(F.col("pointer")))))
    inner = around.join(ends.hint("merge"), [*KEY, "node"]).distinct()

    def name(doc: str, node: str) -> Column:
        return F.to_json(F.array("project", doc, node))

    edges = inner.select(name("doc", "node").alias("source"), F.lit("REFERS").alias("kind"), name("target_doc", "target").alias("target"))
    parts = F.from_json("node", "array<string>")
    found = graph.cycles(edges).select("circle", parts[0].alias("project"), parts[1].alias("doc"), parts[2].alias("pointer"))
    bare = sites.select(*KEY, "pointer", F.lit(True).alias("bare")).distinct()
    found = settled(found.join(bare.hint("merge"), [*KEY, "pointer"], "left"), "circles")
    alias = found.groupBy("circle").agg(F.bool_and(F.coalesce("bare", F.lit(False))).alias("alias"))
    return found.join(alias.hint("merge"), "circle").select(*KEY, "pointer", F.from_json("circle", "array<string>")[2].alias("circle"), "alias")


def schema_issues(c: Contracts) -> DataFrame:
    """OAS014 component schemas without type, OAS017 with free additional properties, OAS018
    that nothing refers to, OAS019 that lead back to themselves: MEDIUM where bare references do
    so, else INFO."""
    keys = F.map_keys(F.from_json("schema", "map<string,string>"))
    untyped = c.schemas.where(F.col("schema").startswith("{") & ~F.arrays_overlap(keys, F.array(*(F.lit(k) for k in TYPE_KEYS))))
    used = c.sites.where("status = 'RESOLVED'").select("project", F.col("target_doc").alias("doc"), F.col("target").alias("pointer")).distinct()
    token = F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    placed = c.schemas.withColumn("pointer", F.concat(F.lit("/components/schemas/"), token))
    circles = reference_cycles(c.sites)
    last = F.element_at(F.split("pointer", "/"), -1)
    subject = F.replace(F.replace(last, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return _all(
        _found(untyped, "OAS014", "LOW", F.col("name")), _found(open_sites(c.nodes), "OAS017", "LOW", F.col("name")),
        _found(placed.join(used.hint("merge"), [*KEY, "pointer"], "left_anti"), "OAS018", "LOW", F.col("name")),
        _found(circles, "OAS019", F.when(F.col("alias"), "MEDIUM").otherwise("INFO"), subject),
    )


def environment(url: Column) -> Column:
    """The environment that a server's host names; null for a url with variables."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?:{]+)", 1)
    host = F.lower(F.when(host != "", host).otherwise(F.element_at(F.split(F.trim(url), "/"), 1)))
    return F.when(~url.contains("{"), F.when(host.rlike(LOCAL) | host.rlike(PRIVATE), "local").when(host.rlike(STAGING), "staging")
                  .when(host.rlike(DEVELOPMENT), "dev").otherwise("other"))


def lifecycle_issues(c: Contracts) -> DataFrame:
    """OAS015: deprecated operations without a sunset extension or header. OAS016: documents
    whose servers belong to several environments."""
    marked = c.responses.where(F.exists("headers", lambda h: h.rlike(SUNSET_HEADER))).select(*OPERATION)
    old = c.operations.where(F.col("deprecated") & ~F.exists("extensions", lambda n: n.rlike(SUNSET_NAME)))
    spread = c.servers.groupBy(*KEY).agg(F.count_distinct(environment(F.col("url"))).alias("n")).where("n > 1")
    return _all(
        _found(old.join(marked.hint("merge"), list(OPERATION), "left_anti"), "OAS015", "LOW", _name()),
        _found(spread, "OAS016", "LOW", F.col("doc")),
    )

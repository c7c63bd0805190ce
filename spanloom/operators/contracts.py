"""Contract versions compared: operations, parameters, bodies, responses, security.

Inputs are tables of two versions with the columns of one schema each; every comparison is a
full outer join on the element's key. Changes have (project, kind, classification, side,
subject, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import drift_path, segments

BREAKING, POTENTIAL, HARMLESS = "BREAKING", "POTENTIALLY_BREAKING", "NON_BREAKING"
CHANGE = ("project", "kind", "classification", "side", "subject", "path")
#: Changes that become findings, as (kind, id, title, severity, confidence).
FINDINGS = [
    ("endpoint_removed", "COMPAT001", "Endpoint removed", "HIGH", "HIGH"),
    ("method_removed", "COMPAT002", "Method removed", "HIGH", "HIGH"),
    ("param_added_required", "COMPAT003", "Required parameter added", "HIGH", "HIGH"),
    ("param_removed", "COMPAT004", "Parameter removed", "HIGH", "HIGH"),
    ("type_changed_request", "COMPAT005", "Parameter/request field type changed", "HIGH", "HIGH"),
    ("request_field_required", "COMPAT006", "Request field became required", "HIGH", "HIGH"),
    ("response_field_removed", "COMPAT007", "Response field removed", "HIGH", "HIGH"),
    ("type_changed_response", "COMPAT008", "Response type narrowed or changed", "HIGH", "HIGH"),
    ("enum_removed", "COMPAT009", "Enum value removed", "HIGH", "HIGH"),
    ("status_removed", "COMPAT010", "Status code removed", "MEDIUM", "HIGH"),
    ("auth_tightened", "COMPAT011", "Auth requirement tightened", "HIGH", "HIGH"),
    ("content_type_removed", "COMPAT012", "Content-type removed", "MEDIUM", "HIGH"),
    ("response_field_added", "COMPAT020", "Response field added (candidate)", "LOW", "MEDIUM"),
    ("endpoint_added", "COMPAT021", "Endpoint added (candidate)", "INFO", "HIGH"),
    ("param_added_optional", "COMPAT022", "Optional parameter added (candidate)", "LOW", "HIGH"),
    ("enum_added", "COMPAT023", "Enum value added (candidate)", "LOW", "MEDIUM"),
    ("auth_loosened", "COMPAT024", "Auth requirement loosened", "LOW", "HIGH"),
    ("request_body_added", "COMPAT025", "Request body added", "MEDIUM", "HIGH"),
    ("request_field_added", "COMPAT026", "Request field added (optional)", "LOW", "HIGH"),
    ("request_field_removed", "COMPAT027", "Request field removed", "MEDIUM", "HIGH"),
    ("response_type_widened", "COMPAT028", "Response type widened", "MEDIUM", "MEDIUM"),
    ("unresolvable", "COMPAT030", "Change detail unresolvable", "MEDIUM", "LOW"),
]


def _change(kind: Column | str, classification: Column | str, side: str, subject: Column, path: Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    classification = F.lit(classification) if isinstance(classification, str) else classification
    return [
        F.col("project"), kind.alias("kind"), classification.alias("classification"),
        F.lit(side).alias("side"), subject.alias("subject"), path.alias("path"),
    ]


def identity(method: Column, path: Column, operation_id: Column) -> Column:
    own = F.trim(operation_id)
    return F.when(own != "", F.concat(F.lit("operation_id:"), own)).otherwise(
        F.concat(F.lit("method_path:"), F.upper(F.trim(method)), F.lit(" "), F.trim(path))
    )


def keyed(operations: DataFrame) -> DataFrame:
    """Operations (project, method, path, operation_id) with norm_path and identity."""
    return operations.withColumns(
        {
            "method": F.upper(F.trim("method")),
            "norm_path": drift_path(F.col("path")),
            "identity": identity(F.col("method"), F.col("path"), F.col("operation_id")),
        }
    )


def operation_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Endpoints and methods removed or added; a path that is gone, or new, is one change."""
    key = ["project", "method", "norm_path"]
    a = keyed(old).groupBy(*key).agg(F.min("identity").alias("was"))
    b = keyed(new).groupBy(*key).agg(F.min("identity").alias("now"))
    both = a.join(b.hint("merge"), key, "full")
    paths = both.groupBy("project", "norm_path").agg(
        (F.count("was") > 0).alias("had"),
        (F.count("now") > 0).alias("has"),
        F.min_by("was", "method").alias("first_was"),
        F.min_by("now", "method").alias("first_now"),
        F.collect_list(
            F.when(F.col("now").isNull(), F.struct(F.lit("method_removed").alias("kind"), F.col("was").alias("of")))
            .when(F.col("was").isNull(), F.struct(F.lit("endpoint_added").alias("kind"), F.col("now").alias("of")))
        ).alias("methods"),
    )
    gone = F.array(F.struct(F.lit("endpoint_removed").alias("kind"), F.col("first_was").alias("of")))
    come = F.array(F.struct(F.lit("endpoint_added").alias("kind"), F.col("first_now").alias("of")))
    which = F.when(~F.col("has"), gone).when(~F.col("had"), come).otherwise(F.col("methods"))
    found = paths.select("project", "norm_path", F.inline(which))
    breaking = F.when(F.col("kind") == "endpoint_added", POTENTIAL).otherwise(BREAKING)
    return found.select(*_change(F.col("kind"), breaking, "META", F.col("of"), F.col("norm_path")))


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Operations that both versions have, with the old identity as subject."""
    key = ["project", "method", "norm_path"]
    first = F.min(F.struct(F.col("identity").alias("subject"), F.col("path").alias("old_path"))).alias("of")
    a = keyed(old).groupBy(*key).agg(first).select(*key, "of.*")
    return a.join(keyed(new).select(*key).distinct().hint("merge"), key)


def parameter_changes(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Parameters (project, method, path, name, location_in, required) removed, added or made
    required, of operations in both versions."""
    key = ["project", "method", "norm_path", "name", "location_in"]

    def of(table: DataFrame, flag: str) -> DataFrame:
        named = table.where("name is not null and location_in is not null")
        rows = named.select(
            "project", F.upper(F.trim("method")).alias("method"), drift_path(F.col("path")).alias("norm_path"),
            "name", "location_in", F.coalesce("required", F.lit(False)).alias(flag),
        )
        return rows.groupBy(*key).agg(F.bool_or(flag).alias(flag)).join(pairs.hint("merge"), key[:3])

    a = of(old, "was")
    b = of(new, "now").drop("subject", "old_path")
    both = a.drop("subject", "old_path").join(b.hint("merge"), key, "full").join(pairs.hint("merge"), key[:3])
    kind = (
        F.when(F.col("now").isNull(), "param_removed")
        .when(F.col("was").isNull() & F.col("now"), "param_added_required")
        .when(F.col("was").isNull(), "param_added_optional")
        .when(~F.col("was") & F.col("now"), "param_added_required")
    )
    classification = F.when(F.col("kind") == "param_added_optional", POTENTIAL).otherwise(BREAKING)
    path = F.concat("old_path", F.lit("#"), "location_in", F.lit("/"), "name")
    found = both.withColumn("kind", kind).where("kind is not null")
    return found.select(*_change(F.col("kind"), classification, "REQUEST", F.col("subject"), path))


def parameter_schemas(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, subject, side, path, was, now): the schema texts of parameters in both versions."""
    key = ["project", "method", "norm_path", "name", "location_in"]

    def of(table: DataFrame, name: str) -> DataFrame:
        rows = table.where("name is not null and location_in is not null").select(
            "project", F.upper(F.trim("method")).alias("method"), drift_path(F.col("path")).alias("norm_path"),
            "name", "location_in", "schema",
        )
        return rows.groupBy(*key).agg(F.min("schema").alias(name))

    both = of(old, "was").join(of(new, "now").hint("merge"), key).join(pairs.hint("merge"), key[:3]).where("was is not null or now is not null")
    return both.select("project", "subject", F.lit("REQUEST").alias("side"), F.concat(F.lit("param:"), "name").alias("path"), "was", "now")


def body_changes(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Request bodies (project, method, path, content_types) removed or added, and content types
    that a kept body lost."""
    key = ["project", "method", "norm_path"]

    def of(table: DataFrame, name: str) -> DataFrame:
        return table.select(
            "project", F.upper(F.trim("method")).alias("method"), drift_path(F.col("path")).alias("norm_path"),
            F.coalesce("content_types", F.array().cast("array<string>")).alias(name),
        ).groupBy(*key).agg(F.min(name).alias(name))

    both = of(old, "was").join(of(new, "now").hint("merge"), key, "full").join(pairs.hint("merge"), key)
    whole = (
        F.when(F.col("now").isNull(), F.array(F.struct(F.lit("param_removed").alias("kind"), F.lit("").alias("type"))))
        .when(F.col("was").isNull(), F.array(F.struct(F.lit("request_body_added").alias("kind"), F.lit("").alias("type"))))
        .otherwise(
            F.transform(
                F.array_except("was", "now"),
                lambda t: F.struct(F.lit("content_type_removed").alias("kind"), F.concat(F.lit("/"), t).alias("type")),
            )
        )
    )
    found = both.select("project", "subject", "old_path", F.inline(whole))
    breaking = F.when(F.col("kind") == "request_body_added", POTENTIAL).otherwise(BREAKING)
    path = F.concat("old_path", F.lit("#requestBody"), "type")
    return found.select(*_change(F.col("kind"), breaking, "REQUEST", F.col("subject"), path))


def response_changes(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Responses (project, method, path, status, content_types): statuses that are gone, and
    content types that a kept status lost."""
    key = ["project", "method", "norm_path"]

    def of(table: DataFrame, name: str) -> DataFrame:
        rows = table.where("status is not null and status <> ''")
        return rows.select(
            "project", F.upper(F.trim("method")).alias("method"), drift_path(F.col("path")).alias("norm_path"), "status",
            F.coalesce("content_types", F.array().cast("array<string>")).alias(name),
        ).groupBy(*key, "status").agg(F.min(name).alias(name))

    both = of(old, "was").join(of(new, "now").hint("merge"), [*key, "status"], "left").join(pairs.hint("merge"), key)
    which = F.when(
        F.col("now").isNull(), F.array(F.struct(F.lit("status_removed").alias("kind"), F.lit("").alias("type")))
    ).otherwise(
        F.transform(
            F.array_except("was", "now"),
            lambda t: F.struct(F.lit("content_type_removed").alias("kind"), F.concat(F.lit("/"), t).alias("type")),
        )
    )
    found = both.select("project", "subject", "old_path", "status", F.inline(which))
    path = F.concat("old_path", F.lit("#responses/"), "status", "type")
    return found.select(*_change(F.col("kind"), BREAKING, "RESPONSE", F.col("subject"), path))


def effective_security(operations: DataFrame, requirements: DataFrame) -> DataFrame:
    """(project, method, norm_path, alternatives): an operation's own requirements if it has a
    security entry, else the document's; none means one empty alternative, anonymous.
    requirements: (project, owner: identity or '' for the document, schemes array)."""
    alts = requirements.groupBy("project", "owner").agg(
        F.array_sort(F.collect_set(F.array_sort("schemes"))).alias("alternatives")
    )
    owner = F.when(F.col("has_security"), F.col("identity")).otherwise(F.lit(""))
    rows = keyed(operations).withColumn("owner", owner).join(alts.hint("merge"), ["project", "owner"], "left")
    anonymous = F.array(F.array().cast("array<string>"))
    own = F.coalesce("alternatives", anonymous)
    return rows.groupBy("project", "method", "norm_path").agg(F.min_by(own, "identity").alias("alternatives"))


def security_changes(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: effective_security of either version. Tightened unless each old alternative is
    still enough; else loosened if a new one asks for less, or for what none did."""
    key = ["project", "method", "norm_path"]
    both = old.withColumnRenamed("alternatives", "was").join(new.withColumnRenamed("alternatives", "now").hint("merge"), key).join(pairs.hint("merge"), key)

    def within(small: Column, large: Column) -> Column:
        return F.size(F.array_except(small, large)) == 0

    still = F.forall("was", lambda a: F.exists("now", lambda b: within(b, a)))
    fresh = F.exists("now", lambda b: ~F.exists("was", lambda a: within(a, b)))
    kind = F.when(~still, "auth_tightened").when(fresh, "auth_loosened")
    found = both.where(F.col("was") != F.col("now")).withColumn("kind", kind).where("kind is not null")
    classification = F.when(F.col("kind") == "auth_tightened", BREAKING).otherwise(HARMLESS)
    path = F.concat("old_path", F.lit("#security"))
    return found.select(*_change(F.col("kind"), classification, "META", F.col("subject"), path))


def findings(changes: DataFrame) -> DataFrame:
    """Changes as findings by kind; a change that cannot be resolved has confidence UNKNOWN."""
    spec = "kind string, id string, title string, severity string, confidence string"
    kinds = changes.sparkSession.createDataFrame(FINDINGS, spec)
    confidence = F.when(F.col("classification") == "UNKNOWN", "UNKNOWN").otherwise(F.col("confidence"))
    return changes.join(F.broadcast(kinds).hint("merge"), "kind").select(
        "project", "id", "title", "severity", confidence.alias("confidence"), "subject", "path"
    )


def fingerprints(rows: DataFrame, contract: str) -> DataFrame:
    """(contract, fingerprint, elements): a hash of a contract's rows that their order does not
    change. Rows are hashed and equal hashes counted; digests of those with a common prefix of
    8 hex digits are combined into digests of 6, 4, 2 and none. A list thus holds 256 digests,
    or at the first level a 2**32th of a contract's distinct rows."""
    values = [c for c in sorted(rows.columns) if c != contract]
    one = F.sha2(F.to_json(F.struct(*values)), 256)
    hashed = rows.select(F.col(contract).alias("contract"), one.alias("part"))
    parts = hashed.groupBy("contract", "part").agg(F.count("*").alias("n")).withColumn("digest", F.col("part"))
    for size in (8, 6, 4, 2, 0):
        line = F.concat_ws(":", "part", "digest", "n")
        parts = parts.groupBy("contract", F.substring("part", 1, size).alias("to")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"),
            F.sum("n").alias("n"),
        ).withColumnRenamed("to", "part")
    return parts.select("contract", F.col("digest").alias("fingerprint"), F.col("n").alias("elements"))


def suffix_pairs(templates: DataFrame, concrete: DataFrame) -> DataFrame:
    """Rows of templates (template, ..) and concrete (path, ..) where the template fits the end
    of the path.

    A template's signature is its number of segments, which of them are variables, and the
    others' text. The distinct (number, variables) masks are few; each concrete path gets the
    signature of its end under each mask, and the join is on equal signatures.
    """
    t = segments(F.col("template"))
    variable = F.transform(t, lambda s: s.rlike(r"^\{.*\}$"))
    marked = templates.withColumns(
        {
            "mask": F.array_join(F.transform(variable, lambda v: F.when(v, "1").otherwise("0")), ""),
            "signature": F.array_join(F.transform(t, lambda s: F.when(s.rlike(r"^\{.*\}$"), "{}").otherwise(s)), "/"),
        }
    ).where("mask <> ''")
    masks = marked.groupBy().agg(F.collect_set("mask").alias("masks"))
    c = F.col("parts")
    paths = concrete.withColumn("parts", segments(F.col("path"))).join(F.broadcast(masks).hint("merge"))  # one row
    paths = paths.select("*", F.explode("masks").alias("mask")).where(F.size(c) >= F.length("mask"))
    tail = F.slice(c, F.size(c) - F.length("mask") + 1, F.length("mask"))
    flags = F.split("mask", "")
    signature = F.array_join(F.zip_with(tail, F.slice(flags, 1, F.length("mask")), lambda s, f: F.when(f == "1", "{}").otherwise(s)), "/")
    signed = paths.withColumn("signature", signature).drop("parts", "masks")
    return marked.join(signed.hint("merge"), ["mask", "signature"]).drop("mask", "signature")


def client_impact(changes: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Changes that are not harmless at the call sites they reach: changes (subject, method?,
    template, classification, field), call_sites (client, site_method?, path, fields array).
    CLIENT001 if a breaking change hits a field the site reads, else CLIENT002."""
    reached = suffix_pairs(changes.where(F.col("classification") != HARMLESS), call_sites)
    same = F.col("method").isNull() | F.col("site_method").isNull() | (F.col("method") == F.col("site_method"))
    reads = F.coalesce(F.array_contains("fields", F.col("field")), F.lit(False))
    check = F.when((F.col("classification") == BREAKING) & reads, "CLIENT001").otherwise("CLIENT002")
    return reached.where(same).select(check.alias("id"), "client", "subject", "path", "classification")

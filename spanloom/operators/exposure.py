"""Security evidence that contracts carry in extensions, and what follows from it.

Extension values may be of any JSON type; they are read as variants and bound to the object that
holds them by its pointer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.sources.openapi import Contracts
from spanloom.sources.pointers import extensions, operation_pointer

OPERATION = ["project", "doc", "method", "path"]
#: Extensions that classify data, categories by their names, names of sensitive fields,
#: and of middleware that decides who may do what.
CLASSIFYING = ("x-sensitive", "x-pii", "x-classification", "x-data-classification", "x-sensitivity")
CATEGORIES = ("credential", "financial", "health", "internal")
SENSITIVE = (
    "password", "passwd", "secret", "token", "access_token", "refresh_token", "api_key", "apikey", "private_key", "ssn",
    "social_security_number", "credit_card", "card_number", "cvv", "iban", "account_number", "pin",
)
DECIDES = r"(?i)(rbac|permiss|authoriz|role|guard|acl|owner|scope)"
PROPERTY = r"^/components/schemas/([^/]+)(?:/properties/[^/]+)*/properties/([^/]+)$"
ANSWER = r"^(?:/paths/[^/]+/[^/]+|/components)/responses/[^/]+/content/[^/]+/schema$"


def unescaped(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def truth(value: Column) -> Column:
    """Whether JSON text is neither null, false, zero nor empty."""
    return F.coalesce(~value.rlike(r'^(null|false|-?0(\.0+)?|""|\[\]|\{\})$'), F.lit(False))


def texts(value: Column) -> Column:
    """JSON text as a list of texts: a text at its commas, a list item by item, else nothing."""
    variant = F.try_parse_json(value)
    one = F.try_variant_get(variant, "$", "string")
    parts = F.filter(F.transform(F.split(one, ","), lambda s: F.trim(s)), lambda s: s != "")
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.startswith('"'), parts), none)


def _merged(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists))))


def authorization(c: Contracts) -> DataFrame:
    """(project, doc, method, path, roles, scopes, claims, ownership): what a contract asks of the
    callers of an operation, by extensions on it and the scopes of the requirements that hold for
    it. ownership is null if nothing is said. Operations that ask nothing have no row."""
    none = F.array().cast("array<string>")
    own = c.operations.select(*OPERATION, "has_security", operation_pointer(F.col("path"), F.col("method")).alias("owner"))
    said = extensions(c.nodes).withColumn("name", F.lower("name"))
    value, name, nested = F.col("value"), F.col("name"), F.col("name").isin("x-authorization", "x-authz") & (F.col("kind") == "object")

    def listed(names: tuple[str, ...], part: str) -> Column:
        inner = F.get_json_object("value", f"$.{part}")
        quoted = F.when(inner.startswith("["), inner).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))
        return F.when(name.isin(*names), texts(value)).when(nested, texts(quoted)).otherwise(none)

    variant = F.try_parse_json("value")
    kept = F.coalesce(F.try_variant_get(variant, "$.ownership_check", "variant"), F.try_variant_get(variant, "$.ownershipCheck", "variant"))
    owns = F.when(name.isin("x-ownership-check", "x-owner-check"), truth(value)).when(nested & kept.isNotNull(), truth(F.to_json(kept)))
    rows = own.join(said.hint("merge"), ["project", "doc", "owner"]).select(
        *OPERATION, listed(("x-roles", "x-role"), "roles").alias("roles"), listed(("x-scopes", "x-scope"), "scopes").alias("scopes"),
        listed(("x-claims", "x-required-claims"), "claims").alias("claims"), owns.alias("ownership"),
    )
    named = c.requirements.select(*OPERATION, "scopes")
    direct = own.where("has_security").join(named.where("method is not null").hint("merge"), OPERATION)
    whole = own.where("not has_security").join(named.where("method is null").select("project", "doc", "scopes").hint("merge"), ["project", "doc"])
    asked = direct.select(*OPERATION, "scopes").union(whole.select(*OPERATION, "scopes"))
    rows = rows.unionByName(asked, allowMissingColumns=True)
    found = rows.groupBy(*OPERATION).agg(
        *(_merged(F.coalesce(p, none)).alias(p) for p in ("roles", "scopes", "claims")), F.bool_or("ownership").alias("ownership")
    )
    return found.where((F.size("roles") > 0) | (F.size("scopes") > 0) | (F.size("claims") > 0) | F.col("ownership").isNotNull())


def classifications(nodes: DataFrame) -> DataFrame:
    """(project, doc, subject, category) of extensions that classify: of a property the subject is
    'Schema.property', of anything else outside of properties its pointer. A text must name a
    category, true means internal; x-pii means PII if it is anything."""
    name, value = F.lower("name"), F.col("value")
    said = extensions(nodes).where(name.isin(*CLASSIFYING))
    given = F.when(F.col("kind") == "string", F.try_variant_get(F.try_parse_json(value), "$", "string")).when(
        F.col("kind") == "object", F.get_json_object(value, "$.category")
    )
    category = (
        F.when((name == "x-pii") & truth(value), "PII")
        .when(F.lower(given).isin(*CATEGORIES), F.lower(given))
        .when(value == "true", "internal")
    )
    of = F.when(
        F.col("owner").rlike(PROPERTY),
        F.concat_ws(".", unescaped(F.regexp_extract("owner", PROPERTY, 1)), unescaped(F.regexp_extract("owner", PROPERTY, 2))),
    ).when(~F.contains("owner", F.lit("/properties/")), F.col("owner"))
    return said.select("project", "doc", of.alias("subject"), category.alias("category")).dropna().distinct()


def webhooks(nodes: DataFrame) -> DataFrame:
    """(project, doc, webhook, signature, replay, idempotency, retry): what extensions at or below a
    webhook say; null if nothing. Of several of a kind, one that is true counts."""
    every = nodes.where("parent = '/webhooks' and role is null").select("project", "doc", F.col("key").alias("webhook"), F.col("pointer").alias("at"))
    owner = F.concat(F.lit("/webhooks/"), F.element_at(F.split("owner", "/"), 3))
    said = extensions(nodes).where("owner like '/webhooks/_%'").select("project", "doc", owner.alias("at"), F.lower("name").alias("name"), truth(F.col("value")).alias("is"))
    kinds = {"signature": "signature", "replay": "replay", "idempotency": "idempot", "retry": "retry"}
    first = F.lit(None).cast("string")
    for kind, word in reversed(kinds.items()):
        first = F.when(F.contains("name", F.lit(word)), kind).otherwise(first)
    rows = every.join(said.withColumn("of", first).hint("merge"), ["project", "doc", "at"], "left")
    return rows.groupBy("project", "doc", "webhook").agg(*(F.bool_or(F.when(F.col("of") == k, F.col("is"))).alias(k) for k in kinds))


def middleware_grants(routes: DataFrame) -> DataFrame:
    """(project, method, path, via) of routes (project, method, path, middleware): mechanisms whose
    name tells that they decide who may do what."""
    via = F.trim(F.substring_index("m", "(", 1))
    rows = routes.select("project", F.upper("method").alias("method"), "path", F.explode("middleware").alias("m"))
    return rows.select("project", "method", "path", via.alias("via")).where(F.col("via").rlike(DECIDES)).distinct()


def exposed_schemas(c: Contracts) -> DataFrame:
    """(project, doc, name, hops): component schemas that responses are made of. 0 hops: a response
    refers to it; each step follows the references within a schema, until nothing new is met.
    Each step is a written table of the schemas met first then."""
    key = ["project", "doc"]
    prefix = "/components/schemas/"
    sites = c.sites.where(F.col("ref").startswith("#" + prefix) & (F.col("status") == "RESOLVED"))
    target = F.element_at(F.split("target", "/"), 4)
    front = sites.where(F.col("pointer").rlike(ANSWER)).select(*key, target.alias("token")).distinct()
    links = sites.where(F.col("pointer").startswith(prefix)).select(*key, F.element_at(F.split("pointer", "/"), 4).alias("token"), target.alias("to")).distinct()
    links = settled(links, "schema-links")
    front = settled(front.withColumn("hops", F.lit(0)), "exposed")
    met, hops = front, 0
    while not front.isEmpty():
        hops += 1
        further = front.join(links.hint("merge"), [*key, "token"]).select(*key, F.col("to").alias("token")).distinct()
        front = settled(further.join(met.hint("merge"), [*key, "token"], "left_anti").withColumn("hops", F.lit(hops)), "exposed")
        met = met.unionByName(front)
    return met.select(*key, unescaped(F.col("token")).alias("name"), "hops")


def property_risks(c: Contracts) -> DataFrame:
    """(project, doc, id, subject, hops). APISEC008: classified properties of schemas that a response
    refers to (hops 0) or reaches through other schemas (hops 1 and more). APISEC011: operations
    whose own security names no declared scheme or none at all under a document that has some, or
    of which nothing is said at any level. APISEC012: properties of schemas with the name of a
    secret that are not write-only, passwords, redacted or classified."""
    key = ["project", "doc"]
    marked = settled(classifications(c.nodes), "classified")
    subject = F.col("subject")
    dotted = marked.where(~subject.startswith("/")).withColumn("name", F.substring_index("subject", ".", 1))
    shown = dotted.join(exposed_schemas(c).hint("merge"), [*key, "name"]).select(*key, F.lit("APISEC008").alias("id"), "subject", "hops")

    named = F.concat_ws(" ", "method", "path")
    whole = c.requirements.where("method is null").select(*key).distinct()
    own = c.requirements.where("method is not null").select(*OPERATION, F.explode_outer("schemes").alias("name"))
    unknown = own.where("name is not null").join(c.schemes.select(*key, "name").hint("merge"), [*key, "name"], "left_anti").select(*OPERATION).distinct()
    stated = own.select(*OPERATION).distinct()
    lifted = c.operations.where("has_security").join(whole.hint("merge"), key, "left_semi")
    vague = lifted.join(stated.hint("merge"), OPERATION, "left_anti").select(*OPERATION).union(lifted.join(unknown.hint("merge"), OPERATION, "left_semi").select(*OPERATION))
    silent = c.operations.where("not has_security").join(whole.hint("merge"), key, "left_anti").select(*OPERATION)
    unsure = vague.union(silent).distinct().select(*key, F.lit("APISEC011").alias("id"), named.alias("subject"), F.lit(None).cast("int").alias("hops"))

    at = c.nodes.where(F.col("parent").rlike("^/components/schemas/[^/]+/properties$") & F.lower("key").isin(*SENSITIVE))
    at = at.select(*key, "pointer", F.concat_ws(".", unescaped(F.element_at(F.split("pointer", "/"), 4)), "key").alias("subject"))
    inner = c.nodes.select(*key, F.col("parent").alias("pointer"), "key", "value", "role")
    guards = (
        ((F.col("key") == "writeOnly") & (F.col("value") == "true")) | ((F.col("key") == "format") & (F.col("value") == "password"))
        | (F.lower("key").startswith("x-") & F.contains(F.lower("key"), F.lit("redact")))
    )
    bare = at.join(inner.where(guards).hint("merge"), [*key, "pointer"], "left_anti").join(marked.hint("merge"), [*key, "subject"], "left_anti")
    exposed = bare.select(*key, F.lit("APISEC012").alias("id"), "subject", F.lit(None).cast("int").alias("hops"))
    return reduce(DataFrame.unionByName, [shown, unsure, exposed])


def surrounding_risks(planes: DataFrame, cors: DataFrame, external: DataFrame) -> DataFrame:
    """(project, id, subject). planes as from security.auth_planes: APISEC013, chains that break. cors
    (project, scope, wildcard): APISEC004. external (project, host, timeout_ms, has_auth): APISEC010,
    hosts without a timeout or authentication, with what is missing."""
    gaps = F.array_compact(F.array(F.when(F.col("timeout_ms").isNull(), "timeout"), F.when(~F.coalesce("has_auth", F.lit(False)), "auth")))
    missing = external.withColumn("gaps", gaps).where(F.size("gaps") > 0)

    def found(rows: DataFrame, check: str, subject: Column) -> DataFrame:
        return rows.select("project", F.lit(check).alias("id"), subject.alias("subject"))

    return reduce(DataFrame.unionByName, [
        found(planes.where("chain = 'BROKEN'"), "APISEC013", F.concat_ws(" ", "method", "path")),
        found(cors.where("wildcard"), "APISEC004", F.col("scope")),
        found(missing, "APISEC010", F.concat(F.col("host"), F.lit(": "), F.array_join("gaps", "/"))),
    ])

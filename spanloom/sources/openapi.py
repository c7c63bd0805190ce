"""Contract documents in JSON, exploded into tables.

A document stays one row until its parts are exploded, and every part is parsed from its own
JSON text, so an unexpected part is null and the rest of its document remains. Tables carry
(project, doc); operations, and what belongs to them, also (method, path).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.sources.pointers import json_nodes, reference_sites

#: Keys of a path item that are operations.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
SECTIONS = ("schemas", "parameters", "responses", "requestBodies", "securitySchemes")
TEXTS = "map<string,string>"
DOCUMENT = (
    "openapi string, servers array<struct<url:string>>, security string, paths map<string,map<string,string>>, "
    f"components struct<{', '.join(f'{s}:{TEXTS}' for s in SECTIONS)}>"
)
OPERATION = (
    "operationId string, tags array<string>, deprecated boolean, description string, summary string, security string, "
    f"parameters array<string>, requestBody string, responses {TEXTS}"
)
PARAMETER = "name string, `in` string, required boolean, schema string, `$ref` string"
CONTENT = f"description string, content map<string,struct<schema:string>>, headers {TEXTS}, `$ref` string"
ALTERNATIVES = "array<map<string,array<string>>>"


@dataclass(frozen=True)
class Contracts:
    """documents: openapi, status. servers: url. operations: operation_id, tags, deprecated,
    described, has_security, responses (their number), extensions (names starting with x-).
    parameters: name, location_in, required, schema. bodies and responses (status): description,
    content_types, schemas (JSON texts), headers, ref. schemas: name, schema. schemes: name.
    requirements: method and path (null for the document's), schemes and scopes (arrays), of which several
    are alternatives. references: ref, status, each once. sites: all places of references
    (see sources.pointers). nodes: all values by pointer. Both walk the documents each time that
    they are read; `held` keeps them, `referred` the references. texts: project, doc, text of readable documents."""

    documents: DataFrame
    servers: DataFrame
    operations: DataFrame
    parameters: DataFrame
    bodies: DataFrame
    responses: DataFrame
    schemas: DataFrame
    schemes: DataFrame
    requirements: DataFrame
    references: DataFrame
    sites: DataFrame
    nodes: DataFrame
    texts: DataFrame


def referred(c: Contracts) -> Contracts:
    """The contracts with their references as a written table."""
    sites = settled(reference_sites(c.texts, written=True), "sites")
    return replace(c, sites=sites, references=sites.select("project", "doc", "ref", "status").distinct())


def held(c: Contracts) -> Contracts:
    """The contracts with their values and references as written tables, so that several rules read
    them and documents are walked once for each."""
    return replace(referred(c), nodes=settled(c.nodes, "nodes"))


def readable(docs: DataFrame) -> DataFrame:
    """The docs whose text is whole JSON, for rules that need values or references alone."""
    return docs.where(F.try_parse_json("text").isNotNull())


def document_status(text: Column, version: Column, readable: Column | None = None) -> Column:
    """readable: whether the text is whole JSON, where that is known."""
    readable = F.try_parse_json(text).isNotNull() if readable is None else readable
    return (
        F.when(text.isNull(), "UNREADABLE")
        .when(~readable, "MALFORMED")
        .when(~F.coalesce(version.rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)), "INVALID_VERSION")
        .when(~version.rlike(r"^3\.[01]\."), "UNSUPPORTED_VERSION")
        .otherwise("PARSED")
    )


def _last(ref: Column) -> Column:
    return F.element_at(F.split(ref, "/"), -1)


def _resolved(part: Column, section: Column, kind: str) -> Column:
    """A part's text, or of a local reference to the document's components the target's."""
    ref = F.from_json(part, "`$ref` string")["$ref"]
    return F.coalesce(F.try_element_at(section, F.when(ref.startswith(f"#/components/{kind}/"), _last(ref))), part)


def _content(part: Column) -> dict[str, Column]:
    media = F.coalesce(part["content"], F.create_map().cast("map<string,struct<schema:string>>"))
    return {
        "description": part["description"],
        "content_types": F.array_sort(F.map_keys(media)),
        "schemas": F.array_sort(F.array_compact(F.transform(F.map_values(media), lambda m: m["schema"]))),
        "headers": F.array_sort(F.map_keys(F.coalesce(part["headers"], F.create_map().cast(TEXTS)))),
        "ref": part["$ref"],
    }


def explode_contracts(docs: DataFrame) -> Contracts:
    """The tables of docs (project, doc, text). Texts are whole JSON documents; what cannot be
    parsed gives a documents row with its status and nothing else. The documents are parsed once and
    written with their parts, which all tables read."""
    key = ["project", "doc"]
    readable = F.try_parse_json("text").isNotNull()  # a text that is cut off has no parts
    parsed = docs.select(*key, "text", readable.alias("readable"), F.when(readable, F.from_json("text", DOCUMENT)).alias("d"))
    parsed = parsed.withColumn("status", document_status(F.col("text"), F.col("d.openapi"), F.col("readable")))
    parsed = settled(parsed, "documents")
    documents = parsed.select(*key, F.col("d.openapi").alias("openapi"), "status")
    texts = parsed.where("readable").select(*key, "text")
    parts = F.col("d.components")
    items = parsed.select(*key, "d", F.explode("d.paths").alias("path", "item"))
    owned = items.select(*key, "d", "path", "item", F.explode("item").alias("verb", "part"))
    owned = owned.where(F.lower("verb").isin(*METHODS)).select(
        *key, "d", F.upper("verb").alias("method"), "path", "part", F.from_json("part", OPERATION).alias("o"),
        F.from_json(F.try_element_at("item", F.lit("parameters")), "array<string>").alias("shared"),
    )
    names = F.map_keys(F.from_json("part", TEXTS))
    none = F.array().cast("array<string>")
    operations = owned.select(
        *key, "method", "path", F.col("o.operationId").alias("operation_id"), F.coalesce("o.tags", none).alias("tags"),
        F.coalesce("o.deprecated", F.lit(False)).alias("deprecated"),
        (F.coalesce("o.description", "o.summary", F.lit("")) != "").alias("described"),
        F.col("o.security").isNotNull().alias("has_security"),
        F.coalesce(F.size("o.responses"), F.lit(0)).alias("responses"),
        F.filter(names, lambda n: n.startswith("x-")).alias("extensions"),
    )
    each = owned.select(
        *key, "method", "path", parts.getField("parameters").alias("of"),
        F.posexplode(F.concat(F.coalesce("o.parameters", none), F.coalesce("shared", none))).alias("place", "part"),
    ).select(*key, "method", "path", "place", F.from_json(_resolved(F.col("part"), F.col("of"), "parameters"), PARAMETER).alias("p"))
    parameters = each.where("p.name is not null").groupBy(  # an operation's own before the shared ones
        *key, "method", "path", F.col("p.name").alias("name"), F.col("p.in").alias("location_in")
    ).agg(F.min_by("p", "place").alias("p")).select(
        *key, "method", "path", "name", "location_in", F.coalesce("p.required", F.lit(False)).alias("required"), F.col("p.schema").alias("schema")
    )
    body = F.from_json(_resolved(F.col("o.requestBody"), parts.getField("requestBodies"), "requestBodies"), CONTENT)
    bodies = owned.where("o.requestBody is not null").select(*key, "method", "path", body.alias("b"))
    bodies = bodies.select(*key, "method", "path", *(c.alias(n) for n, c in _content(F.col("b")).items()))
    answers = owned.select(*key, "method", "path", parts.getField("responses").alias("of"), F.explode("o.responses").alias("status", "part"))
    answers = answers.withColumn("r", F.from_json(_resolved(F.col("part"), F.col("of"), "responses"), CONTENT))
    responses = answers.select(*key, "method", "path", "status", *(c.alias(n) for n, c in _content(F.col("r")).items()))
    schemas = parsed.select(*key, F.explode(parts.getField("schemas")).alias("name", "schema"))
    schemes = parsed.select(*key, F.explode(parts.getField("securitySchemes")).alias("name", "scheme")).drop("scheme")

    def alternatives(owner: DataFrame, method: Column, path: Column, text: Column) -> DataFrame:
        rows = owner.select(*key, method.alias("method"), path.alias("path"), F.explode(F.from_json(text, ALTERNATIVES)).alias("one"))
        scopes = F.array_sort(F.array_distinct(F.flatten(F.map_values("one"))))
        return rows.select(*key, "method", "path", F.array_sort(F.map_keys("one")).alias("schemes"), scopes.alias("scopes"))

    null = F.lit(None).cast("string")
    requirements = alternatives(parsed, null, null, F.col("d.security")).union(
        alternatives(owned, F.col("method"), F.col("path"), F.col("o.security"))
    )
    nodes = json_nodes(texts)
    sites = reference_sites(texts)
    references = sites.select(*key, "ref", "status").distinct()
    servers = parsed.select(*key, F.explode("d.servers").alias("server")).select(*key, F.col("server.url").alias("url"))
    return Contracts(documents, servers, operations, parameters, bodies, responses, schemas, schemes, requirements, references, sites, nodes, texts)

"""Two versions of remote-procedure and graph-query contracts compared, and rules over one.

Versions are tables of the same columns; elements are matched by full outer joins on what identifies
them: a field of a message by its number on the wire and by its name. Changes are (project, kind,
classification, side, subject, path), findings (project, id, subject).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import graph
from spanloom.operators.contracts import BREAKING, CHANGE, POTENTIAL

#: Types whose values stay readable as each other on the wire; each type belongs to the
#: first group that names it.
WIRE_GROUPS = (
    ("int32", "int64", "uint32", "uint64", "sint32", "sint64", "bool", "enum"), ("sint32", "sint64"), ("fixed32", "sfixed32", "float"),
    ("fixed64", "sfixed64", "double"), ("string",), ("bytes",),
)
#: Arguments that bound a list, and the depth of a query that is reported beyond.
PAGES = ("first", "last", "after", "before", "limit", "offset", "page", "pageSize")
DEPTH = 5


def _any(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _changes(rows: DataFrame, kind: Column | str, classification: Column | str, side: Column | str, subject: Column, path: Column) -> DataFrame:
    def lit(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return rows.select("project", lit(kind).alias("kind"), lit(classification).alias("classification"), lit(side).alias("side"), subject.alias("subject"), path.alias("path"))


def _met(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both versions by key: `was` and `now`, structs of the other columns, null where
    there is none."""
    was = old.select(*keys, F.struct(*(c for c in old.columns if c not in keys), F.lit(True).alias("there")).alias("was"))
    now = new.select(*keys, F.struct(*(c for c in new.columns if c not in keys), F.lit(True).alias("there")).alias("now"))
    return was.join(now.hint("merge"), keys, "full")


GONE, CAME, KEPT = "was is not null and now is null", "was is null and now is not null", "was is not null and now is not null"


@dataclass(frozen=True)
class Rpc:
    """services: project, package, service. methods: and method, streaming, idempotent. messages:
    project, message, reserved (array of numbers), oneofs (array). fields: project, message, field,
    number, type, label, oneof. enums: project, enum, value, number."""

    services: DataFrame
    methods: DataFrame
    messages: DataFrame
    fields: DataFrame
    enums: DataFrame


def wire_group(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, group in reversed(list(enumerate(WIRE_GROUPS))):
        out = F.when(kind.isin(*group), i).otherwise(out)
    return out


def rpc_changes(old: Rpc, new: Rpc) -> DataFrame:
    """Changes of services, methods, messages, fields and enumerations. A field that goes is
    BREAKING unless its number is reserved then; a number that another field takes, a field that
    enters or leaves a oneof, a value that gets another number are BREAKING; a type that changes is so
    unless both are read alike on the wire; a oneof that gains a member may break. Messages,
    services and methods are told apart by name only."""
    service, named = F.concat_ws(".", "package", "service"), F.concat_ws("/", F.concat_ws(".", "package", "service"), "method")
    gone = _met(old.services.withColumn("x", F.lit(0)), new.services.withColumn("x", F.lit(0)), ["project", "package", "service"]).where(GONE)
    both = new.services.select("project", "package", "service")
    methods = _met(old.methods, new.methods, ["project", "package", "service", "method"]).join(both.hint("merge"), ["project", "package", "service"], "left_semi")
    methods = methods.join(old.services.select("project", "package", "service").hint("merge"), ["project", "package", "service"], "left_semi")
    at = F.concat(F.lit("method:"), named)
    out = [
        _changes(gone, "GRPC_RENAME", BREAKING, "RESPONSE", F.concat(F.lit("grpc_service:"), service), F.concat(F.lit("service:"), service)),
        _changes(methods.where(GONE), "GRPC_METHOD_REMOVED", BREAKING, "RESPONSE", F.concat(F.lit("grpc_service:"), service), at),
        _changes(methods.where(KEPT).where("was.streaming <> now.streaming"), "GRPC006", BREAKING, "RESPONSE", F.concat(F.lit("grpc_method:"), named), at),
    ]
    messages = _met(old.messages, new.messages, ["project", "message"])
    subject = F.concat(F.lit("proto_message:"), F.col("message"))
    out.append(_changes(messages.where(GONE), "GRPC_FIELD_REMOVED", BREAKING, "RESPONSE", subject, F.concat(F.lit("message:"), F.col("message"))))
    kept = messages.where(KEPT).select("project", "message", F.col("now.reserved").alias("reserved"), F.array_intersect("was.oneofs", "now.oneofs").alias("groups"))

    def fields(of: DataFrame, key: str) -> DataFrame:
        return of.join(kept.select("project", "message").hint("merge"), ["project", "message"], "left_semi").select("project", "message", key, *(c for c in of.columns if c not in ("project", "message", key)))

    by_number = _met(fields(old.fields, "number"), fields(new.fields, "number"), ["project", "message", "number"])
    removed = by_number.where(GONE).join(kept.hint("merge"), ["project", "message"])
    out.append(_changes(
        removed, "GRPC003", F.when(F.array_contains("reserved", F.col("number")), POTENTIAL).otherwise(BREAKING), "RESPONSE", subject,
        F.concat(F.lit("field:"), F.col("message"), F.lit("."), F.col("was.field")),
    ))
    reused = by_number.where(KEPT).where("was.field <> now.field")
    out.append(_changes(reused, "GRPC004", BREAKING, "RESPONSE", subject, F.concat(F.lit("field:"), F.col("message"), F.lit("#"), F.col("number"))))
    by_name = _met(fields(old.fields, "field"), fields(new.fields, "field"), ["project", "message", "field"])
    field = F.concat(F.lit("field:"), F.col("message"), F.lit("."), F.col("field"))
    out.append(_changes(by_name.where(KEPT).where("not (was.oneof <=> now.oneof)"), "GRPC009", BREAKING, "RESPONSE", subject, field))
    joined = by_name.where("now is not null and now.oneof is not null and not (was.oneof <=> now.oneof)").join(kept.hint("merge"), ["project", "message"])
    joined = joined.where(F.array_contains("groups", F.col("now.oneof")))
    out.append(_changes(
        joined, "GRPC009", POTENTIAL, "RESPONSE", subject, F.concat(F.lit("oneof:"), F.col("message"), F.lit("."), F.col("now.oneof"), F.lit("."), F.col("field")),
    ))
    typed = by_name.where(KEPT).where("was.number = now.number and (was.type <> now.type or coalesce(was.label, '') <> coalesce(now.label, ''))")
    alike = wire_group(F.col("was.type")) == wire_group(F.col("now.type"))
    out.append(_changes(typed, "GRPC_TYPE_CHANGED", F.when(alike, POTENTIAL).otherwise(BREAKING), "RESPONSE", subject, field))
    lasting = old.enums.select("project", "enum").distinct().join(new.enums.select("project", "enum").distinct().hint("merge"), ["project", "enum"], "left_semi")
    values = _met(old.enums, new.enums, ["project", "enum", "value"]).join(lasting.hint("merge"), ["project", "enum"], "left_semi")
    owner, value = F.concat(F.lit("proto_enum:"), F.col("enum")), F.concat(F.lit("enum:"), F.col("enum"), F.lit("."), F.col("value"))
    out.append(_changes(values.where(GONE), "GRPC_ENUM_REMOVED", BREAKING, "RESPONSE", owner, value))
    out.append(_changes(values.where(KEPT).where("was.number <> now.number"), "GRPC008", BREAKING, "RESPONSE", owner, value))
    return _any(out).select(*CHANGE)


def rpc_issues(model: Rpc, configs: DataFrame, calls: DataFrame) -> DataFrame:
    """(project, id, subject). configs: project, config, production, health, retries (policies),
    most_attempts, hedging, deadline. calls: project, has_deadline. GRPC001 methods of a project
    without any deadline, 002 methods that are not idempotent where something is retried, 004
    fields with a reserved number, 005 production without health checks, 007 retries without
    any deadline."""
    named = F.concat_ws("/", F.concat_ws(".", "package", "service"), "method")
    dated = configs.where("deadline").select("project").union(calls.where("has_deadline").select("project")).distinct()
    retried = configs.where("retries > 0 or hedging").select("project").distinct()
    healthy = model.services.where(F.contains("package", F.lit("grpc.health.v1")) | (F.col("service") == "Health")).select("project").distinct()

    def found(rows: DataFrame, check: str, subject: Column) -> DataFrame:
        return rows.select("project", F.lit(check).alias("id"), subject.alias("subject"))

    taken = model.fields.join(model.messages.select("project", "message", "reserved").hint("merge"), ["project", "message"]).where(F.array_contains("reserved", F.col("number")))
    repeated = configs.where("retries > 0 and (coalesce(most_attempts, 1) > 1 or hedging)")
    return _any([
        found(model.methods.join(dated.hint("merge"), "project", "left_anti"), "GRPC001", named),
        found(model.methods.where("not idempotent").join(retried.hint("merge"), "project", "left_semi"), "GRPC002", named),
        found(taken, "GRPC004", F.concat_ws(".", "message", "field")),
        found(configs.where("production and not health").join(healthy.hint("merge"), "project", "left_anti"), "GRPC005", F.col("config")),
        found(repeated.join(dated.hint("merge"), "project", "left_anti"), "GRPC007", F.col("config")),
    ])


@dataclass(frozen=True)
class Graphql:
    """types: project, type, kind (OBJECT, INTERFACE, INPUT_OBJECT, ENUM, UNION, SCALAR), directives
    (array). members: project, type, member (values of enumerations, members of unions). fields:
    project, type, field, of (base type), nullable, is_list, directives, deprecated. arguments:
    project, type, field, argument, nullable, required, has_default."""

    types: DataFrame
    members: DataFrame
    fields: DataFrame
    arguments: DataFrame


FIELDED = "('OBJECT', 'INTERFACE', 'INPUT_OBJECT')"


def graphql_changes(old: Graphql, new: Graphql) -> DataFrame:
    """Changes of types that both versions have, of the same kind. What a client reads may not
    become nullable's opposite without notice, and what it sends may not be asked for more: a field
    or an argument that must not be null any more is BREAKING on its side, and so is a new argument
    that is required; one that is not, directives and union members may break."""
    both = _met(old.types, new.types, ["project", "type"]).where(KEPT).where("was.kind = now.kind")
    kinds = both.select("project", "type", F.col("now.kind").alias("kind"))
    members = _met(old.members.withColumn("x", F.lit(0)), new.members.withColumn("x", F.lit(0)), ["project", "type", "member"]).join(kinds.hint("merge"), ["project", "type"])
    of = F.when(F.col("kind") == "ENUM", "enum").otherwise("union")
    subject, path = F.concat(of, F.lit(":"), F.col("type")), F.concat(of, F.lit(":"), F.col("type"), F.lit("."), F.col("member"))
    out = [
        _changes(members.where(GONE).where("kind = 'ENUM'"), "GQL005", BREAKING, "RESPONSE", subject, path),
        _changes(members.where(GONE).where("kind = 'UNION'"), "GQL011", BREAKING, "RESPONSE", subject, path),
        _changes(members.where(CAME).where("kind = 'UNION'"), "GQL013", POTENTIAL, "RESPONSE", subject, path),
    ]
    own = F.concat(F.lit("graphql_type:"), F.col("type"))
    marked = both.where(f"was.kind in {FIELDED} and was.directives <> now.directives")
    out.append(_changes(marked, "GQL012", POTENTIAL, "META", own, F.concat(F.lit("type:"), F.col("type"))))
    fields = _met(old.fields, new.fields, ["project", "type", "field"]).join(kinds.where(f"kind in {FIELDED}").hint("merge"), ["project", "type"])
    side, at = F.when(F.col("kind") == "INPUT_OBJECT", "REQUEST").otherwise("RESPONSE"), F.concat(F.lit("field:"), F.col("type"), F.lit("."), F.col("field"))
    kept = fields.where(KEPT)
    out += [
        _changes(fields.where(GONE), "GQL002", BREAKING, side, own, at),
        _changes(kept.where("was.nullable and not now.nullable"), "GQL004", BREAKING, side, own, at),
        _changes(kept.where("was.directives <> now.directives"), "GQL012", POTENTIAL, side, own, at),
    ]
    asked = _met(old.arguments, new.arguments, ["project", "type", "field", "argument"])
    asked = asked.join(kept.where("kind <> 'INPUT_OBJECT'").select("project", "type", "field").hint("merge"), ["project", "type", "field"], "left_semi")
    name = F.concat_ws(".", "type", "field")
    subject, at = F.concat(F.lit("graphql_field:"), name), F.concat(F.lit("argument:"), name, F.lit("("), F.col("argument"), F.lit(")"))
    tighter = asked.where(KEPT).where("was.nullable and not now.nullable and not now.has_default")
    out += [
        _changes(asked.where(CAME), "GQL003", F.when(F.col("now.required"), BREAKING).otherwise(POTENTIAL), "REQUEST", subject, at),
        _changes(tighter, "GQL004", BREAKING, "REQUEST", subject, at),
    ]
    return _any(out).select(*CHANGE)


def graphql_issues(model: Graphql, queries: DataFrame, resolvers: DataFrame, introspection: DataFrame) -> DataFrame:
    """(project, id, subject). queries: project, query, depth, touched (array of 'Type.field').
    resolvers: project, type, field, guarded. introspection: project, enabled, detail. GQL001
    deprecated fields that queries touch, 006 projects with unguarded resolvers (their number), 007
    lists without arguments that bound them, 008 types that lead back to themselves (each set once,
    by its first type) and queries deeper than DEPTH, 009 lists of types that hold more than
    scalars and enumerations (types that the schema does not define count as more), 010
    introspection that is on, or of which nothing is known."""
    name = F.concat_ws(".", "type", "field")

    def found(rows: DataFrame, check: str, subject: Column) -> DataFrame:
        return rows.select("project", F.lit(check).alias("id"), subject.alias("subject"))

    touched = queries.select("project", F.explode("touched").alias("name")).distinct()
    old = model.fields.where("deprecated").withColumn("name", name).join(touched.hint("merge"), ["project", "name"], "left_semi")
    bare = resolvers.where("not guarded").groupBy("project").agg(F.count("*").alias("n"))
    outer = model.types.where("kind in ('OBJECT', 'INTERFACE')").select("project", "type")
    lists = model.fields.where("is_list").join(outer.hint("merge"), ["project", "type"], "left_semi")
    bounded = model.arguments.where(F.col("argument").isin(*PAGES)).select("project", "type", "field").distinct()
    known = model.types.select("project", F.col("type").alias("of"), "kind")
    inner = model.fields.join(known.hint("merge"), ["project", "of"], "left")
    nested = inner.where("kind is null or kind not in ('SCALAR', 'ENUM')").select("project", F.col("type").alias("of")).distinct()
    unions = model.members.join(model.types.where("kind = 'UNION'").select("project", "type").hint("merge"), ["project", "type"], "left_semi")
    links = model.fields.select("project", "type", "of").union(unions.select("project", "type", "member"))
    links = links.join(known.select("project", "of").hint("merge"), ["project", "of"], "left_semi")
    edges = links.select(F.to_json(F.array("project", "type")).alias("source"), F.lit("HAS").alias("kind"), F.to_json(F.array("project", "of")).alias("target"))
    circles = graph.cycles(edges).select(F.from_json("circle", "array<string>").alias("c")).distinct()
    silent = model.types.select("project").distinct().join(introspection.select("project").hint("merge"), "project", "left_anti")
    return _any([
        found(old, "GQL001", F.col("name")),
        found(bare, "GQL006", F.col("n").cast("string")),
        found(lists.join(bounded.hint("merge"), ["project", "type", "field"], "left_anti"), "GQL007", name),
        circles.select(F.col("c")[0].alias("project"), F.lit("GQL008").alias("id"), F.col("c")[1].alias("subject")),
        found(queries.where(F.col("depth") > DEPTH), "GQL008", F.col("query")),
        found(lists.join(nested.hint("merge"), ["project", "of"], "left_semi"), "GQL009", name),
        found(introspection.where("enabled"), "GQL010", F.col("detail")),
        found(silent, "GQL010", F.lit("(unknown)")),
    ])

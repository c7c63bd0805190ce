"""Schemas of two contract versions compared, and shapes of schemas.

The comparison walks pairs of schema fragments from the roots down. Each round resolves one
reference, drops equal pairs, turns the rest into changes, and makes pairs of what both
sides have below; it ends when no pair is left or after DEPTH rounds. A round is one written
table, and unchanged contracts leave it at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.functions.text import drift_path
from spanloom.operators.contracts import BREAKING, CHANGE, POTENTIAL

DEPTH = 12
PAYLOAD_DEPTH = 32
COMPOSITION = ("allOf", "anyOf", "oneOf")
NODE = (
    "type string, format string, enum array<string>, required array<string>, nullable boolean, discriminator string, "
    "properties map<string,string>, items string, additionalProperties string, `$ref` string, "
    + ", ".join(f"{c} array<string>" for c in (*COMPOSITION, "not"))
)
FREE = ("true", "{}")
CHANGES = "array<struct<kind:string,classification:string,path:string>>"
BELOW = "array<struct<path:string,was:string,now:string>>"


def canonical(json: Column) -> Column:
    """The text of a JSON value with sorted keys and no spaces; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _types(node: Column) -> Column:
    """The sorted types that a node names: one, several, or none."""
    kind = node["type"]
    several = F.from_json(kind, "array<string>")
    return F.when(kind.isNull(), F.array().cast("array<string>")).when(
        kind.startswith("["), F.array_sort(several)
    ).otherwise(F.array(kind))


def _within(small: Column, big: Column) -> Column:
    """All of small in big, where an integer also is a number."""
    wide = F.transform(small, lambda t: F.when(t == "integer", "number").otherwise(t))
    return (F.size(F.array_except(small, big)) == 0) | (F.size(F.array_except(wide, big)) == 0)


def _one(when: Column, kind: Column | str, classification: str, path: Column) -> Column:
    """An array with one change if `when` holds, else an empty one."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    row = F.struct(kind.alias("kind"), F.lit(classification).alias("classification"), path.alias("path"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(row)).otherwise(F.array().cast(CHANGES))


def _each(names: Column, kind: str, classification: str, path: Column) -> Column:
    row = F.transform(
        names,
        lambda n: F.struct(F.lit(kind).alias("kind"), F.lit(classification).alias("classification"), F.concat(path, F.lit("."), n).alias("path")),
    )
    return row.cast(CHANGES)


def _found(o: Column, n: Column, path: Column, request: Column) -> Column:
    """The changes between two schema objects without composition changes, those below apart."""
    changed = F.concat(F.lit("type_changed_"), F.when(request, "request").otherwise("response"))
    was, now = _types(o), _types(n)
    typed = (F.size(was) > 0) & (F.size(now) > 0) & (was != now)
    narrower, wider = _within(now, was), _within(was, now)
    no_names = F.array().cast("array<string>")
    must_old, must = F.coalesce(o["required"], no_names), F.coalesce(n["required"], no_names)
    no_map = F.create_map().cast("map<string,string>")
    had, has = (F.array_sort(F.map_keys(F.coalesce(x["properties"], no_map))) for x in (o, n))
    gone, come = F.array_except(had, has), F.array_except(has, had)
    flips = F.coalesce(o["nullable"], F.lit(False)), F.coalesce(n["nullable"], F.lit(False))
    names = [F.from_json(x["discriminator"], "propertyName string, mapping string") for x in (o, n)]
    disc = [x["discriminator"] for x in (o, n)]
    both = disc[0].isNotNull() & disc[1].isNotNull()
    renamed = ~_same(names[0]["propertyName"], names[1]["propertyName"])
    extra = [x["additionalProperties"] for x in (o, n)]
    free = [x.isNull() | x.isin(*FREE) for x in extra]
    objects = extra[0].startswith("{") & extra[1].startswith("{")
    differ = ~_same(*extra)
    enums = o["enum"].isNotNull() & n["enum"].isNotNull()
    items = o["items"].isNull() != n["items"].isNull()

    def when(condition: Column, names: Column) -> Column:
        return F.when(condition, names).otherwise(no_names)

    return F.concat(
        _one(~_same(o["format"], n["format"]), changed, POTENTIAL, path),
        _one(typed & ((narrower & ~wider) | (narrower == wider)), changed, BREAKING, path),
        _one(typed & wider & ~narrower & ~request, "response_type_widened", POTENTIAL, path),
        _one(enums & (F.size(F.array_except(o["enum"], n["enum"])) > 0), "enum_removed", BREAKING, path),
        _one(enums & (F.size(F.array_except(n["enum"], o["enum"])) > 0), "enum_added", POTENTIAL, path),
        _each(when(request, F.array_except(must, must_old)), "request_field_required", BREAKING, path),
        _one(flips[0] & ~flips[1], changed, BREAKING, path),
        _one(~flips[0] & flips[1] & ~request, "response_type_widened", POTENTIAL, path),
        _one(disc[0].isNull() != disc[1].isNull(), changed, BREAKING, path),
        _one(both & renamed, changed, BREAKING, F.concat(path, F.lit(".discriminator"))),
        _one(both & ~renamed & ~_same(names[0]["mapping"], names[1]["mapping"]), changed, POTENTIAL, F.concat(path, F.lit(".discriminator"))),
        _each(when(~request, gone), "response_field_removed", BREAKING, path),
        _each(when(request, gone), "request_field_removed", POTENTIAL, path),
        _each(when(~request, come), "response_field_added", POTENTIAL, path),
        _each(when(request, F.array_except(come, must)), "request_field_added", POTENTIAL, path),
        _one(items, "unresolvable", "UNKNOWN", F.concat(path, F.lit("[]"))),
        _one(differ & free[0] & ~free[1], changed, BREAKING, path),
        _one(differ & free[1] & ~free[0] & ~request, "response_type_widened", POTENTIAL, path),
        _one(differ & ~free[0] & ~free[1] & ~objects, "unresolvable", "UNKNOWN", path),
    )


def _pair(path: Column, was: Column, now: Column) -> Column:
    return F.struct(path.alias("path"), was.alias("was"), now.alias("now"))


def _lists(o: Column, n: Column, path: Column, keyword: str) -> tuple[Column, Column]:
    """Whether a composition keyword cannot be paired, and its pairs in the order of their text."""
    a, b = o[keyword], n[keyword]
    broken = (a.isNull() != b.isNull()) | F.coalesce(F.size(a) != F.size(b), F.lit(False))
    pairs = F.transform(
        F.arrays_zip(F.array_sort(a).alias("was"), F.array_sort(b).alias("now")),
        lambda x, i: _pair(F.concat(path, F.lit(f".{keyword}["), i.cast("string"), F.lit("]")), x["was"], x["now"]),
    )
    return broken, F.when(a.isNotNull() & b.isNotNull() & ~broken, pairs).otherwise(F.array().cast(BELOW))


def _below(o: Column, n: Column, path: Column) -> Column:
    """Pairs of what both objects have below."""
    no_map = F.create_map().cast("map<string,string>")
    a, b = (F.coalesce(x["properties"], no_map) for x in (o, n))
    fields = F.transform(
        F.array_intersect(F.map_keys(a), F.map_keys(b)),
        lambda k: _pair(F.concat(path, F.lit("."), k), F.element_at(a, k), F.element_at(b, k)),
    )
    items = F.when(o["items"].isNotNull() & n["items"].isNotNull(), F.array(_pair(F.concat(path, F.lit("[]")), o["items"], n["items"])))
    extra = [x["additionalProperties"] for x in (o, n)]
    objects = extra[0].startswith("{") & extra[1].startswith("{") & ~extra[0].isin(*FREE) & ~extra[1].isin(*FREE)
    more = F.when(objects, F.array(_pair(F.concat(path, F.lit(".*")), *extra)))
    none = F.array().cast(BELOW)
    return F.concat(fields, F.coalesce(items, none), F.coalesce(more, none))


def schema_changes(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Changes below pairs (project, subject, side, path, was, now) of schema texts.

    side is REQUEST or RESPONSE. components: (project, name, schema) of the new version, to which
    references of both sides are resolved, one step each time one is met. A pair that is one of
    an object and nothing, or lies deeper than DEPTH, is UNKNOWN, and so is a changed composition.
    """
    known = components.groupBy("project", "name").agg(F.min(canonical(F.col("schema"))).alias("target"))
    front = pairs.select(
        "project", "subject", "side", "path", canonical(F.col("was")).alias("was"), canonical(F.col("now")).alias("now")
    )
    out = []
    for depth in range(DEPTH + 2):
        front = front.where(~_same(F.col("was"), F.col("now")))
        for side in ("was", "now"):
            ref = F.from_json(side, "`$ref` string")["$ref"]
            local = F.when(ref.startswith("#/components/schemas/"), F.element_at(F.split(ref, "/"), -1))
            target = known.select("project", F.col("name").alias("__name"), F.col("target").alias("__target"))
            front = front.withColumn("__name", local).join(target.hint("merge"), ["project", "__name"], "left")
            front = front.withColumn(side, F.coalesce("__target", side)).drop("__name", "__target")
        front = front.where(~_same(F.col("was"), F.col("now")))
        path, request = F.col("path"), F.col("side") == "REQUEST"
        o, n = F.col("o"), F.col("n")
        changed = F.concat(F.lit("type_changed_"), F.when(request, "request").otherwise("response"))
        single = (
            F.when(F.lit(depth > DEPTH) | F.col("was").isNull() | F.col("now").isNull(), _one(F.lit(True), "unresolvable", "UNKNOWN", path))
            .when(o["$ref"].isNotNull() | n["$ref"].isNotNull(), _one(~_same(o["$ref"], n["$ref"]), changed, BREAKING, path))
            .when(~(F.col("was").startswith("{") & F.col("now").startswith("{")), _one(F.lit(True), changed, BREAKING, path))
        )
        broken, lists, held = F.lit(False), [], F.lit(False)
        for keyword in COMPOSITION:
            bad, some = _lists(o, n, path, keyword)
            lists.append(F.when(~broken & ~bad, some).otherwise(F.array().cast(BELOW)))
            broken = broken | bad
        held = broken
        whole = F.when(held, _one(F.lit(True), "unresolvable", "UNKNOWN", path)).otherwise(_found(o, n, path, request))
        composed = F.concat(*lists)
        nodes = front.withColumns({"o": F.from_json("was", NODE), "n": F.from_json("now", NODE)}).withColumn("single", single)
        below = F.when(F.col("single").isNull(), F.concat(composed, F.when(held, F.array().cast(BELOW)).otherwise(_below(o, n, path))))
        nodes = nodes.select("project", "subject", "side", F.coalesce("single", whole).alias("changes"), below.alias("below"))
        nodes = settled(nodes, "schema-pairs")
        out.append(nodes.select("project", "subject", "side", F.explode("changes").alias("c")))
        front = nodes.select("project", "subject", "side", F.explode("below").alias("b")).select("project", "subject", "side", "b.*")
        if front.isEmpty():
            break
    found = reduce(DataFrame.union, out).select("project", "subject", "side", "c.*")
    return found.select(*CHANGE)


def shape(json: Column) -> Column:
    """A short token of one schema fragment: its reference, or its type, format, keywords, fields
    and required fields. The fragment is parsed once for all that is read of it."""
    keys = F.map_keys(F.from_json(json, "map<string,string>"))
    parsed = F.struct(F.from_json(json, NODE).alias("node"), keys.alias("keys"))
    return F.element_at(F.transform(F.array(parsed), lambda p: _shape(json, p["node"], p["keys"])), 1)


def _shape(json: Column, node: Column, keys: Column) -> Column:
    def part(prefix: str, names: Column, suffix: str = "") -> Column:
        return F.when(names.isNotNull(), F.concat(F.lit(prefix), F.array_join(F.array_sort(names), ","), F.lit(suffix)))

    extra = node["additionalProperties"]
    parts = F.concat_ws(
        ";",
        F.when(node["type"].isNotNull(), F.concat(F.lit("type:"), F.array_join(_types(node), "|"))),
        F.when(node["format"].isNotNull(), F.concat(F.lit("fmt:"), node["format"])),
        *(F.when(node[c].isNotNull() | F.array_contains(keys, F.lit(c)), F.lit(c)) for c in ("allOf", "anyOf", "oneOf", "not")),
        *(F.when(F.array_contains(keys, F.lit(c)), F.lit(c)) for c in ("enum", "const")),
        part("props(", F.map_keys(node["properties"]), ")"),
        F.when(node["items"].isNotNull(), F.lit("items")),
        part("req(", node["required"], ")"),
        F.when(extra == "true", "ap:free").when(extra == "false", "ap:none").when(extra.startswith("{"), "ap:schema"),
        F.when(F.array_contains(keys, F.lit("patternProperties")), F.lit("pattern-props")),
    )
    return (
        F.when(json.isin("true", "false"), F.concat(F.lit("schema:"), F.initcap(json)))
        .when(~F.coalesce(F.trim(json).startswith("{"), F.lit(False)), "schema:?")
        .when(node["$ref"].isNotNull(), F.concat(F.lit("ref:"), node["$ref"]))
        .otherwise(F.concat(F.lit("schema("), parts, F.lit(")")))
    )


def content_pairs(pairs: DataFrame, old: DataFrame, new: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Component names to compare, and changes that cannot be resolved, of parts in both versions.

    pairs: paired operations. old, new: (project, method, path, [status], schemas). Equal sets of
    referenced names are compared name by name; if one name was replaced by another, the two
    are compared; other changes of names, or of shapes without names, are UNKNOWN. The first
    table is (project, subject, side, path, was_name, now_name).
    """
    status = ["status"] if "status" in old.columns else []
    key = ["project", "method", "norm_path", *status]

    def of(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumns({"method": F.upper(F.trim("method")), "norm_path": drift_path(F.col("path"))})
        refs = F.transform("schemas", lambda s: F.from_json(s, "`$ref` string")["$ref"])
        names = F.filter(refs, lambda r: r.startswith("#/components/schemas/"))
        names = F.array_sort(F.array_distinct(F.transform(names, lambda r: F.element_at(F.split(r, "/"), -1))))
        value = F.struct(names.alias("names"), F.array_sort(F.transform("schemas", shape)).alias("shapes"))
        return rows.groupBy(*key).agg(F.min_by(value, "path").alias(name))

    both = of(old, "was").join(of(new, "now").hint("merge"), key).join(pairs.hint("merge"), key[:3])
    gone = F.array_except("was.names", "now.names")
    come = F.array_except("now.names", "was.names")
    named = (F.size("was.names") > 0) | (F.size("now.names") > 0)
    aligned = (F.size(gone) == 0) & (F.size(come) == 0) | (F.size(gone) == 1) & (F.size(come) == 1)
    base = F.concat(F.lit("response["), F.col("status"), F.lit("]")) if status else F.lit("requestBody")
    both = both.select(
        "project", "subject", F.lit(side).alias("side"), base.alias("base"), named.alias("named"), aligned.alias("aligned"),
        (F.col("was.shapes") == F.col("now.shapes")).alias("equal"),
        F.concat(
            F.transform(F.array_intersect("was.names", "now.names"), lambda x: F.struct(x.alias("was_name"), x.alias("now_name"))),
            F.when((F.size(gone) == 1) & (F.size(come) == 1), F.array(F.struct(gone[0].alias("was_name"), come[0].alias("now_name")))).otherwise(
                F.array().cast("array<struct<was_name:string,now_name:string>>")
            ),
        ).alias("compared"),
    )
    lost = both.where(F.when(F.col("named"), ~F.col("aligned")).otherwise(~F.col("equal")))
    lost = lost.select(
        "project", F.lit("unresolvable").alias("kind"), F.lit("UNKNOWN").alias("classification"), "side", "subject", F.col("base").alias("path")
    )
    todo = both.where("named and aligned").select("project", "subject", "side", "base", F.inline("compared"))
    target = F.when(F.col("was_name") == F.col("now_name"), F.col("now_name")).otherwise(F.concat("was_name", F.lit("->"), "now_name"))
    return todo.withColumn("path", F.concat("base", F.lit(":"), target)).drop("base"), lost


def payload(components: DataFrame) -> DataFrame:
    """(project, name, fields, nesting, collections) of each component schema (project, name,
    schema): its fields and arrays, and how deep they are nested, without references."""
    front = components.select("project", "name", F.lit(1).alias("depth"), F.col("schema").alias("json"))
    none, levels = F.array().cast("array<string>"), []
    for _ in range(PAYLOAD_DEPTH):
        node = F.from_json("json", NODE)
        fields = F.map_values(F.coalesce(node["properties"], F.create_map().cast("map<string,string>")))
        composed = F.concat(*(F.coalesce(node[c], none) for c in COMPOSITION))
        below = F.filter(F.concat(fields, composed, F.array_compact(F.array(node["items"]))), lambda x: x.startswith("{"))
        arrays = F.coalesce(node["type"] == "array", F.lit(False)) | node["items"].isNotNull()
        front = front.where(F.col("json").startswith("{")).select(
            "project", "name", "depth", F.size(fields).alias("n"), arrays.cast("int").alias("arrays"), below.alias("below")
        )
        front = settled(front, "payload")
        levels.append(front.drop("below"))
        front = front.select("project", "name", (F.col("depth") + 1).alias("depth"), F.explode("below").alias("json"))
        if front.isEmpty():
            break
    return reduce(DataFrame.union, levels).groupBy("project", "name").agg(
        F.sum("n").alias("fields"), F.max("depth").alias("nesting"), F.sum("arrays").alias("collections")
    )

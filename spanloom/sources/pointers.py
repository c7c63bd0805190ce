"""JSON documents as rows of their values, by JSON pointer."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled

#: Keys whose values are data, not structure, to the search for open schemas and to the
#: search for references; keys of an example's payload; keys whose values map names, where no key
#: is a keyword.
SCHEMA_DATA = ("example", "examples", "default", "enum", "const", "value", "dataValue", "serializedValue")
DATA = ("example", "default", "enum", "const")
EXAMPLE_VALUES = ("value", "dataValue", "serializedValue")
NAMED = frozenset((
    "properties", "patternProperties", "dependentSchemas", "$defs", "definitions", "content", "headers", "encoding", "links", "examples",
    "variables", "scopes", "mapping", "security", "webhooks", "pathItems", "mediaTypes",
))
DYNAMIC = ("$dynamicRef", "$recursiveRef")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
BAD_ESCAPE = re.compile(r"~(?![01])")

#: Rows that are sent at once from documents, which have some ten to hundred values each.
BATCH = 5_000
NODE = "pointer string, parent string, key string, kind string, value string, role string, plain boolean"
TEXT = json.JSONEncoder(sort_keys=True).encode
KEYWORDS = ("ref", "dynamic", "extension")
KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
INNER = {dict: "object", list: "array"}
WORDS = {None: "null", True: "true", False: "false"}
#: What a key that is no name is to the search for references.
ROLES = {"$ref": "ref"} | dict.fromkeys(DYNAMIC, "dynamic") | dict.fromkeys(DATA, "data")
INDEX = re.compile(r"0|[1-9][0-9]{0,17}")


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _role(name: str, example: bool) -> str | None:
    """What a key that is no name is to the search for references; example: its object is one of examples."""
    return ROLES.get(name) or ("extension" if name[:2] == "x-" else "data" if example and name in EXAMPLE_VALUES else None)


def _text(value: Any, role: str | None) -> str | None:
    if type(value) is str and role != "extension" or type(value) in INNER and role not in KEYWORDS:
        return value if type(value) is str else None
    return WORDS[value] if value is None or type(value) is bool else TEXT(value)


def walk(document: Any, only: str | None = None) -> list[tuple]:
    """Rows of NODE, each value once, from the root (pointer '') down. only: rows of the values of that
    key and of those directly in them alone."""
    every = only is None
    rows = [("", None, None, KINDS[type(document)], _text(document, None), None, True)] if every else []
    # value, pointer, key, key of the parent's own, whether keys here are names, role, plain, keys on the way
    stack: list[tuple] = [(document, "", None, None, False, None, True, 0)]
    while stack:
        value, pointer, key, above, name_map, role, plain, depth = stack.pop()
        depth += 1
        near = every or key == only
        if type(value) is dict:
            for name, child in value.items():
                kind = type(child)
                inner = kind in INNER and child
                if not (inner or near or name == only):
                    continue
                own = "data" if role is not None else None if name_map else _role(name, above == "examples")
                at = f"{pointer}/{escaped(name) if '/' in name or '~' in name else name}"
                seen = plain and not (depth > 3 and (name in SCHEMA_DATA or name[:2] == "x-"))  # below the root of a component
                if near or name == only:
                    rows.append((at, pointer, name, KINDS[kind], child if kind is str and own is None else _text(child, own), own, seen))
                if inner:
                    maps = role is None and not name_map and kind is dict and (name in NAMED or pointer == "/components")
                    stack.append((child, at, name, key, maps, own, seen, depth))
        elif type(value) is list:
            own = "data" if role is not None or key == "examples" else None
            for i, child in enumerate(value):
                kind, at = type(child), f"{pointer}/{i}"
                if near:
                    rows.append((at, pointer, None, KINDS[kind], _text(child, own), own, plain))
                if kind in INNER and child:
                    stack.append((child, at, None, key, key == "security" and kind is dict, own, plain, depth))
    return rows


def keywords(document: Any) -> list[tuple]:
    """The rows of walk that have the role of a keyword. None lies in a keyword's value or in data, so
    the walk ends there."""
    rows: list[tuple] = []
    stack: list[tuple] = [(document, "", None, None, False, True, 0)]
    while stack:
        value, pointer, key, above, name_map, plain, depth = stack.pop()
        depth += 1
        if type(value) is dict:
            for name, child in value.items():
                own = None if name_map else ROLES.get(name) or ("extension" if name[:2] == "x-" else None)
                if own is None:
                    if not child or type(child) not in INNER or not name_map and above == "examples" and name in EXAMPLE_VALUES:
                        continue
                elif own == "data":
                    continue
                at = f"{pointer}/{escaped(name) if '/' in name or '~' in name else name}"
                seen = plain and not (depth > 3 and (name in SCHEMA_DATA or name[:2] == "x-"))
                if own is None:
                    maps = not name_map and type(child) is dict and (name in NAMED or pointer == "/components")
                    stack.append((child, at, name, key, maps, seen, depth))
                else:
                    rows.append((at, pointer, name, KINDS[type(child)], _text(child, own), own, seen))
        elif type(value) is list and key != "examples":
            for i, child in enumerate(value):
                if child and type(child) in INNER:
                    stack.append((child, f"{pointer}/{i}", None, key, key == "security" and type(child) is dict, plain, depth))
    return rows


def additions(document: Any) -> list[tuple]:
    """The rows of walk that is_additional keeps."""
    return walk(document, "additionalProperties")


def holds(document: Any, pointer: str) -> bool:
    """Whether the document has a value at a pointer without bad escapes."""
    for step in pointer.split("/")[1:]:
        if type(document) is dict:
            key = step.replace("~1", "/").replace("~0", "~") if "~" in step else step
            if key not in document:
                return False
            document = document[key]
        elif type(document) is list and INDEX.fullmatch(step) and int(step) < len(document):
            document = document[int(step)]
        else:
            return False
    return True


def json_nodes(docs: DataFrame, kept: Callable[[tuple], bool] | None = None, rows_of: Callable[[Any], list[tuple]] = walk) -> DataFrame:
    """(project, doc, and NODE) of docs (project, doc, text): a row for every value of a document, or
    for those whose NODE is kept. rows_of: `keywords` or `additions`, where none but theirs are kept.

    value is the text of a string, the JSON of other plain values and of whole extensions, and
    null for other objects and arrays. role: "ref", "dynamic" or "extension" for such keywords,
    "data" for what lies in examples, defaults, enumerations and the like or inside a keyword's
    value, else null. plain: no key on the way from a component (/components/kind/name) is an
    extension or holds data. A text that is no JSON gives no rows; of equal keys the last counts.
    A task holds the values of one document, or BATCH of them, at a time."""

    def rows(project: str | None, doc: str | None, text: str | None) -> Iterator[tuple]:
        return ((project, doc, *row) for document in _loaded(text) for row in filter(kept, rows_of(document)))

    return _of_documents(docs, rows, f"project string, doc string, {NODE}")


def is_extension(node: tuple) -> bool:
    return node[5] == "extension"


def is_hook(node: tuple) -> bool:
    """A webhook, or an extension."""
    return node[5] == "extension" or node[1] == "/webhooks"


def is_additional(node: tuple) -> bool:
    """The rule on additional properties, or a value directly in one."""
    return node[2] == "additionalProperties" or node[1] is not None and node[1].endswith("/additionalProperties")


def _loaded(text: str | None) -> list:
    """The document of a text, or none."""
    try:
        return [json.loads(text or "")]
    except (ValueError, RecursionError):
        return []


def _of_documents(docs: DataFrame, rows: Callable[[str | None, str | None, str | None], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that each document (project, doc, text) gives; a batch is sent once it has BATCH rows."""
    fields = [c.split() for c in schema.split(", ")]
    names, types = [f[0] for f in fields], [pa.bool_() if f[1] == "boolean" else pa.string() for f in fields]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for given in batches:
            for one in zip(*(c.to_pylist() for c in given.columns), strict=True):
                found.extend(rows(*one))
                if len(found) >= BATCH:
                    yield batch(found)
                    found = []
        if found:
            yield batch(found)

    return docs.select("project", "doc", "text").mapInArrow(run, schema)


def _classified(ref: str | None, doc: str | None) -> tuple[str, str | None, str | None]:
    """The status of a reference by its form, and the document and pointer that it names."""
    if ref is None or not ref.strip():
        return "INVALID", None, None
    if SCHEME.match(ref) or ref.startswith("//"):
        return "EXTERNAL", None, None
    file, _, fragment = ref.partition("#")
    pointer = unquote(fragment)
    if pointer and not pointer.startswith("/") or BAD_ESCAPE.search(pointer):
        return "INVALID", None, None
    if not file:
        return "RESOLVED", doc, pointer
    file = unquote(file).split("?", 1)[0]
    target = posixpath.normpath(posixpath.join(posixpath.dirname(doc or ""), file))
    if file.startswith("/") or "\\" in file or target == ".." or target.startswith("../"):
        return "OUTSIDE_ROOT", None, None
    return "RESOLVED", target, pointer


def reference_sites(docs: DataFrame, written: bool = False) -> DataFrame:
    """(project, doc, pointer, ref, status, target_doc, target): every reference in docs (project, doc,
    text), at the pointer of the object that holds it. RESOLVED if the target is a value of a document of
    its project, else MISSING; EXTERNAL, OUTSIDE_ROOT, INVALID and DYNAMIC ones are not looked up.

    A target in the same text is looked up while that is walked. The others are looked up among the values of
    the documents that they name, so of all values only those are joined. written: the references
    are written first, for these steps to share."""

    def rows(project: str | None, doc: str | None, text: str | None) -> Iterator[tuple]:
        known = None not in (project, doc)
        for document in _loaded(text):
            for _, parent, _, kind, value, role, _ in keywords(document):
                if role != "extension":
                    ref = value if kind == "string" or role == "dynamic" else None
                    status, target_doc, target = _classified(ref, doc)
                    there = known and status == "RESOLVED" and target_doc == doc and holds(document, target)
                    yield project, doc, parent, ref, role, status, target_doc, target, there

    formed = _of_documents(
        docs, rows, "project string, doc string, pointer string, ref string, role string, status string, target_doc string, target string, there boolean"
    )
    formed = settled(formed, "references") if written else formed
    place = ["project", "target_doc", "target"]
    far = formed.where("role = 'ref' and status = 'RESOLVED' and not there")
    named = far.select("project", F.col("target_doc").alias("doc")).distinct()
    nodes = json_nodes(docs.join(named.hint("shuffle_hash"), ["project", "doc"], "left_semi"))
    met = nodes.select("project", F.col("doc").alias("target_doc"), F.col("pointer").alias("target")).join(
        far.select(*place).distinct().hint("merge"), place, "left_semi"
    ).distinct()
    far = far.drop("there").join(met.withColumn("there", F.lit(True)).hint("merge"), place, "left")
    near = formed.where("not (role = 'ref' and status = 'RESOLVED' and not there)")
    status = (
        F.when(F.col("role") == "dynamic", "DYNAMIC")
        .when((F.col("status") == "RESOLVED") & ~F.coalesce("there", F.lit(False)), "MISSING")
        .otherwise(F.col("status"))
    )
    found = near.unionByName(far).withColumn("status", status)
    target = (F.when(F.col("status") == "RESOLVED", F.col(c)).alias(c) for c in ("target_doc", "target"))
    return found.select("project", "doc", "pointer", "ref", "status", *target)


def extensions(nodes: DataFrame) -> DataFrame:
    """(project, doc, owner, name, kind, value): x- keywords of any JSON type, as JSON text, at the
    pointer of the object that holds them."""
    return nodes.where("role = 'extension'").select("project", "doc", F.col("parent").alias("owner"), F.col("key").alias("name"), "kind", "value")


def pointer_steps(pointer: Column) -> Column:
    """A pointer and all above it, without the root: '/a/b' -> ['/a', '/a/b']."""
    parts = F.split(F.substring(pointer, 2, 1 << 30), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(steps)


def operation_pointer(path: Column, method: Column) -> Column:
    """The pointer of an operation in its document."""
    token = F.replace(F.replace(path, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(F.lit("/paths/"), token, F.lit("/"), F.lower(method))

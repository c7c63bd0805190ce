"""Results and plans that the size of the tables must not change."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import checkpoints
from spanloom.jobs import registry
from spanloom.operators import assembly, events, graph, quality, rules, schemas, workspace
from spanloom.sources import openapi, pointers, views
from tests.test_operators import spans

SMALL = "/root/testdata/sf0.001"


def test_a_doubled_id_has_the_operation_of_its_place_on_the_path(spark):
    df = spans(
        spark,
        {"op": "root", "id": "0", "trace": "t", "ms": 9.0},
        {"op": "left", "id": "1", "parent": "0", "trace": "t", "ms": 1.0},
        {"op": "right", "id": "2", "parent": "0", "trace": "t", "ms": 5.0},
        {"op": "deep", "id": "2", "parent": "1", "trace": "t", "ms": 1.0},
    )
    assert [r.path for r in assembly.critical_paths(df).collect()] == [["root", "right"]]


def test_a_blast_radius_names_all_clients(spark):
    changes = spark.createDataFrame([("s", "BREAKING")], "subject string, classification string")
    ops = spark.createDataFrame([("s", "GET", "/a/b", ["f"])], "subject string, method string, template string, declared array<string>")
    sites = spark.createDataFrame([(i, f"c{i:02}", "GET", "/a/b") for i in range(25)], "site int, client string, site_method string, path string")
    flows = spark.createDataFrame([("f",)], "name string")
    found = events.blast_radius(changes, ops, sites, flows).collect()
    assert [(r.clients, r.sites) for r in found] == [([f"c{i:02}" for i in range(25)], 25)]


@pytest.mark.parametrize("name", ["c14_graphql_changes", "c15_rpc_changes"])
def test_contract_tables_are_not_gathered_to_be_joined(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_parts_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(views, "PARTS", 50)
    rows = views.parts(spark, SMALL)
    assert rows.rdd.getNumPartitions() == 4 and rows.distinct().count() == 200


def test_references_are_met_in_their_own_text_and_in_others(spark):
    def document(*refs: str) -> str:
        return json.dumps({"openapi": "3.0.0", "components": {"schemas": {"A": {}, "R": {"allOf": [{"$ref": r} for r in refs]}}}})

    own, gone = "#/components/schemas/A", "#/components/schemas/Gone"
    rows = [("p", "a", document(own, gone, "b#/components/schemas/A", "b#/x", "c#/x")), ("p", "b", document()), ("q", "b", '{"x":1}'), (None, "a", document(own))]
    c = openapi.explode_contracts(spark.createDataFrame(rows, "project string, doc string, text string"))
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in (c.operations, c.schemas)]
    assert not any("parse_json" in p for p in plans)  # documents are parsed once, not for every table
    for side in (c, openapi.held(c)):
        found = {(r.project, r.ref): (r.status, r.target_doc) for r in side.sites.collect()}
        assert found == {
            ("p", own): ("RESOLVED", "a"), ("p", gone): ("MISSING", None), ("p", "b#/components/schemas/A"): ("RESOLVED", "b"), ("p", "b#/x"): ("MISSING", None),
            ("p", "c#/x"): ("MISSING", None), (None, own): ("MISSING", None),
        }


@pytest.mark.parametrize(
    ("name", "tables"),
    [("c20_webhooks", ["nodes"]), ("c7_open_schemas", ["nodes"]), ("c2_reference_sites", ["references"]), ("j18_overlap_risks", ["documents"]), ("j18_cache_links", ["documents", "uses"])],
)
def test_a_rule_writes_only_what_it_reads(spark, monkeypatch, name, tables):
    made, scratch = [], checkpoints.scratch
    monkeypatch.setattr(checkpoints, "scratch", lambda session, of: made.append(of) or scratch(session, of))
    registry.QUERIES[name](spark, SMALL)
    assert made == tables


def test_only_kept_values_leave_the_walk(spark):
    text = '{"webhooks":{"h":{"post":{"x-retry":true,"a":{"additionalProperties":{}}}}}}'
    docs = spark.createDataFrame([("p", "d", text), ("p", "bad", "{")], "project string, doc string, text string")
    found = {kept.__name__: {r.pointer for r in pointers.json_nodes(docs, kept).collect()} for kept in (pointers.is_extension, pointers.is_hook, pointers.is_additional)}
    at = "/webhooks/h/post"
    assert found == {"is_extension": {f"{at}/x-retry"}, "is_hook": {"/webhooks/h", f"{at}/x-retry"}, "is_additional": {f"{at}/a/additionalProperties"}}


def test_version_pairs_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id as unit", "concat('/v', id % 3, '/a') as path")
    monkeypatch.setattr(rules, "PAIRS", 50)
    found = rules.version_pairs(rows)
    assert found.rdd.getNumPartitions() == 16  # 800 pairs
    assert {(r.earlier, r.later) for r in found.collect()} == {(a, b) for a in range(60) for b in range(60) if b % 3 == a % 3 + 1}
    assert found.count() == 800


def test_shuffles_of_contracts_grow_in_number_with_the_parts(spark, monkeypatch):
    monkeypatch.setattr(views, "PARTS", 10)
    try:
        views.parts(spark, SMALL)  # 200
        assert spark.conf.get(views.SHUFFLES) == "40"
    finally:
        spark.conf.unset(views.SHUFFLES)


def test_the_dependents_of_a_change_spread_as_one(spark, monkeypatch):
    rows = [("hub", f"d{i}", "x") for i in range(12)] + [(f"d{i}", "far", "y") for i in range(12)] + [("far", "hub", "z"), ("own", "own", "x")]
    edges = spark.createDataFrame(rows, "to_repo string, from_repo string, subject string")
    changed = spark.createDataFrame([("hub", "x"), ("own", "x"), ("lone", "x"), ("hub", "x")], "repo string, subject string")
    sizes, write = [], graph.settled

    def settled(df, name):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "settled", settled)
    got = sorted((r.repo, r.subject, r.dependent, r.hops) for r in workspace.repo_blast(edges, changed).collect() if r.dependent)
    assert got == sorted([("hub", "x", f"d{i}", 1) for i in range(12)] + [("hub", "x", "far", 2)])
    assert max(sizes) <= 13  # not what each of the twelve leads to
    assert {(r.repo, r.dependent) for r in workspace.repo_blast(edges, changed).collect() if not r.dependent} == {("own", None), ("lone", None)}


def test_a_schema_fragment_is_parsed_once_for_its_shape(spark):
    rows = [('{"type":["null","string"],"format":"f","enum":[1],"anyOf":[],"required":["b","a"],"properties":{"a":{},"b":{}},"additionalProperties":false}',),
            ("true",), ("[1]",), ('{"$ref":"#/x"}',), (None,), ("{}",)]
    found = spark.createDataFrame(rows, "s string").select(schemas.shape(F.col("s")).alias("shape"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 3  # the fragment, its keys, its type
    got = [r.shape for r in found.collect()]
    assert got[0].startswith("schema(type:") and got[0].endswith("fmt:f;anyOf;enum;props(a,b);req(a,b);ap:none)")
    assert got[1:] == ["schema:True", "schema:?", "ref:#/x", "schema:?", "schema()"]


def test_rules_of_operations_read_the_documents_once_for_each_table(spark):
    text = json.dumps({"openapi": "3.0.0", "paths": {"/a": {"get": {"responses": {}}, "put": {"responses": {"200": {"content": {"t": {}}}}}}}})
    c = openapi.explode_contracts(spark.createDataFrame([("p", "d", text)], "project string, doc string, text string"))
    found = quality.operation_issues(c)
    scans = found._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans == 7  # operations, responses, responses by operation, bodies, and three of unusual errors
    assert sorted((r.id, r.subject) for r in found.collect()) == [
        ("OAS004", "GET /a"), ("OAS004", "PUT /a"), ("OAS005", "GET /a"), ("OAS005", "PUT /a 200"), ("OAS009", "PUT /a 200"), ("OAS020", "GET /a"), ("OAS020", "PUT /a"),
    ]


def test_edges_are_made_once_for_their_cycles(spark, monkeypatch):
    made, write = [], graph.settled

    def settled(df, name):
        made.append("reverse(" in df._jdf.queryExecution().logical().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "settled", settled)
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c")], "s string, t string")
    edges = edges.select(F.reverse("s").alias("source"), F.lit("X").alias("kind"), F.reverse("t").alias("target"))
    assert {(r.node, r.circle) for r in graph.cycles(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert made[0] and not any(made[1:])


WIDE = {
    "components": {"schemas": {"A": {"x-a": {"$ref": "#/x", "x-b": 1}, "properties": {"x-n": {"$ref": "#/a~1b"}, "example": {"$ref": "#/c"}}, "additionalProperties": {"u": [True], "x-c": None}}}},
    "examples": {"e": {"value": {"$ref": "#/d"}, "additionalProperties": "s"}}, "a/b": [{"$dynamicRef": 2}, "t", 1.5, []], "": {"~": {}},
}


def test_a_walk_for_keywords_ends_in_their_values():
    rows = [row for row in pointers.walk(WIDE) if row[5] in pointers.KEYWORDS]
    assert sorted(pointers.keywords(WIDE)) == sorted(rows)
    assert {row[0] for row in rows} == {
        "/components/schemas/A/x-a", "/components/schemas/A/properties/x-n/$ref", "/components/schemas/A/properties/example/$ref",
        "/components/schemas/A/additionalProperties/x-c", "/a~1b/0/$dynamicRef",
    }
    assert pointers.keywords("$ref") == [] == pointers.keywords(None)


def test_a_walk_for_additional_properties_makes_no_other_rows():
    rows = [row for row in pointers.walk(WIDE) if pointers.is_additional(row)]
    assert sorted(pointers.additions(WIDE), key=repr) == sorted(rows, key=repr)
    assert {row[0].rsplit("/additionalProperties", 1)[1] for row in rows} == {"", "/u", "/x-c"} and len(rows) == 4


def test_a_target_is_looked_up_without_the_pointers_of_all_values():
    places = {row[0] for row in pointers.walk(WIDE)}
    assert all(pointers.holds(WIDE, at) for at in places)
    for at in ("/none", "/a~1b/00", "/a~1b/-1", "/a~1b/4", "/a~1b/1/0", "/a~1b/\u0661", "/a~1b/" + "9" * 5000, "//~0/x", "/"):
        assert pointers.holds(WIDE, at) == (at in places)


def test_only_a_text_of_json_is_walked(spark):
    docs = spark.createDataFrame([("p", "a", "null"), ("p", "b", "{"), ("p", "c", None), ("p", "d", "")], "project string, doc string, text string")
    assert [(r.doc, r.pointer, r.kind, r.value) for r in pointers.json_nodes(docs).collect()] == [("a", "", "null", "null")]
    assert pointers.json_nodes(docs, pointers.is_extension, pointers.keywords).count() == 0

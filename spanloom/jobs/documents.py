"""Queries over contract documents made of parts, and the SQL that restates them.

Every part is a contract document of two versions. What the new version changes is decided by
the part number modulo 32, so the SQL can name the changes of each case by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import contracts, drift, quality, schemas
from spanloom.sources.openapi import Contracts, explode_contracts, held, referred
from spanloom.sources.views import parts

LEAF = '{"type":"object","properties":{"z":{"type":"string"}}}'


def item(**parts: str) -> str:
    """The JSON text of the compared schema, some of its parts replaced."""
    fields = {
        "a": '{"type":"string","enum":["x","y"]}', "b": '{"type":"number","format":"float"}',
        "c": '{"type":"array","items":{"type":"integer"}}', "d": '{"$ref":"#/components/schemas/Leaf"}',
        "e": '{"type":"string","nullable":true}',
    }
    head = {"type": '"object"', "required": '["a"]', "additionalProperties": "true"}
    for name, value in parts.items():
        (head if name in ("required", "additionalProperties", "allOf", "discriminator") else fields)[name] = value
    inner = ",".join(f'"{k}":{v}' for k, v in fields.items() if v)
    outer = ",".join(f'"{k}":{v}' for k, v in head.items())
    return f'{{{outer},"properties":{{{inner}}}}}'


#: The new version's schema by case; other cases keep it.
ITEMS = {
    1: item(b=""),
    2: item(f='{"type":"string"}'),
    3: item(f='{"type":"string"}', required='["a","f"]'),
    4: item(b='{"type":"integer","format":"float"}'),
    5: item(c='{"type":"array","items":{"type":"number"}}'),
    6: item(a='{"type":"string","enum":["x","w"]}'),
    7: item(e='{"type":"string"}'),
    8: item(b='{"type":"number","format":"double"}'),
    10: item(d='{"$ref":"#/components/schemas/Gone"}'),
    11: item(additionalProperties="false"),
    12: item(allOf="[{}]"),
    13: item(b='{"type":"string","format":"float"}'),
    14: item(discriminator='{"propertyName":"a"}'),
    15: item(c='{"type":"array"}'),
}


def documents(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    k = F.col("p_partkey")
    case = k % 32

    def on(condition: Column, text: str, other: str = "") -> Column:
        return F.when(condition, text).otherwise(other)

    def only(of: int, text: str, other: str = "") -> Column:
        """text in one case of the new version."""
        return on((case == of) & F.lit(new), text, other)

    shape = reduce(lambda rest, m: F.when((case == m) & F.lit(new), ITEMS[m]).otherwise(rest), ITEMS, F.lit(item()))
    leaf = only(9, LEAF.replace("string", "integer"), LEAF)
    media = '{"schema":{"$ref":"#/components/schemas/Item"}}'
    gone = on((case == 18) & F.lit(not new), ',{"name":"old","in":"query"}')
    fresh = only(19, ',{"name":"fresh","in":"query"}')
    limit = F.concat(
        F.lit('{"name":"limit","in":"query","required":'), only(20, "true", "false"),
        F.lit(',"schema":{"type":"'), only(28, "integer", "number"), F.lit('"}}'),
    )
    text_csv = on((case == 24) & F.lit(new), "", ',"text/csv":{}')
    missing = only(23, "", ',"404":{"description":"none"}')
    bare = k % 9 == 4
    get = F.concat(
        F.lit('"get":{'), on(k % 5 != 0, '"operationId":"op', '"summary":"'), k.cast("string"), F.lit('",'),
        on(k % 3 != 0, '"tags":["t"],'), on(k % 8 == 0, '"deprecated":true,'), on(k % 16 == 0, '"x-sunset":"soon",'),
        F.lit('"parameters":['), limit, gone, fresh,
        F.lit('],"responses":{"200":{'), on(bare, "", '"description":"ok",'),
        F.lit('"content":{"application/json":' + media), text_csv, F.lit("}}"), missing, F.lit("}}"),
    )
    body = F.lit('"requestBody":{"content":{"application/json":' + media + "}},")
    with_body = F.when(((case == 21) & F.lit(not new)) | ((case == 22) & F.lit(new)), F.lit("")).otherwise(body)
    post = F.concat(
        F.lit(',"post":{'), with_body, on(k % 10 == 3, '"security":[],'), on((k % 14 == 1) & (k % 10 != 3), '"security":[{"oauth":[]}],'),
        F.lit('"responses":{"default":{"description":"any"}}}'),
    )
    methods = F.concat(get, F.when((case == 17) & F.lit(new), "").otherwise(post), only(27, ',"put":{"responses":{}}'))
    name = F.concat(F.lit("/p"), k.cast("string"), F.lit("/{id}" if not new else "/{key}"))
    path = F.when((case == 16) & F.lit(new), F.concat(name, F.lit("/moved"))).otherwise(name)
    shared = F.lit('"parameters":[{"name":"id","in":"path","required":true}],')
    secured = F.when(case == 25, F.lit(new)).when(case == 26, F.lit(not new)).otherwise(k % 4 != 0)
    text = F.concat(
        F.lit('{"openapi":"'), F.when(k % 41 == 0, "2.0.0").when(k % 43 == 0, "three").otherwise("3.0.3"),
        F.lit('","servers":[{"url":"https://api.example.com"}'), on(k % 6 == 0, ',{"url":"https://stage.example.com"}'), F.lit("],"),
        on(secured, '"security":[{"key":[]}],'), F.lit('"paths":{"'), path, F.lit('":{'), shared, methods,
        F.lit('}},"components":{"schemas":{"Leaf":'), leaf, F.lit(',"Item":'), shape,
        on(k % 7 == 0, ',"Lone":{"description":"free"}'), on(k % 13 == 0, ',"Loop":{"items":{"$ref":"#/components/schemas/Loop"}}'),
        F.lit('},"securitySchemes":{"key":{"type":"apiKey"}}}'), on(k % 37 == 0, "", "}"),
    )
    return parts(spark, sf_dir).select(k.cast("string").alias("project"), F.lit("api.json").alias("doc"), text.alias("text"))


def one(spark: SparkSession, sf_dir: str, new: bool = False) -> Contracts:
    return explode_contracts(documents(spark, sf_dir, new))


def exploded(spark: SparkSession, sf_dir: str) -> tuple[Contracts, Contracts]:
    return one(spark, sf_dir), one(spark, sf_dir, True)


def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table and part of the old documents."""
    old = referred(one(spark, sf_dir))
    names = ("operations", "parameters", "bodies", "responses", "schemas", "schemes", "requirements", "references", "servers")
    tables = [getattr(old, n).groupBy("project").agg(F.count("*").alias("n")).select("project", F.lit(n).alias("element"), "n") for n in names]
    return reduce(DataFrame.union, tables)


def content_changes(old: Contracts, new: Contracts, pairs: DataFrame) -> DataFrame:
    """The changes of parameters' and contents' schemas."""
    found, lost = [], []
    for side, a, b in (("REQUEST", old.bodies, new.bodies), ("RESPONSE", old.responses, new.responses)):
        named, open_ended = schemas.content_pairs(pairs, a, b, side)
        was = old.schemas.select("project", F.col("name").alias("was_name"), F.col("schema").alias("was"))
        now = new.schemas.select("project", F.col("name").alias("now_name"), F.col("schema").alias("now"))
        both = named.join(was.hint("merge"), ["project", "was_name"], "left").join(now.hint("merge"), ["project", "now_name"], "left")
        found.append(both.select("project", "subject", "side", "path", "was", "now"))
        lost.append(open_ended.select(*contracts.CHANGE))
    found.append(contracts.parameter_schemas(pairs, old.parameters, new.parameters))
    changes = schemas.schema_changes(reduce(DataFrame.union, found), new.schemas)
    return reduce(DataFrame.union, lost, changes)


def all_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = exploded(spark, sf_dir)
    pairs = contracts.paired(old.operations, new.operations)

    def secured(side: Contracts) -> DataFrame:
        named = contracts.keyed(side.operations).select("project", "method", "path", "identity")
        rows = side.requirements.join(named.hint("merge"), ["project", "method", "path"], "left")
        return contracts.effective_security(side.operations, rows.select("project", F.coalesce("identity", F.lit("")).alias("owner"), "schemes"))

    return reduce(DataFrame.union, [
        contracts.operation_changes(old.operations, new.operations),
        contracts.parameter_changes(pairs, old.parameters, new.parameters),
        contracts.body_changes(pairs, old.bodies, new.bodies),
        contracts.response_changes(pairs, old.responses, new.responses),
        contracts.security_changes(pairs, secured(old), secured(new)),
        content_changes(old, new, pairs),
    ])


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = exploded(spark, sf_dir)
    return content_changes(old, new, contracts.paired(old.operations, new.operations))


def compat_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.findings(all_changes(spark, sf_dir))
    return found.groupBy("id", "severity", "confidence").agg(F.count("*").alias("n"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = one(spark, sf_dir, True)
    return new.schemas.select("project", "name", schemas.shape(F.col("schema")).alias("shape"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.payload(one(spark, sf_dir, True).schemas)


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_issues(referred(one(spark, sf_dir))).select("project", "id", "severity")


def operation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.operation_issues(one(spark, sf_dir)).select("project", "id", "subject")


def security_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.security_issues(one(spark, sf_dir)).select("project", "id", "subject")


def schema_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.schema_issues(held(one(spark, sf_dir))).select("project", "id", "subject")


def environment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.lifecycle_issues(one(spark, sf_dir)).select("project", "id", "subject")


def operation_facts(c: Contracts) -> DataFrame:
    """Operations with what drift compares: parameters, schema names, statuses, security."""
    key = ["project", "method", "path"]

    def names(lists: Column) -> Column:
        refs = F.transform(lists, lambda s: F.regexp_extract(s, r'"\$ref":"#/components/schemas/([^"]+)"', 1))
        return F.array_sort(F.array_distinct(F.filter(refs, lambda r: r != "")))

    parameters = c.parameters.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "location_in", "required"))).alias("parameters"))
    bodies = c.bodies.select(*key, names(F.col("schemas")).alias("body_names"), (F.size("schemas") > 0).alias("has_body_schema"))
    good = F.when(F.col("status").startswith("2"), names(F.col("schemas"))).otherwise(F.array().cast("array<string>"))
    answers = c.responses.groupBy(*key).agg(
        F.array_sort(F.collect_list("status")).alias("statuses"), F.array_distinct(F.flatten(F.collect_list(good))).alias("response_names")
    )
    own = c.requirements.where(F.size("schemes") > 0)
    by_op = own.where("method is not null").select(*key).distinct().withColumn("own", F.lit(True))
    whole = own.where("method is null").select("project").distinct().withColumn("whole", F.lit(True))
    rows = c.operations.select(*key, "operation_id", "has_security", "deprecated")
    for table in (parameters, bodies, answers, by_op):
        rows = rows.join(table.hint("merge"), key, "left")
    rows = rows.join(whole.hint("merge"), "project", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *key, "operation_id", "deprecated", F.coalesce("parameters", F.array().cast(drift.PARAMETERS)).alias("parameters"),
        F.coalesce("body_names", none).alias("body_names"), F.coalesce("has_body_schema", F.lit(False)).alias("has_body_schema"),
        F.coalesce("response_names", none).alias("response_names"), F.coalesce("statuses", none).alias("statuses"),
        F.coalesce(F.when(F.col("has_security"), F.col("own")).otherwise(F.col("whole")), F.lit(False)).alias("secured"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that implement the old documents; the part number modulo 12 decides what differs."""
    k = F.col("p_partkey")
    r, m = k % 12, k % 32
    path = F.concat(F.lit("/p"), k.cast("string"), F.lit("/{id}"))
    secured = F.when(m == 25, False).when(m == 26, True).otherwise(k % 4 != 0)
    guarded = F.when(k % 10 == 3, False).when(k % 14 == 1, True).otherwise(secured)

    def parameter(name: str, where: str, required: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(where).alias("location_in"), required.alias("required"))

    def guard(on: Column) -> Column:
        return F.when(on, F.array(F.lit("key"))).otherwise(F.array().cast("array<string>"))

    none = F.lit(None).cast("string")
    own = parameter("id", "path", F.lit(True))
    asked = F.array(own, parameter("limit", "query", r == 6))
    asked = F.when(m == 18, F.concat(asked, F.array(parameter("old", "query", F.lit(False))))).otherwise(asked)
    codes = F.when(r == 9, F.array(F.lit("200"), F.lit("404"), F.lit("HTTP_500"))).otherwise(F.array(F.lit("200"), F.lit("404")))

    def route(method: str, at: Column, handler: str, parameters: Column, request: Column, response: Column, codes: Column, auth: Column) -> Column:
        return F.struct(
            F.lit(method).alias("method"), at.alias("path"), F.concat(F.lit(handler), k.cast("string")).alias("handler"), parameters.alias("parameters"),
            request.alias("request_schema"), response.alias("response_schema"), codes.alias("status_codes"), auth.alias("auth"),
        )

    empty, no_codes = F.array().cast(drift.PARAMETERS), F.array().cast("array<string>")
    at = F.when(r == 5, F.concat(F.lit("/q"), k.cast("string"))).otherwise(path)
    get = route("GET", at, "app.op", asked, none, F.when(r == 8, "models.Other").otherwise("models.Item"), codes, guard(secured != (r == 10)))
    post = route("post", path, "app.post", F.array(own), F.when(r == 7, "models.Other").otherwise("models.Item"), none, no_codes, guard(guarded))
    delete = route("DELETE", F.concat(F.lit("/extra"), k.cast("string")), "app.gone", empty, none, none, no_codes, no_codes)
    put = route("PUT", path, "app.put", F.array(own), none, none, no_codes, no_codes)
    every = F.array_compact(F.array(F.when(~r.isin(1, 2), get), F.when(r != 2, post), F.when(r == 3, delete), F.when(r == 4, put)))
    readable = parts(spark, sf_dir).where(k % 37 != 0)
    return readable.select(k.cast("string").alias("project"), F.explode(every).alias("route")).select("project", "route.*")


def one_sided_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, ways = operation_facts(one(spark, sf_dir)), routes(spark, sf_dir)
    return drift.one_sided(drift.pairs(ops, ways), ops, ways, "OPENAPI")


def paired_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.pair_details(drift.pairs(operation_facts(one(spark, sf_dir)), routes(spark, sf_dir)))


#: (case, kind, classification, side, operation, path) that the new documents hold. Operation: g the
#: get, p the post, u the put, and subjects and paths are filled in for each part.
CASES = """(VALUES
  (16, 'endpoint_removed', 'BREAKING', 'META', 'g', '{norm}'), (16, 'endpoint_added', 'POTENTIALLY_BREAKING', 'META', 'm', '{norm}/moved'),
  (17, 'method_removed', 'BREAKING', 'META', 'p', '{norm}'), (27, 'endpoint_added', 'POTENTIALLY_BREAKING', 'META', 'u', '{norm}'),
  (18, 'param_removed', 'BREAKING', 'REQUEST', 'g', '{path}#query/old'), (19, 'param_added_optional', 'POTENTIALLY_BREAKING', 'REQUEST', 'g', '{path}#query/fresh'),
  (20, 'param_added_required', 'BREAKING', 'REQUEST', 'g', '{path}#query/limit'), (22, 'param_removed', 'BREAKING', 'REQUEST', 'p', '{path}#requestBody'),
  (21, 'request_body_added', 'POTENTIALLY_BREAKING', 'REQUEST', 'p', '{path}#requestBody'), (23, 'status_removed', 'BREAKING', 'RESPONSE', 'g', '{path}#responses/404'),
  (24, 'content_type_removed', 'BREAKING', 'RESPONSE', 'g', '{path}#responses/200/text/csv')) v(m, kind, classification, side, op, place)"""
SCHEMA_CASES = """(VALUES
  (1, 'response_field_removed', 'BREAKING', 'RESPONSE', '.b'), (1, 'request_field_removed', 'POTENTIALLY_BREAKING', 'REQUEST', '.b'),
  (2, 'response_field_added', 'POTENTIALLY_BREAKING', 'RESPONSE', '.f'), (2, 'request_field_added', 'POTENTIALLY_BREAKING', 'REQUEST', '.f'),
  (3, 'response_field_added', 'POTENTIALLY_BREAKING', 'RESPONSE', '.f'), (3, 'request_field_required', 'BREAKING', 'REQUEST', '.f'),
  (4, 'type_changed_', 'BREAKING', 'BOTH', '.b'), (5, 'response_type_widened', 'POTENTIALLY_BREAKING', 'RESPONSE', '.c[]'),
  (6, 'enum_removed', 'BREAKING', 'BOTH', '.a'), (6, 'enum_added', 'POTENTIALLY_BREAKING', 'BOTH', '.a'), (7, 'type_changed_', 'BREAKING', 'BOTH', '.e'),
  (8, 'type_changed_', 'POTENTIALLY_BREAKING', 'BOTH', '.b'), (10, 'type_changed_', 'BREAKING', 'BOTH', '.d'), (11, 'type_changed_', 'BREAKING', 'BOTH', ''),
  (12, 'unresolvable', 'UNKNOWN', 'BOTH', ''), (13, 'type_changed_', 'BREAKING', 'BOTH', '.b'), (14, 'type_changed_', 'BREAKING', 'BOTH', ''),
  (15, 'unresolvable', 'UNKNOWN', 'BOTH', '.c[]')) v(m, kind, classification, side, place)"""
#: A document that is cut off is malformed and gives no tables.
DOCS_SQL = """docs AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS project, p_partkey % 32 AS m, '/p' || p_partkey || '/{id}' AS path,
    '/p' || p_partkey || '/{}' AS norm FROM part WHERE p_partkey % 37 <> 0),
ids AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 'operation_id:op' || k ELSE 'method_path:GET ' || path END AS g, 'method_path:POST ' || path AS p,
    'method_path:PUT /p' || k || '/{key}' AS u, CASE WHEN k % 5 <> 0 THEN 'operation_id:op' || k ELSE 'method_path:GET /p' || k || '/{key}/moved' END AS mv FROM docs)"""
SCHEMA_SQL = f"""sides AS (SELECT * FROM (VALUES ('REQUEST', 'requestBody:Item'), ('RESPONSE', 'response[200]:Item')) s(own, root)),
schema_changes AS (SELECT project, CASE WHEN v.kind = 'type_changed_' THEN v.kind || lower(own) ELSE v.kind END AS kind, v.classification, own AS side,
    CASE WHEN own = 'REQUEST' THEN p ELSE g END AS subject, root || v.place AS path
  FROM ids JOIN {SCHEMA_CASES} ON v.m = ids.m JOIN sides ON v.side IN (own, 'BOTH')
  UNION ALL SELECT project, 'type_changed_request', 'BREAKING', 'REQUEST', g, 'param:limit' FROM ids WHERE m = 28)"""
#: Security of gets: the document's; of posts none, oauth or the document's.
CHANGES_SQL = f"""{DOCS_SQL}, {SCHEMA_SQL},
plain AS (SELECT project, v.kind, v.classification, v.side, CASE op WHEN 'g' THEN g WHEN 'p' THEN p WHEN 'u' THEN u ELSE mv END AS subject,
    replace(replace(place, '{{norm}}', norm), '{{path}}', path) AS path FROM ids JOIN {CASES} ON v.m = ids.m),
auth AS (SELECT project, CASE WHEN m = 25 THEN 'auth_tightened' ELSE 'auth_loosened' END AS kind, CASE WHEN m = 25 THEN 'BREAKING' ELSE 'NON_BREAKING' END AS classification,
    'META' AS side, unnest(CASE WHEN k % 10 = 3 OR k % 14 = 1 THEN [g] ELSE [g, p] END) AS subject, path || '#security' AS path FROM ids WHERE m IN (25, 26)),
changes AS (SELECT * FROM plain UNION ALL SELECT * FROM schema_changes UNION ALL SELECT * FROM auth)"""
CATALOG = ", ".join(f"('{kind}', '{id_}', '{severity}', '{confidence}')" for kind, id_, _, severity, confidence in contracts.FINDINGS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s3_contract_elements": element_counts,
    "j2_j6_contract_diff": all_changes,
    "j5_schema_diff": schema_diff,
    "j6_compat_catalog": compat_catalog,
    "j10_one_sided_drift": one_sided_drift,
    "j11_paired_drift": paired_drift,
    "m8_schema_shapes": shapes,
    "m9_payload_shapes": payloads,
    "c1_document_issues": statuses,
    "c3_c4_operation_issues": operation_quality,
    "c5_security_issues": security_quality,
    "c7_schema_issues": schema_quality,
    "c8_lifecycle_issues": environment_quality,
}

ORACLES = {
    "s3_contract_elements": f"""WITH {DOCS_SQL} SELECT * FROM (
      SELECT project, 'operations' AS element, 2 AS n FROM docs UNION ALL SELECT project, 'parameters', CASE WHEN m = 18 THEN 4 ELSE 3 END FROM docs
      UNION ALL SELECT project, 'bodies', 1 FROM docs WHERE m <> 21 UNION ALL SELECT project, 'responses', 3 FROM docs
      UNION ALL SELECT project, 'schemas', 2 + CAST(k % 7 = 0 AS INT) + CAST(k % 13 = 0 AS INT) FROM docs UNION ALL SELECT project, 'schemes', 1 FROM docs
      UNION ALL SELECT project, 'requirements', s FROM (SELECT project, CAST(CASE m WHEN 25 THEN FALSE WHEN 26 THEN TRUE ELSE k % 4 <> 0 END AS INT) + CAST(k % 14 = 1 AND k % 10 <> 3 AS INT) AS s FROM docs) WHERE s > 0
      UNION ALL SELECT project, 'references', 2 + CAST(k % 13 = 0 AS INT) FROM docs UNION ALL SELECT project, 'servers', 1 + CAST(k % 6 = 0 AS INT) FROM docs)""",
    "j2_j6_contract_diff": f"WITH {CHANGES_SQL} SELECT project, kind, classification, side, subject, path FROM changes",
    "j5_schema_diff": f"WITH {DOCS_SQL}, {SCHEMA_SQL} SELECT * FROM schema_changes",
    "j6_compat_catalog": f"""WITH {CHANGES_SQL} SELECT id, severity, CASE WHEN classification = 'UNKNOWN' THEN 'UNKNOWN' ELSE confidence END AS confidence, count(*) AS n
      FROM changes JOIN (VALUES {CATALOG}) f(kind, id, severity, confidence) USING (kind) GROUP BY ALL""",
    "j10_one_sided_drift": f"""WITH {DOCS_SQL}, d AS (SELECT *, k % 12 AS r, '/q' || k AS q, '/extra' || k AS x FROM docs)
      SELECT project, 'DRIFT003' AS id, 'MEDIUM' AS severity, 'GET' AS method, path FROM d WHERE r = 1 OR (r = 5 AND k % 5 = 0)
      UNION ALL SELECT project, 'DRIFT001', 'HIGH', unnest(['GET', 'POST']), path FROM d WHERE r = 2
      UNION ALL SELECT project, unnest(['DRIFT002', 'DRIFT010']), 'MEDIUM', 'DELETE', x FROM d WHERE r = 3
      UNION ALL SELECT project, 'DRIFT003', 'MEDIUM', 'PUT', path FROM d WHERE r = 4
      UNION ALL SELECT project, CASE WHEN k % 5 = 0 THEN 'DRIFT002' ELSE 'DRIFT003' END, 'MEDIUM', 'GET', q FROM d WHERE r = 5""",
    "j11_paired_drift": f"""WITH {DOCS_SQL}, d AS (SELECT *, k % 12 AS r FROM docs)
      SELECT project, 'DRIFT004' AS id, 'GET' AS method, path FROM d WHERE r = 6 OR (r = 5 AND k % 5 <> 0)
      UNION ALL SELECT project, 'DRIFT005', 'POST', path FROM d WHERE r = 7 OR (m = 21 AND r <> 2)
      UNION ALL SELECT project, 'DRIFT00' || (r - 2), 'GET', path FROM d WHERE r IN (8, 9, 10)
      UNION ALL SELECT project, 'DRIFT009', 'GET', path FROM d WHERE k % 8 = 0 AND r NOT IN (1, 2) AND NOT (r = 5 AND k % 5 = 0)""",
    "m8_schema_shapes": f"""WITH {DOCS_SQL} SELECT project, 'Leaf' AS name, 'schema(type:object;props(z))' AS shape FROM docs
      UNION ALL SELECT project, 'Lone', 'schema()' FROM docs WHERE k % 7 = 0 UNION ALL SELECT project, 'Loop', 'schema(items)' FROM docs WHERE k % 13 = 0
      UNION ALL SELECT project, 'Item', 'schema(type:object;' || CASE WHEN m = 12 THEN 'allOf;' ELSE '' END || 'props(' || CASE WHEN m = 1 THEN 'a,c,d,e' WHEN m IN (2, 3) THEN 'a,b,c,d,e,f' ELSE 'a,b,c,d,e' END
        || ');req(' || CASE WHEN m = 3 THEN 'a,f' ELSE 'a' END || ');ap:' || CASE WHEN m = 11 THEN 'none' ELSE 'free' END || ')' FROM docs""",
    "m9_payload_shapes": f"""WITH {DOCS_SQL} SELECT project, 'Leaf' AS name, 1 AS fields, 2 AS nesting, 0 AS collections FROM docs
      UNION ALL SELECT project, 'Lone', 0, 1, 0 FROM docs WHERE k % 7 = 0 UNION ALL SELECT project, 'Loop', 0, 2, 1 FROM docs WHERE k % 13 = 0
      UNION ALL SELECT project, 'Item', CASE WHEN m = 1 THEN 4 WHEN m IN (2, 3) THEN 6 ELSE 5 END, CASE WHEN m = 15 THEN 2 ELSE 3 END, 1 FROM docs""",
    "c1_document_issues": """SELECT CAST(p_partkey AS VARCHAR) AS project, 'OAS001' AS id, CASE WHEN p_partkey % 37 <> 0 AND p_partkey % 41 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity
      FROM part WHERE p_partkey % 37 = 0 OR p_partkey % 41 = 0 OR p_partkey % 43 = 0""",
    "c3_c4_operation_issues": f"""WITH {DOCS_SQL} SELECT project, 'OAS004' AS id, 'GET ' || path AS subject FROM docs WHERE k % 5 = 0 UNION ALL SELECT project, 'OAS004', 'POST ' || path FROM docs
      UNION ALL SELECT project, 'OAS005', 'GET ' || path || ' 200' FROM docs WHERE k % 9 = 4 UNION ALL SELECT project, 'OAS006', 'POST ' || path FROM docs
      UNION ALL SELECT project, 'OAS020', 'GET ' || path FROM docs WHERE k % 3 = 0 UNION ALL SELECT project, 'OAS020', 'POST ' || path FROM docs""",
    "c5_security_issues": f"""WITH {DOCS_SQL}, s AS (SELECT *, CASE m WHEN 25 THEN FALSE WHEN 26 THEN TRUE ELSE k % 4 <> 0 END AS secured FROM docs)
      SELECT project, 'OAS010' AS id, 'api.json' AS subject FROM s WHERE NOT secured UNION ALL SELECT project, 'OAS011', 'oauth' FROM s WHERE k % 14 = 1 AND k % 10 <> 3
      UNION ALL SELECT project, 'OAS011', 'POST ' || path FROM s WHERE k % 10 = 3 AND secured""",
    "c7_schema_issues": f"""WITH {DOCS_SQL} SELECT project, 'OAS014' AS id, 'Lone' AS subject FROM docs WHERE k % 7 = 0 UNION ALL SELECT project, 'OAS018', 'Lone' FROM docs WHERE k % 7 = 0
      UNION ALL SELECT project, 'OAS017', 'Item' FROM docs UNION ALL SELECT project, 'OAS019', 'Loop' FROM docs WHERE k % 13 = 0""",
    "c8_lifecycle_issues": f"""WITH {DOCS_SQL} SELECT project, 'OAS015' AS id, 'GET ' || path AS subject FROM docs WHERE k % 8 = 0 AND k % 16 <> 0
      UNION ALL SELECT project, 'OAS016', 'api.json' FROM docs WHERE k % 6 = 0""",
}

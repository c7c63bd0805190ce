"""Queries over remote-procedure, graph-query and event contracts of parts, and their SQL.

Every part has a contract of each kind in two versions. What the new one changes is decided by the
part number modulo 20, so the SQL can name the changes of each case by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import channels, protocols
from spanloom.operators.channels import Events
from spanloom.operators.protocols import Graphql, Rpc
from spanloom.sources.views import parts


class Cases:
    """Rows of the parts' contracts, each there under a condition."""

    def __init__(self, spark: SparkSession, sf_dir: str, new: bool) -> None:
        self.parts, self.new = parts(spark, sf_dir), new
        self.k, self.every = F.col("p_partkey"), F.lit(True)
        self.case = self.k % 20

    def only(self, *cases: int) -> Column:
        """True in these cases of the new version."""
        return self.case.isin(*cases) & F.lit(self.new)

    def gone(self, *cases: int) -> Column:
        """True but in these cases of the new version."""
        return ~self.only(*cases)

    def old_only(self, case: int) -> Column:
        return (self.case == case) & F.lit(not self.new)

    def rows(self, columns: str, *rows: tuple) -> DataFrame:
        """A row (condition, values) of every part whose condition holds."""
        names = [c.strip().split()[0] for c in columns.split(",")]
        kinds = [c.strip().split()[1] for c in columns.split(",")]

        def lit(value: object, kind: str) -> Column:
            if isinstance(value, list):
                return F.array(*(F.lit(v) for v in value)).cast(kind)
            return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

        made = [
            F.when(condition, F.struct(*(lit(v, k).alias(n) for v, n, k in zip(values, names, kinds, strict=True))))
            for condition, *values in rows
        ]
        return self.parts.select(self.k.cast("string").alias("project"), F.explode(F.array_compact(F.array(*made))).alias("r")).select("project", "r.*")


def rpc(spark: SparkSession, sf_dir: str, new: bool) -> Rpc:
    c = Cases(spark, sf_dir, new)

    def turned(case: int, to: object, other: object) -> Column:
        return F.when(c.only(case), F.lit(to)).otherwise(F.lit(other))

    return Rpc(
        c.rows("package string, service string", (c.every, "shop", "Orders"), (c.old_only(1), "shop", "Legacy")),
        c.rows(
            "package string, service string, method string, streaming string, idempotent boolean", (c.every, "shop", "Orders", "Get", "UNARY", True),
            (c.every, "shop", "Orders", "List", turned(2, "SERVER_STREAM", "UNARY"), False), (c.old_only(3), "shop", "Orders", "Drop", "UNARY", False),
        ),
        c.rows(
            "message string, reserved array<int>, oneofs array<string>",
            (c.every, "Order", F.when(c.only(5), F.array(F.lit(4))).when(c.case == 17, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")), ["pay"]),
            (c.old_only(6), "Old", [], []),
        ),
        c.rows(
            "message string, field string, number int, type string, label string, oneof string",
            (c.every, "Order", "id", 1, F.when(c.only(9), "int64").when(c.only(10), "string").otherwise("int32"), None, None),
            (c.every, "Order", turned(8, "title", "name"), 2, "string", F.when(c.only(12), "repeated"), None),
            (c.every, "Order", "total", 3, turned(13, "fixed64", "double"), None, None),
            (c.gone(4, 5), "Order", "note", 4, "string", None, F.when(c.only(16), "pay")),
            (c.every, "Order", "card", 5, "string", None, F.when(c.gone(11), "pay")),
            (c.only(7), "Order", "cash", 6, "string", None, "pay"), (c.old_only(6), "Old", "x", 1, "bytes", None, None),
        ),
        c.rows(
            "enum string, value string, number int", (c.every, "State", "NEW", 0), (c.gone(14), "State", "DONE", 1), (c.every, "State", "OLD", turned(15, 5, 2)),
        ),
    )


def rpc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocols.rpc_changes(rpc(spark, sf_dir, False), rpc(spark, sf_dir, True))


def rpc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Cases(spark, sf_dir, False)
    configs = c.rows(
        "config string, production boolean, health boolean, retries int, most_attempts int, hedging boolean, deadline boolean",
        (c.k % 3 == 0, "prod.json", c.k % 2 == 0, c.k % 4 == 0, c.k % 5, c.k % 6, False, c.k % 7 == 0),
    )
    calls = c.rows("has_deadline boolean", (c.k % 11 == 0, True), (c.every, False))
    return protocols.rpc_issues(rpc(spark, sf_dir, False), configs, calls)


def graphql(spark: SparkSession, sf_dir: str, new: bool) -> Graphql:
    c = Cases(spark, sf_dir, new)
    none = F.array().cast("array<string>")

    def marked(case: int) -> Column:
        return F.when(c.only(case), F.array(F.lit("auth"))).otherwise(none)

    return Graphql(
        c.rows(
            "type string, kind string, directives array<string>", (c.every, "Query", "OBJECT", []),
            (c.every, "Item", F.when(c.only(14), "INTERFACE").otherwise("OBJECT"), marked(4)), (c.every, "Input", "INPUT_OBJECT", []),
            (c.every, "Kind", "ENUM", []), (c.every, "Both", "UNION", []), (c.every, "String", "SCALAR", []),
        ),
        c.rows(
            "type string, member string", (c.every, "Kind", "A"), (c.gone(1), "Kind", "B"), (c.every, "Both", "Item"), (c.gone(2), "Both", "Query"), (c.only(3), "Both", "Other"),
        ),
        c.rows(
            "type string, field string, of string, nullable boolean, is_list boolean, directives array<string>, deprecated boolean",
            (c.every, "Query", "items", "Item", True, True, [], False), (c.every, "Query", "item", "Item", True, False, [], False),
            (c.gone(5, 14), "Item", "name", "String", c.gone(7), False, marked(9), c.k % 7 == 0), (c.k % 5 == 0, "Item", "parent", "Item", True, False, [], False),
            (c.gone(6), "Input", "text", "String", c.gone(8), False, [], False),
        ),
        c.rows(
            "type string, field string, argument string, nullable boolean, required boolean, has_default boolean",
            (c.every, "Query", "items", "filter", c.gone(10, 11), c.only(10), c.only(11)), (c.k % 3 == 0, "Query", "items", "first", True, False, False),
            (c.only(12, 13), "Query", "item", "by", c.case == 13, c.case == 12, False),
        ),
    )


def graphql_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocols.graphql_changes(graphql(spark, sf_dir, False), graphql(spark, sf_dir, True))


def graphql_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Cases(spark, sf_dir, False)
    touched = F.when(c.k % 2 == 0, F.array(F.lit("Item.name"), F.lit("Query.item"))).otherwise(F.array(F.lit("Query.item")))
    queries = c.rows("query string, depth int, touched array<string>", (c.every, "q", c.k % 8, touched))
    resolvers = c.rows("type string, field string, guarded boolean", (c.every, "Query", "items", c.k % 3 == 0), (c.every, "Query", "item", c.k % 4 == 0))
    settings = c.rows("enabled boolean, detail string", (c.k % 6 < 2, c.k % 6 == 0, "config"))
    return protocols.graphql_issues(graphql(spark, sf_dir, False), queries, resolvers, settings)


PLAIN = '{"type":"object","properties":{"a":{"type":"string"}}}'
OTHER = PLAIN.replace("string", "integer")
COMPOSED = PLAIN.replace('"properties"', '"allOf":[{}],"properties"')


def events(spark: SparkSession, sf_dir: str, new: bool) -> Events:
    c = Cases(spark, sf_dir, new)
    none = F.array().cast("array<string>")

    def some(condition: Column, value: str) -> Column:
        return F.when(condition, F.array(F.lit(value))).otherwise(none)

    name = F.when(c.only(1), "orders2").otherwise("orders")
    markers = F.when(c.k % 3 == 0, F.array(F.lit("x-retry"))).when(c.k % 3 == 1, F.array(F.lit("x-Retry"), F.lit("x-dlq"))).otherwise(F.array(F.lit("Partition")))
    third = (c.gone(6), "/m/3", None, F.when(c.only(7), "$h#/c"), None, F.when(c.only(12), "string"), F.when(c.only(9), "text/plain"), some(c.only(10), "amqp"))
    return Events(
        c.rows(
            "pointer string, channel string, bindings array<string>, markers array<string>, messages array<string>",
            (c.every, "/channels/orders", name, some((c.k % 2 == 0) | c.only(13), "kafka"), markers, some(c.k % 5 != 0, "/m/1")),
            (c.k % 5 == 0, "/channels/quiet", "quiet", [], [], ["/m/3"]),
        ),
        c.rows(
            "operation string, action string, at string, messages array<string>, bindings array<string>, markers array<string>",
            (c.gone(3), "pub", "SEND", "/channels/orders", ["/m/1"], some(c.only(5), "mqtt"), some(c.k % 4 == 0, "acks")),
            (c.k % 3 != 1, "sub", "RECEIVE", "/channels/orders", ["/m/2"], ["amqp"], ["retries"]),
            (c.every, "audit", F.when(c.only(4), "SEND").otherwise("RECEIVE"), "/channels/none", [], ["amqp"], []),
        ),
        c.rows(
            "pointer string, name string, correlation string, payload string, shape string, content_type string, bindings array<string>",
            (c.every, "/m/1", "Order", F.when(c.k % 2 == 0, "$h#/id"), '{"$ref":"#/components/schemas/Order"}', None, None, []),
            (c.every, "/m/2", "Seen", "x", F.when(c.only(11), COMPOSED).when(c.k % 6 == 0, OTHER).otherwise(PLAIN), None, None, []), third,
            (c.every, "/m/4", "Twin", "x", PLAIN, None, None, []), (c.every, "/m/5", "Twin", "x", F.when(c.k % 9 == 0, OTHER).otherwise(PLAIN), None, None, []),
        ),
        c.rows("name string, schema string", (c.every, "Order", F.when(c.only(8), OTHER).otherwise(PLAIN))),
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.event_changes(events(spark, sf_dir, False), events(spark, sf_dir, True))


def event_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.event_issues(events(spark, sf_dir, False))


def _cases(rows: str) -> str:
    """Changes by case: 'case kind class side subject path', a line each; class B breaks, P may."""
    found = []
    for line in rows.strip().splitlines():
        case, kind, what, side, subject, path = line.split()
        found.append(f"({case}, '{kind}', '{'BREAKING' if what == 'B' else 'POTENTIALLY_BREAKING'}', '{side}', '{subject}', '{path}')")
    return f"""SELECT CAST(p_partkey AS VARCHAR) AS project, kind, classification, side, subject, path
      FROM part JOIN (VALUES {", ".join(found)}) v(m, kind, classification, side, subject, path) ON v.m = p_partkey % 20"""


def _findings(*rows: tuple[str, str, str]) -> str:
    """(condition on k, id, subject expression), each a finding of every part that meets it."""
    return " UNION ALL ".join(f"SELECT CAST(k AS VARCHAR) AS project, '{check}' AS id, {subject} AS subject FROM (SELECT p_partkey AS k FROM part) WHERE {condition}" for condition, check, subject in rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "c15_rpc_changes": rpc_changes,
    "c15_rpc_issues": rpc_issues,
    "c14_graphql_changes": graphql_changes,
    "c14_graphql_issues": graphql_issues,
    "c13_event_changes": event_changes,
    "c13_event_issues": event_issues,
}

DATED = "(k % 11 = 0 OR (k % 3 = 0 AND k % 7 = 0))"
ORACLES = {
    "c15_rpc_changes": _cases("""
        1 GRPC_RENAME B RESPONSE grpc_service:shop.Legacy service:shop.Legacy
        2 GRPC006 B RESPONSE grpc_method:shop.Orders/List method:shop.Orders/List
        3 GRPC_METHOD_REMOVED B RESPONSE grpc_service:shop.Orders method:shop.Orders/Drop
        4 GRPC003 B RESPONSE proto_message:Order field:Order.note
        5 GRPC003 P RESPONSE proto_message:Order field:Order.note
        6 GRPC_FIELD_REMOVED B RESPONSE proto_message:Old message:Old
        7 GRPC009 P RESPONSE proto_message:Order oneof:Order.pay.cash
        8 GRPC004 B RESPONSE proto_message:Order field:Order#2
        9 GRPC_TYPE_CHANGED P RESPONSE proto_message:Order field:Order.id
        10 GRPC_TYPE_CHANGED B RESPONSE proto_message:Order field:Order.id
        11 GRPC009 B RESPONSE proto_message:Order field:Order.card
        12 GRPC_TYPE_CHANGED P RESPONSE proto_message:Order field:Order.name
        13 GRPC_TYPE_CHANGED P RESPONSE proto_message:Order field:Order.total
        14 GRPC_ENUM_REMOVED B RESPONSE proto_enum:State enum:State.DONE
        15 GRPC008 B RESPONSE proto_enum:State enum:State.OLD
        16 GRPC009 B RESPONSE proto_message:Order field:Order.note
        16 GRPC009 P RESPONSE proto_message:Order oneof:Order.pay.note"""),
    "c15_rpc_issues": _findings(
        (f"NOT {DATED}", "GRPC001", "'shop.Orders/Get'"), (f"NOT {DATED}", "GRPC001", "'shop.Orders/List'"), (f"NOT {DATED} AND k % 20 = 3", "GRPC001", "'shop.Orders/Drop'"),
        ("k % 3 = 0 AND k % 5 > 0", "GRPC002", "'shop.Orders/List'"), ("k % 3 = 0 AND k % 5 > 0 AND k % 20 = 3", "GRPC002", "'shop.Orders/Drop'"),
        ("k % 20 = 17", "GRPC004", "'Order.name'"), ("k % 3 = 0 AND k % 2 = 0 AND k % 4 <> 0", "GRPC005", "'prod.json'"),
        (f"k % 3 = 0 AND k % 5 > 0 AND k % 6 > 1 AND NOT {DATED}", "GRPC007", "'prod.json'"),
    ),
    "c14_graphql_changes": _cases("""
        1 GQL005 B RESPONSE enum:Kind enum:Kind.B
        2 GQL011 B RESPONSE union:Both union:Both.Query
        3 GQL013 P RESPONSE union:Both union:Both.Other
        4 GQL012 P META graphql_type:Item type:Item
        5 GQL002 B RESPONSE graphql_type:Item field:Item.name
        6 GQL002 B REQUEST graphql_type:Input field:Input.text
        7 GQL004 B RESPONSE graphql_type:Item field:Item.name
        8 GQL004 B REQUEST graphql_type:Input field:Input.text
        9 GQL012 P RESPONSE graphql_type:Item field:Item.name
        10 GQL004 B REQUEST graphql_field:Query.items argument:Query.items(filter)
        12 GQL003 B REQUEST graphql_field:Query.item argument:Query.item(by)
        13 GQL003 P REQUEST graphql_field:Query.item argument:Query.item(by)"""),
    "c14_graphql_issues": _findings(
        ("k % 7 = 0 AND k % 2 = 0", "GQL001", "'Item.name'"), ("k % 3 <> 0 OR k % 4 <> 0", "GQL006", "CAST(CAST(k % 3 <> 0 AS INT) + CAST(k % 4 <> 0 AS INT) AS VARCHAR)"),
        ("k % 3 <> 0", "GQL007", "'Query.items'"), ("k % 5 = 0", "GQL008", "'Item'"), ("k % 8 > 5", "GQL008", "'q'"), ("k % 5 = 0", "GQL009", "'Query.items'"),
        ("k % 6 = 0", "GQL010", "'config'"), ("k % 6 > 1", "GQL010", "'(unknown)'"),
    ),
    "c13_event_changes": f"""SELECT * FROM ({_cases('''
        1 ASYNC009 B RESPONSE async_channel:orders channel:orders
        1 ASYNC010 P RESPONSE async_channel:orders2 channel:orders2
        3 ASYNC011 B RESPONSE async_operation:pub operation:pub
        4 ASYNC012 B META async_operation:audit operation:audit.action
        5 ASYNC017 P META async_operation:pub operation:pub.bindings
        6 ASYNC014 B RESPONSE message:/m/3 message:/m/3
        7 ASYNC013 B REQUEST message:/m/3 message:/m/3.correlationId
        8 ASYNC015 B RESPONSE message:Order message:Order.payload
        9 ASYNC016 P RESPONSE message:/m/3 message:/m/3.contentType
        10 ASYNC017 P META message:/m/3 message:/m/3.bindings
        12 ASYNC015 B RESPONSE message:/m/3 message:/m/3.payload
        13 ASYNC017 P META async_channel:orders channel:orders.bindings''')})
      UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'ASYNC015', 'POTENTIALLY_BREAKING', 'RESPONSE', 'message:Seen', 'message:Seen.payload' FROM part WHERE p_partkey % 20 = 11""",
    "c13_event_issues": _findings(
        ("k % 5 = 0", "ASYNC001", "'quiet'"), ("k % 2 <> 0", "ASYNC002", "'Order'"), ("TRUE", "ASYNC002", "'/m/3'"),
        ("k % 3 <> 1 AND k % 6 = 0", "ASYNC003", "'orders'"), ("k % 3 = 0", "ASYNC004", "'orders'"), ("k % 3 <> 1", "ASYNC004", "'sub'"),
        ("k % 2 = 0 AND k % 3 <> 2", "ASYNC005", "'orders'"), ("k % 9 = 0", "ASYNC006", "'Twin'"), ("k % 3 = 1", "ASYNC007", "'orders'"), ("k % 4 <> 0", "ASYNC008", "'pub'"),
    ),
}

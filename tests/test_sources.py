"""Readers and writers on files made here."""

import json

from pyspark.sql import functions as F

from spanloom.operators import assembly
from spanloom.sources import logs, sinks


def test_access_log(spark, tmp_path):
    lines = [
        '1.1.1.1 - - [10/Oct] "GET /a?x=1 HTTP/1.1" 200 512 "-" "x-request-id: abc-1"',
        '1.1.1.1 - - [10/Oct] "POST /b HTTP/1.1" 503 0',
        '[2024-01-01] "GET /c HTTP/1.1" 404 -',
        "# a comment",
    ]
    (tmp_path / "log").write_text("\n".join(lines))
    got = logs.read_access_log(spark, str(tmp_path / "log")).orderBy("path").collect()
    assert [(r.method, r.path, r.status, r.request_id, r.bytes_sent) for r in got] == [
        ("GET", "/a?x=1", 200, "abc-1", 512), ("POST", "/b", 503, None, 0), ("GET", "/c", 404, None, None)
    ]
    assert logs.executions_of_summaries(logs.read_access_log(spark, str(tmp_path / "log"))).count() == 3


def test_trace_export(spark, tmp_path):
    def attributes(**values):
        return [{"key": k.replace("_", "."), "value": {"stringValue": v}} for k, v in values.items()]

    spans = [
        {"traceId": "t", "spanId": "1", "name": "n", "kind": 2, "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "attributes": attributes(http_route="/r", api_key="secret"), "status": {"code": 2}},
        {"traceId": "t", "spanId": "2", "parentSpanId": "1", "name": "", "kind": 3, "startTimeUnixNano": "0", "endTimeUnixNano": "0", "attributes": attributes(rpc_service="S", rpc_method="M")},
        {"traceId": "", "spanId": "3", "name": "", "kind": 99, "attributes": []},
    ]
    doc = {"resourceSpans": [{"resource": {"attributes": attributes(service_name="shop")}, "scopeSpans": [{"spans": spans}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc) + "\n" + json.dumps({"other": 1}))
    got = {r.span_id: r for r in logs.read_otlp(spark, str(tmp_path / "x.json")).collect()}
    assert len(got) == 3
    assert (got["1"].service, got["1"].operation, got["1"].duration_ms, got["1"].kind, got["1"].status) == ("shop", "/r", 2.0, "server", "error")
    assert got["1"].attributes["api.key"] == "[REDACTED]"
    assert (got["2"].operation, got["2"].start_unix_nano, got["2"].duration_ms, got["2"].kind) == ("S/M", None, None, "client")
    assert (got["3"].operation, got["3"].trace_id, got["3"].kind) == ("(unnamed)", None, "internal")


def test_offsets_are_a_spans_own(spark, tmp_path):
    """Several scopes and lines of one file, and files cut into parts: no two spans share an offset, and
    calls of executions of one name are told apart."""
    def span(i, kind, parent=""):
        return {"traceId": "t", "spanId": str(i), "parentSpanId": parent, "name": "same", "kind": kind}

    def line(*scopes):
        return json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": list(s)} for s in scopes]}]})

    lines = [line([span(f"a{n}", 2), span(f"b{n}", 2, "x")], [span(f"c{n}", 2, "x"), span(f"d{n}", 3, f"c{n}")]) for n in range(300)]
    (tmp_path / "x.json").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.read_otlp(spark, str(tmp_path / "x.json"))
        assert rows.rdd.getNumPartitions() > 3
        found = sorted((r.source_offset, r.span_id) for r in rows.collect())
        calls = assembly.call_counts(assembly.executions(assembly.placed(rows)), assembly.downstream_calls(assembly.placed(rows)))
        assert calls.where("calls > 0").count() == 300 and calls.count() == 900
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [i for _, i in found] == [f"{c}{n}" for n in range(300) for c in "abcd"]
    assert len({at for at, _ in found}) == 1200


def test_protocols(spark):
    """What a call's attributes tell of its protocol, the first that is there."""
    cases = [
        ({"rpc.system": "grpc", "http.url": "u"}, "client", "grpc"), ({"messaging.system": "kafka"}, "producer", "kafka"),
        ({"network.protocol.name": "http", "network.protocol.version": "2"}, "client", "http/2"), ({"network.protocol.name": "amqp"}, "client", "amqp"),
        ({"http.url": "u"}, "client", "http"), ({"url.full": "u"}, "client", "http"), ({"http.url": "u"}, "server", None), ({"rpc.system": ""}, "client", None),
    ]
    df = spark.createDataFrame([(i, a, k) for i, (a, k, _) in enumerate(cases)], "i int, attributes map<string,string>, kind string")
    found = df.select("i", assembly.protocol(F.col("attributes"), F.col("kind")).alias("p")).orderBy("i").collect()
    assert [r.p for r in found] == [want for _, _, want in cases]


def test_ordered_files(spark, split, tmp_path):
    """Lines in order over many files, with ties and nulls; places are those of a plain sort."""
    rows = [(None if i % 7 == 0 else f"id{i % 50:02d}", [f"e{i % 3}"], f"t{i}") for i in range(2_000)] + [("id01", ["e1"], "same")] * 500
    df = spark.createDataFrame(rows, "id string, entity_ids array<string>, title string").repartition(5)
    sinks.write_findings(df, str(tmp_path / "f"))
    got = sinks.read_ordered(spark, str(tmp_path / "f")).orderBy("at").collect()
    assert [r.at for r in got] == list(range(2_500))
    read = [json.loads(r.value) for r in got]
    keys = [(r.get("id") is not None, r.get("id") or "", r["entity_ids"], r["title"]) for r in read]
    assert keys == sorted(keys)
    files = [json.loads(p) for f in sorted((tmp_path / "f-files").glob("part-*")) for p in f.read_text().splitlines()]
    assert len(files) > 1 and sum(f["lines"] for f in files) == 2_500 and [f["file"] for f in files] == sorted(f["file"] for f in files)
    text = "".join((tmp_path / "f" / f["file"]).read_text() for f in files).splitlines()
    assert text == [r.value for r in got]


def test_history_is_read_in_order(spark, tmp_path):
    rows = [(f"r{i}", None, "s" if i % 2 else None, "op", None if i % 5 == 0 else 1_700_000_000_000_000_000 + (i * 37 % 11) * 3_600_000_000_000) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id string, trace_id string, service string, operation string, start_unix_nano long")
    sinks.write_history(df, str(tmp_path / "h"))
    got = [(r.start_unix_nano or 0, r.request_id) for r in sinks.read_history(spark, str(tmp_path / "h")).collect()]
    assert got == sorted(got) and len(got) == 60
    one = sinks.read_history(spark, str(tmp_path / "h"), service="s", window="2023-11-14T22").collect()
    assert one and all(r.service == "s" and r.window == "2023-11-14T22" for r in one)


def test_a_reader_of_ones_own(spark, tmp_path):
    """A format that a user registers is found by its name and gives rows like the others."""
    @logs.reader("semicolons")
    def read(session, path):
        parts = F.split("value", ";")
        return session.read.text(path).select(parts[0].alias("method"), parts[1].alias("path"), parts[2].cast("int").alias("status"))

    (tmp_path / "x").write_text("GET;/a;200\nPOST;/b;500")
    assert [tuple(r) for r in logs.READERS["semicolons"](spark, str(tmp_path / "x")).collect()] == [("GET", "/a", 200), ("POST", "/b", 500)]
    assert {"otlp-json", "access-log"} < set(logs.READERS)
    del logs.READERS["semicolons"]


def test_sinks(spark, tmp_path):
    rows = [("A1", "HIGH", "HIGH", "s", 3, "two\n words", "p", "t"), ("A2", "LOW", "LOW", "s", None, "x", None, "u")]
    df = spark.createDataFrame(rows, "id string, severity string, confidence string, subject string, line int, description string, path string, title string")
    assert [r.value for r in sinks.agent_lines(df).collect()] == ["A1|HIGH|HIGH|s:3|two words", "A2|LOW|LOW|s|x"]
    assert [tuple(r) for r in sinks.sarif_results(df).collect()] == [("A1", "error", "p", 3)]
    assert sinks.sarif_skipped(df).first().skipped == 1 and sinks.sarif_rules(df).count() == 2
    sinks.write_findings(df, str(tmp_path / "f"))
    assert len(spark.read.text(str(tmp_path / "f")).collect()) == 2

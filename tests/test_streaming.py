"""Streams in several batches: late rows, caps, state that shrinks, and any order of input."""

import random

from pyspark.sql import functions as F

from spanloom.streaming import jobs

SPAN = "trace_id string, span_id string, parent_id string, status string, duration_ms double, ts timestamp"


def rows(*spans):
    """(trace, id, parent, second) with a fixed status and duration."""
    return [(t, i, p, "error" if i == "2" else "ok", float(s + 1), s) for t, i, p, s in spans]


def stream(spark, folder, *batches):
    """A stream of one file a batch, in order."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "trace_id string, span_id string, parent_id string, status string, duration_ms double, s long")
        df.withColumn("ts", at).drop("s").coalesce(1).write.parquet(f"{folder}/batch{n}")
    return spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def traces(found):
    return {r.trace_id: (r.span_count, r.errors, r.duration_ms, r.incomplete, r.cut) for r in jobs.assembled(found.rows).collect()}


def test_late_spans_are_counted_and_state_shrinks(spark, tmp_path):
    first = rows(("a", "1", None, 0), ("a", "2", "1", 5))
    second = rows(("b", "1", None, 4000))
    third = rows(("b", "2", "1", 4001))  # closes a
    fourth = rows(("a", "3", "1", 6), ("c", "1", "lost", 4002))
    got = jobs.drained(stream(spark, f"{tmp_path}/s", first, second, third, fourth), jobs.trace_pieces, "t")
    assert traces(got) == {"a": (2, 1, 6.0, False, 0), "b": (2, 1, 4002.0, False, 0), "c": (1, 0, 4003.0, True, 0)}
    assert got.late == 2  # the span and its reference to a parent
    assert got.state[-1] == 0 and min(got.state[2:4]) < got.state[1] + 1


def test_spans_beyond_the_cap_are_counted(spark, tmp_path):
    spans = rows(("a", "0", None, 0), *(("a", str(i), "0", i) for i in range(1, 8)))
    got = jobs.drained(stream(spark, f"{tmp_path}/s", spans[:4], spans[4:]), lambda s: jobs.trace_pieces(s, cap=5), "t")
    assert traces(got) == {"a": (8, 1, 8.0, False, 3)}


def test_any_order_and_batches_give_the_same(spark, tmp_path):
    """Also for spans without a trace, which are dealt to several states."""
    spans = rows(*((None, str(i), str(i // 2) if i else None, i) for i in range(30)), *(("t", str(i), "0" if i else None, i) for i in range(9)))
    whole = traces(jobs.drained(stream(spark, f"{tmp_path}/one", spans), jobs.trace_pieces, "t"))
    random.Random(1).shuffle(spans)
    parts = traces(jobs.drained(stream(spark, f"{tmp_path}/three", spans[:13], spans[13:20], spans[20:]), jobs.trace_pieces, "t"))
    assert whole == parts == {"(none)": (30, 1, 30.0, False, 0), "t": (9, 1, 9.0, False, 0)}


def test_spans_of_closed_traces_are_late_and_change_nothing(spark, tmp_path):
    """A span that Spark still takes, of a trace that was complete and is closed: counted as late;
    after the memory of closed traces has run out, the trace opens anew, and that is counted."""
    first = rows(("a", "1", None, 0), ("a", "2", "1", 5))
    second = rows(("b", "1", None, 1300))
    third = rows(("b", "2", "1", 1301))  # the watermark is at 700 now: a closes
    fourth = rows(("a", "3", "2", 705), ("a", "4", "lost", 706), ("b", "3", "1", 1302))

    def run(name, **options):
        got = jobs.drained(stream(spark, f"{tmp_path}/{name}", first, second, third, fourth), lambda s: jobs.trace_pieces(s, **options), name)
        assert got.late == 0 and got.state[-1] == 0
        return {r.trace_id: (r.span_count, r.errors, r.incomplete, r.late, r.forgotten) for r in jobs.assembled(got.rows).collect()}

    assert run("kept") == {"a": (2, 1, False, 2, 1), "b": (3, 1, False, 0, 1)}
    assert run("forgotten", remember_s=0) == {"a": (4, 1, True, 0, 2), "b": (3, 1, False, 0, 1)}


def test_state_grows_by_span_and_batches_cost_what_they_bring(spark, tmp_path):
    """A piece beyond any former cap: its parents are all found, and the rows of state are its ids."""
    size, parts = 3_000, 4
    spans = rows(*(("t", str(i), str(i - 1) if i else None, i % 50) for i in range(size)))
    batches = [spans[k::parts] for k in range(parts)]
    got = jobs.drained(stream(spark, f"{tmp_path}/s", *batches), jobs.trace_pieces, "t")
    assert traces(got) == {"t": (size, 1, 50.0, False, 0)}
    assert max(got.state) >= size and got.state[-1] == 0

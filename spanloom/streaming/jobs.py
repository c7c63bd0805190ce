"""Structured Streaming forms of trace assembly and hourly aggregation.

Streams run in append mode: a result is written once, when the watermark has passed its end,
and its state is dropped then. Rows that come later than that are left out and counted by
Spark (late_rows). A bounded stream is closed by a mark, a row with an event time beyond all
others that a second source brings once the data has been read. Traces also remember that
they were closed, so spans that Spark takes but that come after that are counted, not assembled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanloom.functions.checkpoints import scratch
from spanloom.functions.stats import aggregate_error
from spanloom.operators.assembly import TRACELESS, span_counters

END = "2200-01-01 00:00:00"  # the event time of a mark
PIECES = 64  # parts into which the spans without a trace are dealt
SUMS = "last long, spans long, errors long, longest double, roots long, selves long, lost long, closed boolean"
PIECE = (
    "trace_id string, piece int, span_count long, errors long, duration_ms double, roots long, selves long, lost long, cut long, "
    "late long, forgotten long"
)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hourly(executions: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Per hour, service and operation: requests, errors, timeouts and an approximate p95, of a
    stream or a table of executions with the event time `at`."""
    return (
        executions.withWatermark(at, delay)
        .groupBy(F.window(at, "1 hour").alias("hour"), "service", "operation")
        .agg(
            F.count("*").alias("requests"),
            F.count_if(aggregate_error(F.col("status"))).alias("errors"),
            F.count_if("timed_out").alias("timeouts"),
            F.percentile_approx("duration_ms", 0.95).alias("p95"),
        )
        .select(F.col("hour.start").alias("hour"), "service", "operation", "requests", "errors", "timeouts", "p95")
    )


class TracePieces(StatefulProcessor):
    """Folds the spans of a piece into sums and one state entry per span id, so a batch costs what
    it brings. A closed piece leaves its sums as a mark for `remember_ms`: spans that come in
    that time are counted as late and change nothing; then it is forgotten, which is counted."""

    def __init__(self, at: str, gap_ms: int, remember_ms: int, cap: int | None) -> None:
        self.at, self.gap_ms, self.remember_ms, self.cap = at, gap_ms, remember_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS)
        self.nodes = handle.getMapState("nodes", "id string", "own boolean, ref boolean")

    def _row(self, key: tuple, *values: Any) -> pd.DataFrame:
        return pd.DataFrame([(*key, *values)], columns=[c.split()[0] for c in PIECE.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        own = batch[batch["own"]]
        old = self.sums.get()
        if old is not None and old[7]:
            if len(own):
                yield self._row(key, 0, 0, 0.0, 0, 0, 0, 0, len(own), 0)
            return
        last, spans, errors, longest, roots, selves, lost, _ = old or (0, 0, 0, 0.0, 0, 0, 0, False)
        last = max(last, int(batch[self.at].max().timestamp() * 1000))
        errors += int(own["error"].fillna(False).sum())
        longest = max(longest, float(own["ms"].max()) if len(own) else 0.0)
        spans, roots, selves = spans + len(own), roots + int(own["root"].sum()), selves + int(own["self"].sum())
        for node, flags in batch.dropna(subset=["node"]).groupby("node")["own"]:
            had = self.nodes.getValue((node,)) if old is not None and self.nodes.containsKey((node,)) else (False, False)
            now = (had[0] or bool(flags.any()), had[1] or not bool(flags.all()))
            lost += (now[1] and not now[0]) - (had[1] and not had[0])
            if now != had:
                self.nodes.updateValue((node,), now)
        self.sums.update((last, spans, errors, longest, roots, selves, int(lost), False))
        if old is None:
            self.handle.registerTimer(max(last + self.gap_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, spans, errors, longest, roots, selves, lost, closed = self.sums.get()
        now = timerValues.getCurrentWatermarkInMs()
        until = last + self.gap_ms
        if not closed and until > now:  # spans have come since the timer was set
            self.handle.registerTimer(until)
            return
        forget = closed or until + self.remember_ms <= now
        if not closed:
            cut = max(0, spans - self.cap) if self.cap is not None else 0
            yield self._row(key, spans, errors, longest, roots, selves, lost, cut, 0, int(forget))
            self.nodes.clear()
            if not forget:
                self.sums.update((last, 0, 0, 0.0, 0, 0, 0, True))
                self.handle.registerTimer(until + self.remember_ms)
        else:
            yield self._row(key, 0, 0, 0.0, 0, 0, 0, 0, 0, 1)
        if forget:
            self.sums.clear()

    def close(self) -> None:
        pass


def trace_pieces(
    spans: DataFrame, at: str = "ts", gap_s: int = 600, delay: str = "10 minutes", cap: int | None = None,
    pieces: int = PIECES, remember_s: int = 86_400,
) -> DataFrame:
    """Rows of the pieces of traces (see PIECE); `assembled` makes traces of them.

    A trace is one piece; the bucket of spans without a trace is dealt to `pieces` of them by
    span id, and a parent is looked for in the piece of its id, so no state holds the bucket.
    A piece closes when the watermark is `gap_s` behind its last span. For `remember_s` of event
    time after that, its spans are counted as `late` in rows of their own and the trace stays as
    it was; later ones would open it anew, and `forgotten` counts the pieces that this can happen
    to. `cut` counts the spans of a piece beyond `cap`, which a reader of spans would leave out.

    State is a row per span id in a store on disk, so a piece may be of any size. The session's
    state store becomes RocksDB, which states of this kind need.
    """
    spans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = spans.withColumns(
        {"id": F.nullif("span_id", F.lit("")), "parent": F.nullif("parent_id", F.lit("")),
         "trace": F.coalesce(F.nullif("trace_id", F.lit("")), F.lit(TRACELESS))}
    ).withWatermark(at, delay).where(F.col(at) < END)  # a mark only moves the watermark

    def piece(of: str) -> F.Column:
        return F.when(F.col("trace") == TRACELESS, F.pmod(F.xxhash64(F.coalesce(of, F.lit(""))), F.lit(pieces))).otherwise(0).cast("int")

    span = F.struct(
        piece("id").alias("piece"), F.lit(True).alias("own"), F.col("id").alias("node"), (F.col("status") == "error").alias("error"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("ms"), F.col("parent").isNull().alias("root"), F.coalesce(F.col("parent") == F.col("id"), F.lit(False)).alias("self"),
    )
    ref = F.struct(
        piece("parent").alias("piece"), F.lit(False).alias("own"), F.col("parent").alias("node"), F.lit(False).alias("error"),
        F.lit(0.0).alias("ms"), F.lit(False).alias("root"), F.lit(False).alias("self"),
    )
    both = F.when(F.col("parent").isNull(), F.array(span)).otherwise(F.array(span, ref))
    dealt = rows.select(at, "trace", F.explode(both).alias("s")).select(at, "trace", "s.*")
    folding = TracePieces(at, gap_s * 1000, remember_s * 1000, cap)
    return dealt.groupBy("trace", "piece").transformWithStateInPandas(folding, PIECE, "Append", "EventTime")


def assembled(pieces: DataFrame) -> DataFrame:
    """(trace_id, span_count, errors, duration_ms, incomplete, cut, late, forgotten) of pieces that
    were written."""
    found = pieces.groupBy("trace_id").agg(
        F.sum("span_count").alias("span_count"),
        F.sum("errors").alias("errors"),
        F.max("duration_ms").alias("duration_ms"),
        ((F.sum("lost") > 0) | (F.sum("selves") > 0) | (F.sum("roots") != 1)).alias("incomplete"),
        *(F.sum(c).alias(c) for c in ("cut", "late", "forgotten")),
    )
    return found


def counters(spans: DataFrame) -> DataFrame:
    """Running counters over a stream of spans; see assembly.span_counters."""
    parent = F.nullif("parent_id", F.lit(""))
    return spans.agg(*(c.alias(n) for n, c in span_counters(parent).items()))


@dataclass
class Drained:
    """What a bounded stream gave: its rows, those that came too late, and how many rows of
    state were left after each batch."""

    rows: DataFrame
    late: int
    state: list[int]


def drained(
    source: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, at: str | None = "ts"
) -> Drained:
    """Runs `job` over all that `source` (a stream) holds now and reads its results back.

    With an event time `at` the job runs in append mode; the stream is then run once more with
    a mark, which closes all that is open. Without one (totals), the job runs in complete mode
    and the last batch counts. Results are written by batch under the shared folder, where a
    batch that is run again replaces itself.
    """
    spark = source.sparkSession
    path, marks, state = (scratch(spark, f"{name}{x}") for x in ("", "-marks", "-state"))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
    nothing = spark.range(0).select(*columns)
    nothing.write.parquet(marks)
    whole = source
    if at:
        whole = source.unionByName(spark.readStream.schema(source.schema).parquet(marks))
    made = job(whole)
    late, left = 0, []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:09d}")

    def run() -> StreamingQuery:
        query = (
            made.writeStream.outputMode("append" if at else "complete").option("checkpointLocation", state)
            .trigger(availableNow=True).foreachBatch(keep).start()
        )
        query.awaitTermination()
        return query

    runs = [run()]
    if at:
        mark = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
        spark.range(1).select(*mark).write.mode("append").parquet(marks)
        runs.append(run())
    last = 0
    for query in runs:
        for progress in query.recentProgress:
            last = max(last, progress["batchId"])
            for operator in progress["stateOperators"]:
                late += operator["numRowsDroppedByWatermark"]
            left.append(sum(operator["numRowsTotal"] for operator in progress["stateOperators"]))
    found = spark.read.schema(made.schema).parquet(path if at else f"{path}/epoch={last:09d}")
    return Drained(found.select(*made.columns), late, left)



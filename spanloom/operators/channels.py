"""Event channels: rules over one contract, and two versions of it compared.

An operation names its channel by pointer, and a channel and its operations name messages by
pointer; so messages are found in two equi-joins. Between versions channels and operations are
the same if their names are, messages if their names are or, without one, their pointers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.operators.contracts import BREAKING, CHANGE, POTENTIAL
from spanloom.operators.schemas import schema_changes

#: Markers of retries, dead letters, order and delivery.
RETRY, DEAD, ORDER = r"(?i)retr(y|ies)|maxretries|redelivery", r"(?i)dlq|dead.?letter", r"(?i)partition|ordering|orderingkey|message.?key|\bkey\b"
DELIVERY = r"(?i)acks|qos|delivery|confirm|persist|commit"


@dataclass(frozen=True)
class Events:
    """channels: project, pointer, channel, bindings, markers, messages (arrays, messages by pointer).
    operations: project, operation, action (SEND or RECEIVE), at (a channel's pointer), messages,
    bindings, markers. messages: project, pointer, name, correlation, payload (JSON), shape,
    content_type, bindings. schemas: project, name, schema (JSON)."""

    channels: DataFrame
    operations: DataFrame
    messages: DataFrame
    schemas: DataFrame


def payloads(events: Events) -> DataFrame:
    """Messages with `content`: their payload, or of a reference the schema that it names."""
    ref = F.from_json("payload", "`$ref` string")["$ref"]
    named = events.messages.withColumn("__name", F.element_at(F.split(ref, "/"), -1))
    known = events.schemas.groupBy("project", F.col("name").alias("__name")).agg(F.min("schema").alias("__schema"))
    return named.join(known.hint("merge"), ["project", "__name"], "left").withColumn("content", F.coalesce("__schema", "payload")).drop("__name", "__schema")


def _drifted(pairs: DataFrame, schemas: DataFrame) -> DataFrame:
    """(project, subject, unknown): subjects whose pairs (project, subject, was, now) differ."""
    sides = pairs.where("was <> now").distinct().select("project", "subject", F.lit("RESPONSE").alias("side"), F.lit("").alias("path"), "was", "now")
    found = schema_changes(sides, schemas)
    return found.groupBy("project", "subject").agg(F.bool_or(F.col("classification") == "UNKNOWN").alias("unknown"))


def event_issues(events: Events) -> DataFrame:
    """(project, id, subject). ASYNC001 channels without a message that has a payload, 002 messages
    without correlation id, 003 channels whose producers and consumers have payloads that differ,
    004 retries without dead letters, 005 ordered brokers without order, 006 messages of one name
    whose payloads differ, 007 channels with producers only, 008 operations that tell nothing of
    delivery.

    Where payloads are compared with each other, each is compared with the first: all are alike
    if and only if each is like one, so a channel or name costs what it has, not its pairs.
    """
    messages = settled(payloads(events).withColumn("key", F.coalesce(F.nullif("name", F.lit("")), "pointer")), "payloads")
    channel, text = F.col("channel"), F.lower(F.concat_ws(" ", "markers"))

    def found(rows: DataFrame, check: str, subject: Column) -> DataFrame:
        return rows.select("project", F.lit(check).alias("id"), subject.alias("subject"))

    names = events.channels.select("project", F.col("pointer").alias("at"), "channel")
    of_ops = events.operations.join(names.hint("merge"), ["project", "at"]).select("project", "channel", "action", F.explode("messages").alias("pointer"))
    own = events.channels.select("project", "channel", F.explode("messages").alias("pointer"))
    filled = messages.where("content is not null").select("project", "pointer", "content")
    told = own.union(of_ops.select("project", "channel", "pointer")).join(filled.hint("merge"), ["project", "pointer"], "left_semi")
    sides = of_ops.join(filled.hint("merge"), ["project", "pointer"]).select("project", "channel", "action", "content").distinct()
    first = sides.where("action = 'SEND'").groupBy("project", "channel").agg(F.min("content").alias("was"))
    heard = sides.where("action = 'RECEIVE'").select("project", "channel").distinct()
    between = sides.join(first.join(heard.hint("merge"), ["project", "channel"], "left_semi").hint("merge"), ["project", "channel"])
    between = between.select("project", channel.alias("subject"), "was", F.col("content").alias("now"))
    alike = messages.where("name <> '' and content is not null").select("project", F.col("name").alias("subject"), "pointer", "content")
    leading = alike.groupBy("project", "subject").agg(F.min_by("content", "pointer").alias("was"))
    variants = alike.join(leading.hint("merge"), ["project", "subject"]).select("project", "subject", "was", F.col("content").alias("now"))
    actions = events.operations.join(names.hint("merge"), ["project", "at"]).groupBy("project", "channel").agg(
        F.bool_or(F.col("action") == "SEND").alias("sends"), F.bool_or(F.col("action") == "RECEIVE").alias("hears")
    )
    lonely = text.rlike(RETRY) & ~text.rlike(DEAD)
    return reduce(DataFrame.unionByName, [
        found(events.channels.join(told.hint("merge"), ["project", "channel"], "left_anti"), "ASYNC001", channel),
        found(messages.where("correlation is null"), "ASYNC002", F.col("key")),
        found(_drifted(between, events.schemas), "ASYNC003", F.col("subject")),
        found(events.channels.where(lonely), "ASYNC004", channel),
        found(events.operations.where(lonely), "ASYNC004", F.col("operation")),
        found(events.channels.where(F.array_contains("bindings", "kafka") & ~text.rlike(ORDER)), "ASYNC005", channel),
        found(_drifted(variants, events.schemas), "ASYNC006", F.col("subject")),
        found(actions.where("sends and not hears"), "ASYNC007", channel),
        found(events.operations.where(~text.rlike(DELIVERY) & (F.size("bindings") == 0)), "ASYNC008", F.col("operation")),
    ])


def event_changes(old: Events, new: Events) -> DataFrame:
    """Changes (project, kind, classification, side, subject, path): channels removed (ASYNC009) or
    added (010), operations removed (011) or turned round (012), messages removed (014), with
    another place of the correlation id (013), payload (015) or content type (016), and bindings of
    any of them (017). A payload is compared part by part where both versions have one; a part
    that cannot be compared makes the change one that may break. Of several messages of one name
    the one with the last pointer counts."""
    def met(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        parts = [F.struct(*(c for c in side.columns if c not in ("project", key))).alias(name) for side, name in ((a, "was"), (b, "now"))]
        return a.select("project", key, parts[0]).join(b.select("project", key, parts[1]).hint("merge"), ["project", key], "full")

    def change(rows: DataFrame, kind: str, classification: Column | str, side: str, noun: str, key: str, tail: str = "") -> DataFrame:
        what = F.lit(classification) if isinstance(classification, str) else classification
        prefix = noun.split("_")[-1]
        return rows.select(
            "project", F.lit(kind).alias("kind"), what.alias("classification"), F.lit(side).alias("side"),
            F.concat(F.lit(f"{noun}:"), F.col(key)).alias("subject"), F.concat(F.lit(f"{prefix}:"), F.col(key), F.lit(tail)).alias("path"),
        )

    def keyed(events: Events) -> DataFrame:
        rows = payloads(events).withColumn("key", F.coalesce(F.nullif("name", F.lit("")), "pointer"))
        parts = ("correlation", "content", "shape", "content_type", "bindings")
        last = rows.groupBy("project", "key").agg(F.max_by(F.struct(*parts), "pointer").alias("of"))
        return settled(last.select("project", "key", "of.*"), "messages")

    channels = met(old.channels.select("project", "channel", "bindings"), new.channels.select("project", "channel", "bindings"), "channel")
    ops = met(old.operations.select("project", "operation", "action", "bindings"), new.operations.select("project", "operation", "action", "bindings"), "operation")
    messages = met(keyed(old), keyed(new), "key")
    gone, both = "now is null", "was is not null and now is not null"
    rebound = "array_sort(was.bindings) <> array_sort(now.bindings)"
    kept = messages.where(both)
    pairs = kept.where("was.content is not null and now.content is not null").select(
        "project", F.col("key").alias("subject"), F.col("was.content").alias("was"), F.col("now.content").alias("now")
    )
    drift = _drifted(pairs, new.schemas).withColumnRenamed("subject", "key")
    reshaped = kept.where("(was.content is null or now.content is null) and not (was.shape <=> now.shape)")
    return reduce(DataFrame.unionByName, [
        change(channels.where(gone), "ASYNC009", BREAKING, "RESPONSE", "async_channel", "channel"),
        change(channels.where("was is null"), "ASYNC010", POTENTIAL, "RESPONSE", "async_channel", "channel"),
        change(channels.where(both).where(rebound), "ASYNC017", POTENTIAL, "META", "async_channel", "channel", ".bindings"),
        change(ops.where(gone), "ASYNC011", BREAKING, "RESPONSE", "async_operation", "operation"),
        change(ops.where(both).where("was.action <> now.action"), "ASYNC012", BREAKING, "META", "async_operation", "operation", ".action"),
        change(ops.where(both).where(rebound), "ASYNC017", POTENTIAL, "META", "async_operation", "operation", ".bindings"),
        change(messages.where(gone), "ASYNC014", BREAKING, "RESPONSE", "message", "key"),
        change(kept.where("not (was.correlation <=> now.correlation)"), "ASYNC013", BREAKING, "REQUEST", "message", "key", ".correlationId"),
        change(drift, "ASYNC015", F.when(F.col("unknown"), POTENTIAL).otherwise(BREAKING), "RESPONSE", "message", "key", ".payload"),
        change(reshaped, "ASYNC015", BREAKING, "RESPONSE", "message", "key", ".payload"),
        change(kept.where("coalesce(was.content_type, '') <> coalesce(now.content_type, '')"), "ASYNC016", POTENTIAL, "RESPONSE", "message", "key", ".contentType"),
        change(kept.where(rebound), "ASYNC017", POTENTIAL, "META", "message", "key", ".bindings"),
    ]).select(*CHANGE)

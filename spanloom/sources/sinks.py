"""Findings and executions written for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.stats import HOUR, window_key

#: Severities as result levels.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}


def write_history(executions: DataFrame, path: str, pattern: str = HOUR) -> None:
    """Executions by window, so that a query for one reads only its folder."""
    rows = executions.withColumn("window", window_key(F.col("start_unix_nano"), pattern))
    rows.write.mode("append").partitionBy("window").parquet(path)


def execution_order() -> list[Column]:
    """Executions by start, request, trace, service and operation, what is missing first."""
    texts = [F.coalesce(c, F.lit("")) for c in ("request_id", "trace_id", "service", "operation")]
    return [F.coalesce("start_unix_nano", F.lit(0).cast("long")), *texts]


def read_history(
    spark: SparkSession, path: str, service: str | None = None, operation: str | None = None, window: str | None = None
) -> DataFrame:
    """History in the order of executions, of one service, operation or window, or of all."""
    rows = spark.read.parquet(path).withColumn("window", F.col("window").cast("string"))
    for name, wanted in (("service", service), ("operation", operation), ("window", window)):
        if wanted is not None:
            rows = rows.where(F.col(name) == wanted)
    return rows.orderBy(*execution_order())


def write_ordered(lines: DataFrame, path: str, order: list[str], kind: str) -> None:
    """Writes lines (value, columns of `order`) as text files whose names, in order, hold the
    lines in the order of those columns, nulls first, and then of the values.

    Rows are dealt in ranges, one a file, and sorted inside each; equal lines may lie in several
    files, as any order of them is right. Beside the files, `path`-files lists them, a JSON
    text each, in order: kind, order, file, lines. No one task sees all lines.
    """
    keys = [*(F.col(c).asc_nulls_first() for c in order), F.col("value").asc()]
    dealt = lines.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("__at"))
    dealt.sortWithinPartitions(*keys).select("value").write.text(path)
    spark = lines.sparkSession
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    listed = spark.read.text(path).groupBy(name.alias("file")).agg(F.count("*").alias("lines"))
    record = F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(",".join(order)).alias("order"), "file", "lines"))
    listed.coalesce(1).sortWithinPartitions("file").select(record.alias("value")).write.text(f"{path}-files")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the lines of write_ordered and their place, from 0. Files are numbered by what
    is listed beside them, and lines by their place in a file."""
    listed = spark.read.text(f"{path}-files").select(F.from_json("value", "file string, lines long").alias("f")).select("f.*")
    before = listed.withColumn("before", F.sum("lines").over(W.orderBy("file")) - F.col("lines"))  # a row a file
    rows = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    placed = rows.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("block", "id")) - 1)
    return placed.join(before, "file").select((F.col("before") + F.col("n")).alias("at"), "value")


def jsonl(findings: DataFrame) -> DataFrame:
    """One JSON text per finding, keys in order."""
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("value"))


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines in export order: id, entity ids (if there are any), JSON."""
    order = [c for c in ("id", "entity_ids") if c in findings.columns]
    text = F.to_json(F.struct(*sorted(findings.columns)))
    write_ordered(findings.select(*order, text.alias("value")), path, order, "findings")


def write_executions(executions: DataFrame, path: str) -> None:
    """Executions as JSON lines in their order."""
    text = F.to_json(F.struct(*sorted(executions.columns)))
    names = [f"o{i}" for i in range(5)]
    keyed = executions.select(*(c.alias(n) for c, n in zip(execution_order(), names, strict=True)), text.alias("value"))
    write_ordered(keyed, path, names, "executions")


def agent_lines(findings: DataFrame) -> DataFrame:
    """id|severity|confidence|subject[:line]|description, white space collapsed."""
    place = F.concat(F.col("subject"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    text = F.trim(F.regexp_replace("description", r"\s+", " "))
    return findings.select(F.concat_ws("|", "id", "severity", "confidence", place, text).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Results (rule, level, path, line) of the findings with a place."""
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return findings.where("path is not null").select(
        F.col("id").alias("rule"), F.try_element_at(level, F.col("severity")).alias("level"), "path", "line"
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    return findings.groupBy("id").agg(F.min("title").alias("title"))


def sarif_skipped(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("path").isNull()).alias("skipped"))

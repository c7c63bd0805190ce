"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, local mode
    (tests) sets a temporary one once, and a cluster, whose executors share no local folder, is
    an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are written within, at its end. What was built within must have been
    used or written elsewhere by then."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        context = spark.sparkContext
        for path in made:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe against lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_counting(df: DataFrame, name: str, condition: Column | str) -> tuple[DataFrame, int]:
    """settled(df), and how many of its rows meet the condition, counted by the job that writes
    them."""
    seen = Observation()
    condition = F.expr(condition) if isinstance(condition, str) else condition
    rows = settled(df.observe(seen, F.count_if(condition).alias("n")), name)
    return rows, seen.get["n"]

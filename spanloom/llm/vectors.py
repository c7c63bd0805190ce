"""Helpers of the vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import written


def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    ok = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


def one_each(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one vector per vec_id. Rows without a vec_id or vector take no part; of rows that
    share one, the least vector in array order stands for all."""
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    repeated = written(vectors.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return vectors
    several = vectors.join(repeated, "vec_id", "left_semi").groupBy("vec_id")
    return vectors.join(repeated, "vec_id", "left_anti").union(several.agg(F.min("v").alias("v")))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, kind: type = np.float64) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims).astype(kind)
    out = np.zeros((len(lengths), dims), kind)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    out[rows, np.arange(len(values)) - np.repeat(first, lengths)] = values
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k rows of each query_id with the highest score, ties to smaller vec_id, with rank."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return placed.select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation flips signs at random and applies the fast Hadamard transform, three
times; a unit vector's bucket is the signed axis that is nearest to it then. A query probes
the buckets of its nearest axes in each table, and what they hold is ranked by the exact
inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spanloom.llm.common import table, written
from spanloom.llm.vectors import matrix, one_each, ranked, usable

TABLES = 4
PROBES = 1 / 4  # of a table's buckets
CHUNK = 8192  # rows of a bucket that are searched at once
LOT = 4096  # queries of a bucket that meet a chunk at once
UNEVEN = 1e-3  # spread of lengths beyond which the added coordinate is hashed too


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, scaled to keep lengths; a power of two long."""
    n, size = rows.shape
    step = 1
    while step < size:
        rows = rows.reshape(n, -1, 2, step)
        rows = np.stack([rows[:, :, 0] + rows[:, :, 1], rows[:, :, 0] - rows[:, :, 1]], axis=2)
        step *= 2
    return rows.reshape(n, size) / np.sqrt(size)


def rotated(rows: np.ndarray, place: int, seed: int) -> np.ndarray:
    """The rows under the pseudo-rotation of table `place`."""
    signs = np.random.default_rng([seed, place]).choice([-1.0, 1.0], (3, rows.shape[1]))
    for sign in signs:
        rows = hadamard(rows * sign)
    return rows


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    tables: int = TABLES,
    probes: float = PROBES,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows found with the largest
    inner product, in double precision of the vectors as they are.

    vectors and queries: (vec_id, v array<float or double>), neither null nor all zero. Rows
    without a vec_id take no part, and rows that share one count as one, the least in array
    order. A row of the query's own vec_id is no candidate; ties go to the smaller vec_id. An
    empty table gives an empty table; other columns are ignored. A query that
    finds fewer than k rows is compared with all, so small tables give all candidates. Of
    vectors of different lengths the shorter one counts as filled up with zeros. Where
    lengths (norms) differ, a coordinate is added that makes them equal.

    Every row is indexed. A bucket is searched in chunks of about CHUNK rows, so equal rows
    do not meet in one task; each chunk returns its k best of a query, so nothing is lost.
    """
    vectors, queries = written(one_each(vectors), "vectors"), one_each(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shape = vectors.agg(
        F.max(square).alias("most"), F.min(square).alias("least"), F.max(F.size("v")).alias("dims")
    ).first()
    if shape.dims is None:
        return ranked(_nothing(vectors.sparkSession), k)
    dims, most = int(shape.dims), float(shape.most)
    even = np.sqrt(most) - np.sqrt(shape.least) <= UNEVEN * np.sqrt(most)
    size = 1
    while size < dims + (not even) or size < 2:
        size *= 2
    wanted = max(1, round(2 * size * probes))

    def padded(column: pa.Array, point: bool) -> np.ndarray:
        x = np.zeros((len(column), size))
        x[:, :dims] = matrix(column, dims)
        if point and not even:
            x[:, dims] = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    @arrow_udf("array<int>")
    def buckets(column: pa.Array) -> pa.Array:
        x, out = padded(column, True), []
        for place in range(tables):
            y = rotated(x, place, seed)
            axis = np.abs(y).argmax(axis=1)
            out.append(2 * axis + (y[np.arange(len(y)), axis] < 0) + 2 * size * place)
        return pa.array(list(np.stack(out, axis=1)), pa.list_(pa.int32()))

    @arrow_udf("array<int>")
    def probed(column: pa.Array) -> pa.Array:
        x, out = padded(column, False), []
        for place in range(tables):
            y = rotated(x, place, seed)
            both = np.stack([y, -y], axis=2).reshape(len(y), 2 * size)
            best = np.argpartition(-both, min(wanted, 2 * size) - 1, axis=1)[:, :wanted]
            out.append(best + 2 * size * place)
        return pa.array(list(np.concatenate(out, axis=1)), pa.list_(pa.int32()))

    held = written(vectors.select("vec_id", "v", buckets("v").alias("buckets")), "held")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.slice("v", 1, dims).alias("v"))
    asked = written(asked.withColumn("buckets", probed("v")), "asked")
    dealt = held.select("vec_id", "v", F.explode("buckets").alias("bucket"))
    asking = asked.select("query_id", "v", F.explode("buckets").alias("bucket"))
    once = _searched(dealt, asking, dims, k).groupBy("query_id", "vec_id")
    found = written(ranked(once.agg(F.max("score").alias("score")), k), "found")
    short = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = written(asked.join(short, "query_id", "left_anti").select("query_id", "v"), "short")
    if short.isEmpty():
        return found
    every = F.explode(F.sequence(F.lit(0), F.lit(2 * size - 1))).alias("bucket")
    whole = _searched(
        held.select("vec_id", "v", F.col("buckets")[0].alias("bucket")),
        short.select("query_id", "v", every),
        dims,
        k,
    )
    kept = found.join(short.select("query_id"), "query_id", "left_anti")
    return kept.union(ranked(whole, k))


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, vec_id long, score double")


def _searched(dealt: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each chunk of its buckets.

    dealt: (vec_id, v, bucket). asked: (query_id, v, bucket). A bucket's rows are dealt into chunks
    and its queries into lots, and each chunk meets each lot, so no group grows with either.
    """
    sizes = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    lots = asked.groupBy("bucket").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    sizes = F.broadcast(written(sizes.join(lots, "bucket"), "sizes"))  # tables x 2 x dimensions rows
    chunk, lot = (F.pmod(F.xxhash64(c), F.col(n)).cast("int") for c, n in (("vec_id", "chunks"), ("query_id", "lots")))

    def every(count: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)

    rows = dealt.join(sizes, "bucket").select("vec_id", "v", "bucket", chunk.alias("chunk"), every("lots", "lot"))
    pairs = asked.join(sizes, "bucket").select("query_id", "v", "bucket", lot.alias("lot"), every("chunks", "chunk"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, queries, scores = [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            points, names = matrix(left.column("v"), dims), left.column("vec_id").to_numpy()
            asking = right.column("query_id").to_numpy()
            asked = matrix(right.column("v"), dims)
            for at in range(0, len(asking), 256):
                inner = asked[at : at + 256] @ points.T
                for own, row in zip(asking[at : at + 256].tolist(), inner, strict=True):
                    row[names == own] = -np.inf
                    good = np.flatnonzero(row > -np.inf)
                    if len(good) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        good = np.flatnonzero(row >= least)
                        good = good[np.argsort(-row[good], kind="stable")[:k]]
                    ids.append(names[good])
                    queries.append(np.full(len(good), own))
                    scores.append(row[good])
        none = [np.zeros(0)]
        columns = [
            pa.array(np.concatenate(queries or none).astype(np.int64)),
            pa.array(np.concatenate(ids or none).astype(np.int64)),
            pa.array(np.concatenate(scores or none).astype(np.float64)),
        ]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    both = rows.groupBy("bucket", "chunk", "lot").cogroup(pairs.groupBy("bucket", "chunk", "lot"))
    return both.applyInArrow(search, "query_id long, vec_id long, score double")


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("embedding")
    found = table(spark, sf_dir, "embeddings").where(usable(vector))
    found = found.where(F.exists(vector, lambda x: x != 0)).select("vec_id", vector.alias("v"))
    return nearest_neighbours(found, found.where("vec_id % 20 = 0"))

"""Exact top-k inner products by best-first search in M-trees.

Vectors become points of equal length by one more coordinate, so that the nearest point has
the largest inner product. Points go to the subtree of their nearest pivot; a subtree is an
M-tree of paged nodes with covering radii and distances to the parent. A query starts with
its k-th best of a few seeds as a bound and is searched in every subtree whose ball comes
nearer than that.
Inside a tree, nodes are taken nearest first, and a distance is computed only if the stored
one to the parent leaves it open by the triangle inequality.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spanloom.llm.common import table, written
from spanloom.llm.vectors import matrix, one_each, ranked, usable

PAGE, FANOUT = 64, 16
PIVOTS = 32
SEEDS = 2048  # vectors that give each query its first bound
TREE = 4096  # points a subtree, about; larger ones are split by a hash
LOT = 1 << 14  # queries that meet a subtree in one task, about
SLACK = 1e-6  # of a distance, for rounding


class MTree:
    """points: integer vectors. bound: at least the largest squared length of any."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, bound: float) -> None:
        self.ids, self.points, self.bound = ids, points, bound
        self.squares = (points * points).sum(axis=1)
        self.more = np.sqrt(np.maximum(bound - self.squares, 0))
        order = np.argsort(ids, kind="stable")
        self.root = self._node(order, order[0]) if len(ids) else None

    def _from(self, to: int, rows: np.ndarray) -> np.ndarray:
        """Distances of rows to a point, the added coordinate included."""
        inner = self.points[rows] @ self.points[to] + self.more[rows] * self.more[to]
        return np.sqrt(np.maximum(2 * (self.bound - inner), 0))

    def _node(self, rows: np.ndarray, center: int) -> tuple:
        """(is a leaf, rows or routing points, distances to center, radii, children)."""
        away = self._from(center, rows)
        if len(rows) <= PAGE:
            return True, rows, away, None, None
        routes, near = [int(rows[away.argmax()])], None
        for _ in range(min(FANOUT, -(-len(rows) // PAGE)) - 1):  # the farthest from all so far
            last = self._from(routes[-1], rows)
            near = last if near is None else np.minimum(near, last)
            routes.append(int(rows[near.argmax()]))
        to = np.stack([self._from(r, rows) for r in routes])
        nearest = to.argmin(axis=0)
        if np.bincount(nearest, minlength=len(routes)).max() > len(rows) * 3 // 4:
            nearest = np.arange(len(rows)) % len(routes)  # equal points: pages of equal size
        used = [i for i in range(len(routes)) if (nearest == i).any()]
        parts = [rows[nearest == i] for i in used]
        radii = np.array([to[i][nearest == i].max() for i in used])
        points = np.array([routes[i] for i in used])
        children = [self._node(p, r) for p, r in zip(parts, points.tolist(), strict=True)]
        return False, points, self._from(center, points), radii, children

    def search(
        self, query: np.ndarray, own: int, k: int, floor: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best but `own`, among those with a score of floor or
        more."""
        length = float(query @ query) + self.bound
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        far = np.sqrt(max(length - 2 * floor, 0)) if floor > -np.inf else np.inf
        start = float(np.sqrt(max(length - 2 * float(self.points[self.root_point()] @ query), 0)))
        queue, count = [(0.0, 0, self.root, start)], 0
        while queue:
            low, _, (leaf, rows, away, radii, children), to_center = heapq.heappop(queue)
            limit = far + SLACK * (1 + far)
            if low > limit:
                break
            gap = np.abs(to_center - away)
            near = np.flatnonzero((gap if leaf else gap - radii) <= limit)
            if not len(near):
                continue
            scores = self.points[rows[near]] @ query
            if leaf:
                ids = self.ids[rows[near]]
                kept = (ids != own) & (scores >= floor)
                best_ids = np.concatenate([best_ids, ids[kept]])
                best = np.concatenate([best, scores[kept]])
                if len(best) > k:
                    order = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[order], best[order]
                if len(best) == k:
                    floor = max(floor, best.min())
                    far = np.sqrt(max(length - 2 * floor, 0))
                continue
            distance = np.sqrt(np.maximum(length - 2 * scores, 0))
            for place, d in zip(near.tolist(), distance.tolist(), strict=True):
                least = max(0.0, d - radii[place])
                if least <= limit:
                    count += 1
                    heapq.heappush(queue, (least, count, children[place], d))
        return best_ids, best

    def root_point(self) -> int:
        return int(np.argsort(self.ids, kind="stable")[0])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    vectors and queries: (vec_id, v array<long>). Rows without a vec_id take no part, and rows
    that share one count as one, the least in array order. A row of the query's own vec_id is
    no candidate; ties go to the smaller vec_id; fewer than k candidates are all returned. An
    empty table gives an empty table; other columns are ignored. Of vectors of different lengths the shorter one counts as filled up with zeros. Components
    must be small enough for sums of products to stay below 2**53.

    A subtree has about TREE points and a task about LOT queries, so tasks are bounded, also where
    many points are equal: the points of one pivot are split by a hash of their vec_id. Queries meet subtrees in
    pairs (query, subtree), and each subtree is built once for each LOT of them; only the pivots and seeds, PIVOTS
    and SEEDS vectors, are sent to all tasks.
    """
    vectors, queries = written(one_each(vectors), "vectors"), one_each(queries)
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    shape = vectors.agg(F.max(size).alias("square"), F.max(F.size("v")).alias("dims")).first()
    bound, dims = float(shape.square or 0), int(shape.dims or 0)
    pivots = (
        vectors.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
    )
    if not pivots or not dims:
        return ranked(_nothing(vectors.sparkSession), k)
    centers = np.zeros((len(pivots), dims))
    for i, row in enumerate(pivots):
        centers[i, : len(row.v)] = row.v
    added = np.sqrt(np.maximum(bound - (centers * centers).sum(axis=1), 0))

    @arrow_udf("pivot int, away double")
    def nearest(column: pa.Array) -> pa.Array:
        x = matrix(column, dims)
        more = np.sqrt(np.maximum(bound - (x * x).sum(axis=1), 0))
        away = np.sqrt(np.maximum(2 * (bound - x @ centers.T - more[:, None] * added), 0))
        at = away.argmin(axis=1).astype(np.int32)
        parts = [pa.array(at), pa.array(away[np.arange(len(x)), at])]
        return pa.StructArray.from_arrays(parts, names=["pivot", "away"])

    seeds = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).collect()
    names = np.array([row.vec_id for row in seeds], np.int64)
    starts = np.zeros((len(seeds), dims))
    for i, row in enumerate(seeds):
        starts[i, : len(row.v)] = row.v

    @arrow_udf("away array<double>, floor double")
    def bounded(ids: pa.Array, column: pa.Array) -> pa.Array:
        """Distances to the pivots, and the k-th best score among the seeds but the own row."""
        x, own = matrix(column, dims), ids.to_numpy()
        away = (x * x).sum(axis=1)[:, None] + bound - 2 * x @ centers.T
        scores = x @ starts.T
        scores[own[:, None] == names] = -np.inf
        floor = np.full(len(x), -np.inf)
        if len(names) >= k:
            floor = np.partition(scores, len(names) - k, axis=1)[:, len(names) - k]
        lists = pa.array(list(np.sqrt(np.maximum(away, 0))), pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([lists, pa.array(floor)], names=["away", "floor"])

    placed = written(vectors.withColumn("p", nearest("v")).select("vec_id", "v", "p.*"), "placed")
    balls = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    balls = written(balls.withColumn("trees", F.ceil(F.col("n") / TREE).cast("int")), "balls")
    trees = placed.join(F.broadcast(balls), "pivot").select(  # PIVOTS rows
        "vec_id", "v", "pivot", F.pmod(F.xxhash64("vec_id"), "trees").cast("int").alias("part")
    )
    asked = queries.withColumn("v", F.slice("v", 1, dims))  # what is beyond meets zeros only
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", bounded("vec_id", "v").alias("b"))
    asked = written(asked.select("query_id", "v", "b.*"), "asked")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    reach = F.sqrt(F.greatest(F.lit(0.0), square + bound - 2 * F.col("floor"))) * (1 + SLACK) + SLACK
    near = (
        asked.select("*", F.posexplode("away").alias("pivot", "to_pivot"))
        .join(F.broadcast(balls), "pivot")
        .where(F.col("to_pivot") - F.col("radius") <= reach)
        .select("query_id", "v", "pivot", "floor")
    )
    return ranked(_searched(near, trees, balls, dims, bound, k), k)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, vec_id long, score long")


def _searched(
    asked: DataFrame, trees: DataFrame, balls: DataFrame, dims: int, bound: float, k: int
) -> DataFrame:
    """The k best of each (query, subtree): asked (query_id, v, pivot, floor) meets every part
    of its pivot's subtree. Where more than LOT queries reach a pivot, its subtrees are built
    again for each lot of them, so no group grows with the queries."""
    lots = asked.groupBy("pivot").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    sizes = F.broadcast(written(balls.select("pivot", "trees").join(lots, "pivot"), "lots"))  # PIVOTS rows
    lot = F.pmod(F.xxhash64("query_id"), "lots").cast("int").alias("lot")
    pairs = asked.join(sizes, "pivot").select(
        "query_id", "v", "floor", "pivot", lot, F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("part")
    )
    trees = trees.join(sizes.drop("trees"), "pivot").select(
        "vec_id", "v", "pivot", "part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            tree = MTree(ids, matrix(left.column("v"), dims), bound)
            asking = right.column("query_id").to_numpy()
            floors = right.column("floor").to_numpy()
            for own, query, floor in zip(
                asking.tolist(), matrix(right.column("v"), dims), floors.tolist(), strict=True
            ):
                found, scores = tree.search(query, own, k, floor)
                out[0] += [own] * len(found)
                out[1] += found.tolist()
                out[2] += scores.astype(np.int64).tolist()
        kinds = [pa.array(x, pa.int64()) for x in out]
        return pa.Table.from_arrays(kinds, names=["query_id", "vec_id", "score"])

    both = trees.groupBy("pivot", "part", "lot").cogroup(pairs.groupBy("pivot", "part", "lot"))
    return both.applyInArrow(search, "query_id long, vec_id long, score long")


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    scaled = F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * F.lit(1024.0)).cast("long")
    )
    vectors = found.select("vec_id", scaled.alias("v"))
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP5_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM whole),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM scores)
WHERE rank <= 10
"""

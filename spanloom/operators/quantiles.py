"""Exact percentiles of groups of any size.

A group's values are never held in one place. A sketch of each group, merged from one per
task, brackets every wanted rank; values between brackets are only counted, and those
inside, under a hundredth of a large group for each point, are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000  # the sketch errs by at most n / ACCURACY ranks
MARGIN = 16 / ACCURACY  # what a bracket adds on either side
SMALL = ACCURACY // 4  # rows of a group that is ordered whole: MARGIN holds no two ranks there


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """(keys, n, mean, q): the number and mean of the non-null values of each key, nulls being a key
    too, and their percentiles at the points by linear interpolation on rank (n - 1) p. Keys
    without values have no row. `rows` are read twice."""
    narrow = rows.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null")
    probes = [max(0.0, p - MARGIN) for p in points] + [min(1.0, p + MARGIN) for p in points]
    sketch = F.percentile_approx("x", F.array(*map(F.lit, probes)), ACCURACY)
    bounds = narrow.groupBy(*keys).agg(
        F.count("x").alias("__n"), F.avg("x").alias("__mean"), F.min("x").alias("__min"), F.max("x").alias("__max"), sketch.alias("__s")
    )
    whole = F.col("__n") <= SMALL
    lows = [F.when(whole | (p <= MARGIN), F.col("__min")).otherwise(F.col("__s")[i]) for i, p in enumerate(points)]
    highs = [
        F.when(whole | (p >= 1 - MARGIN), F.col("__max")).otherwise(F.col("__s")[len(points) + i]) for i, p in enumerate(points)
    ]
    bounds = bounds.select(*keys, "__n", "__mean", F.array(*lows).alias("__low"), F.array(*highs).alias("__high"))
    met = same(narrow, bounds, keys)
    inside = F.lit(False)
    above = F.lit(float("inf"))
    for i in range(len(points)):
        low, high = F.col("__low")[i], F.col("__high")[i]
        inside = inside | ((F.col("x") >= low) & (F.col("x") <= high))
        above = F.least(above, F.when(F.col("x") < low, low))  # a value between brackets counts before the next one
    placed = met.withColumn("__in", inside).withColumn("x", F.when(F.col("__in"), F.col("x")).otherwise(above))
    counts = placed.groupBy(*keys, "x", "__in").agg(
        F.count(F.lit(1)).alias("__times"), F.first("__n").alias("__n"), F.first("__mean").alias("__mean")
    )
    upto = F.sum("__times").over(W.partitionBy(*keys).orderBy("x", "__in"))
    counts = counts.withColumn("__upto", upto)

    def at(rank: Column) -> Column:
        holds = F.col("__in") & (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__times"))
        return F.max(F.when(holds, F.col("x")))

    ranks = [(F.col("__n") - 1) * F.lit(float(p)) for p in points]
    picked = [c for r in ranks for c in (at(F.floor(r)), at(F.ceil(r)))]
    found = counts.groupBy(*keys).agg(
        F.first("__n").alias("__n"), F.first("__mean").alias("__mean"), *(c.alias(f"__{i}") for i, c in enumerate(picked))
    )
    missed = F.raise_error(F.lit("a percentile lies outside its bracket"))
    values = []
    for i, rank in enumerate(ranks):
        low, high = F.col(f"__{2 * i}"), F.col(f"__{2 * i + 1}")
        value_at = low + (high - low) * (rank - F.floor(rank))
        values.append(F.when(low.isNull() | high.isNull(), missed.cast("double")).when(low == high, low).otherwise(value_at))
    return found.select(*keys, F.col("__n").alias("n"), F.col("__mean").alias("mean"), F.array(*values).alias("q"))


def summaries(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, and for each name count, p50, p95, p99, min and max as prefixed columns) of several
    values at once; a key without values of a name has a count of 0."""
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in values.items()))).alias("v"))
    long = long.select(*keys, "v.name", "v.x").where("x is not null")
    found = exact_quantiles(long, [*keys, "name"], "x", (0.0, 0.5, 0.95, 0.99, 1.0))
    parts = ("min", "p50", "p95", "p99", "max")
    columns = []
    for name in values:
        own = F.col("name") == name
        columns.append(F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0).cast("long")).alias(f"{name}_count"))
        by_name = {p: F.max(F.when(own, F.col("q")[i])).alias(f"{name}_{p}") for i, p in enumerate(parts)}
        columns += [by_name[p] for p in ("p50", "p95", "p99", "min", "max")]
    return found.groupBy(*keys).agg(*columns)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Two tables of one row a key joined, null keys being equal; the right one's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*(f"__{k}" for k in keys))

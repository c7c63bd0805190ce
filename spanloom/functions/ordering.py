"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `rank`: their place, from 1, among those of their keys, by `order`, nulls first.

    Rows are dealt in ranges of keys and order, whatever their group, and sorted inside each; the
    rows of a group in earlier ranges are counted and added. So a group with a third of all rows
    is spread. Rows equal in all of these stand in the order in which they were read.
    """
    sorting = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = rows.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*sorting, F.col("__read"))
    dealt = dealt.sortWithinPartitions(*sorting, "__read").drop("__read")
    placed = settled(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__at", 33))
    named = {k: f"__{i}" for i, k in enumerate(keys)}
    shares = placed.groupBy("__part", *keys).agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    before = F.sum("__rows").over(W.partitionBy(*keys).orderBy("__part")) - F.col("__rows")
    shares = shares.withColumn("__before", before).drop("__rows").withColumnsRenamed(named)
    shares = shares.withColumnRenamed("__part", "__range")
    met = F.col("__part") == F.col("__range")
    for key, name in named.items():
        met = met & F.col(key).eqNullSafe(F.col(name))
    found = placed.join(shares, met).withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return found.select(*rows.columns, "rank")

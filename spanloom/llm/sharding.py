"""Exact uniform sharding by a hypergeometric communication matrix.

Rows fall into blocks (virtual partitions) by a hash. The number of rows that each block
sends to each shard is drawn from the multivariate hypergeometric law, which is what a
uniform permutation of all rows would give; the shards' sizes are fixed beforehand. Each
block permutes its rows and cuts them by its row of the matrix, and each shard permutes
what it received. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import table, written


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good items among `draws` of `total`, by inversion of u.

    The weights follow from the mode by the ratio of neighbouring probabilities, within
    9 standard deviations and 18 steps of it, beyond which they vanish in a double.
    """
    n, k, t = (x.cast("double") for x in (draws, good, total))
    whole = F.greatest(t, F.lit(1.0))
    spread = F.sqrt(n * k / whole * (t - k) / whole * (t - n) / F.greatest(t - 1, F.lit(1.0)))
    known = F.struct(
        n.alias("n"),
        k.alias("k"),
        (t - k - n).alias("rest"),
        F.floor((n + 1) * (k + 1) / (t + 2)).alias("mode"),
        (F.floor(spread * 9) + 18).alias("reach"),
        F.least(draws, good).alias("most"),
        F.greatest(F.lit(0).cast("long"), draws + good - total).alias("least"),
        u.alias("u"),
    )

    def ranged(p: Column) -> Column:
        return F.struct(
            *(p[c].alias(c) for c in ("n", "k", "rest", "mode", "u")),
            F.least(p["most"] - p["mode"], p["reach"]).alias("up"),
            F.least(p["mode"] - p["least"], p["reach"]).alias("down"),
        )

    def weight(p: Column, w: Column, i: Column) -> Column:
        """Of the i-th value: the mode, those above it, then those below it."""
        over = p["mode"] + i - 1
        under = p["mode"] - (i - p["up"]) + 1
        return F.when(
            i <= p["up"],
            F.when(i == 0, 1.0).otherwise(
                w * (p["k"] - over) * (p["n"] - over) / ((over + 1) * (p["rest"] + over + 1))
            ),
        ).otherwise(
            F.when(i == p["up"] + 1, 1.0).otherwise(w)
            * under
            * (p["rest"] + under)
            / ((p["k"] - under + 1) * (p["n"] - under + 1))
        )

    def steps(p: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), p["up"] + p["down"])

    zero, none = F.lit(0.0), F.lit(-1).cast("long")

    def mass(p: Column) -> Column:
        return F.aggregate(
            steps(p),
            F.struct(zero.alias("w"), zero.alias("sum")),
            lambda s, i: _let(
                weight(p, s["w"], i),
                lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")),
            ),
            lambda s: s["sum"],
        )

    def walk(p: Column, most: Column) -> Column:
        """Takes weights off u times the mass; the value at which none is left."""
        return F.aggregate(
            steps(p),
            F.struct(zero.alias("w"), most.alias("left"), none.alias("at")),
            lambda s, i: F.when(s["left"] < 0, s).otherwise(
                _let(
                    weight(p, s["w"], i),
                    lambda w: F.struct(
                        w.alias("w"), (s["left"] - w).alias("left"), i.alias("at")
                    ),
                )
            ),
            lambda s: F.when(s["at"] <= p["up"], p["mode"] + s["at"]).otherwise(
                p["mode"] - (s["at"] - p["up"])
            ),
        )

    return _let(
        known,
        lambda raw: _let(ranged(raw), lambda p: _let(mass(p) * p["u"], lambda m: walk(p, m))),
    )


def communication_matrix(sizes: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """(block int, sends array<long>): rows of each block for each shard.

    sizes: (block, n) for blocks 0 to blocks - 1, absent ones being empty. blocks is a power
    of two. A binary tree over the blocks splits the shards' capacities: the left half's
    part of them is multivariate hypergeometric given its number of rows. Columns add up to
    the shards' sizes, which are at most one apart, and rows to the blocks' sizes.
    """
    whole = F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), "n")))
    level = sizes.agg(whole.alias("by")).select(
        F.lit(0).alias("node"),
        F.transform(
            F.sequence(F.lit(0), F.lit(blocks - 1)),
            lambda b: F.coalesce(F.try_element_at("by", b), F.lit(0).cast("long")),
        ).alias("sizes"),
    )
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    level = level.withColumn("total", total).select(
        "node",
        "sizes",
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.floor(F.col("total") / shards)
            + F.when(s < F.col("total") % shards, 1).otherwise(0),
        ).alias("sends"),
    )
    span = blocks
    while span > 1:
        half = span // 2
        left_rows = F.aggregate(
            F.slice("sizes", 1, half), F.lit(0).cast("long"), lambda a, x: a + x
        )
        all_rows = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)

        def draw(s: Column, cap: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(span), F.col("node"), F.size(s["to"]))  # noqa: B023
            k = _hypergeometric(s["rows"], cap, s["left"], u)
            return F.struct(
                F.concat(s["to"], F.array(k)).alias("to"),
                (s["rows"] - cap).alias("rows"),
                (s["left"] - k).alias("left"),
            )

        drawn = F.aggregate(
            "sends",
            F.struct(
                F.array().cast("array<long>").alias("to"),
                F.col("all_rows").alias("rows"),
                F.col("left_rows").alias("left"),
            ),
            draw,
            lambda s: s["to"],
        )
        level = (
            level.withColumns({"left_rows": left_rows, "all_rows": all_rows})
            .withColumn("left_sends", drawn)
            .select(
                F.explode(
                    F.array(
                        F.struct(
                            (F.col("node") * 2).alias("node"),
                            F.slice("sizes", 1, half).alias("sizes"),
                            F.col("left_sends").alias("sends"),
                        ),
                        F.struct(
                            (F.col("node") * 2 + 1).alias("node"),
                            F.slice("sizes", half + 1, half).alias("sizes"),
                            F.zip_with("sends", "left_sends", lambda a, b: a - b).alias("sends"),
                        ),
                    )
                ).alias("half")
            )
            .select("half.*")
        )
        span = half
    return level.select(F.col("node").alias("block"), "sends")


def shard_uniformly(
    df: DataFrame, shards: int = 8, blocks: int = 256, parts: int = 128, seed: int = 17
) -> DataFrame:
    """All rows of df with `shard` (0 to shards - 1) and `slot` (gapless from 0 in a shard).

    The assignment is a uniform random permutation cut into shards whose row counts are at
    most one apart. Rows are told apart by a hash of all columns and their place in the input,
    so equal rows spread like others; nulls are values as any other and texts count whole. An
    empty table gives an empty table. Columns named shard or slot are replaced. blocks must
    be a power of two; it and parts bound how many rows a task sorts, while the matrix has
    blocks x shards numbers whatever the number of rows.
    """
    if blocks < 1 or blocks & (blocks - 1):
        raise ValueError("blocks must be a power of two")
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    own = {"row": "__row", "block": "__block", "first": "__first", "second": "__second"}
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    block, first, second = (F.xxhash64(F.lit(seed + i), "row", "place") for i in range(3))
    rows = rows.select(
        F.col("row").alias(own["row"]),
        F.pmod(block, F.lit(blocks)).cast("int").alias(own["block"]),
        first.alias(own["first"]),
        second.alias(own["second"]),
    )
    rows = written(rows, "shard-rows")
    sizes = rows.groupBy(F.col(own["block"]).alias("block")).agg(F.count("*").alias("n"))
    matrix = written(communication_matrix(sizes, shards, blocks, seed), "shard-matrix")
    cuts = matrix.select(
        F.col("block").alias(own["block"]),
        F.aggregate(
            "sends",
            F.array().cast("array<long>"),
            lambda a, x: F.concat(
                a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x)
            ),
        ).alias("cuts"),
    )
    local = W.partitionBy(own["block"]).orderBy(own["first"], own["second"])
    sent = (
        rows.withColumn("at", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), own["block"])  # blocks rows of `shards` numbers
        .select(
            own["row"],
            own["second"],
            F.size(F.filter("cuts", lambda c: c <= F.col("at"))).alias("shard"),
            F.pmod(F.col(own["second"]), F.lit(parts)).alias("part"),
        )
    )
    sent = written(sent, "shard-sent")
    starts = (
        sent.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "start",
            F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n"),
        )
        .select("shard", "part", "start")
    )
    again = W.partitionBy("shard", "part").orderBy(own["second"])
    placed = sent.withColumn("at", F.row_number().over(again) - 1).join(
        F.broadcast(starts), ["shard", "part"]  # shards x parts rows at most
    )
    return placed.select(
        *(F.col(own["row"]).getField(c).alias(c) for c in kept),
        "shard",
        (F.col("start") + F.col("at")).alias("slot"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_uniformly(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

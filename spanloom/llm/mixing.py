"""Mixing sources to target weights by iterative proportional fitting.

Token sums of (source, language, topic) cells are raked until their marginals match the
targets. A cell's probability is its raked share of the token budget over its tokens, and
documents are drawn independently with it, so expected tokens meet the targets.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import aside, table, written

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
NEW = ("topic", "n_tokens", "probability", "selected")
BROADCAST_CELLS = 50_000  # cells, of some 100 bytes each, that are sent to every task


def topic_of(text: Column) -> Column:
    """The form of a text: none, tabular, marked, loud, brief, prose or long."""
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", NONE)
        .when(text.contains(" | "), "tabular")
        .when(text.rlike(r"[#$%&*]{3}"), "marked")
        .when(text.contains("!! "), "loud")
        .when(F.length(text) < 400, "brief")
        .when(F.length(text) < 4000, "prose")
        .otherwise("long")
    )


def _own(text: Column) -> dict[str, Column]:
    """A document's levels (null: "(none)"), its tokens (runs without white space), and a
    uniform number that the row decides."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(2), F.col("doc_id"), text), 11) / float(1 << 53)
    return {
        "__source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "__lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "__topic": topic_of(text),
        "__tokens": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long"),
        "__u": u,
    }


def tempered_targets(cells: DataFrame, power: float = 0.5) -> DataFrame:
    """(dimension, level, share): each level's share of tokens to a power, scaled to 1."""
    total = cells.agg(F.sum("tokens").alias("all"))
    found = None
    for name in DIMENSIONS:
        level = F.col(name).alias("level")
        one = cells.groupBy(level).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        one = one.join(F.broadcast(total)).select(  # one row
            F.lit(name).alias("dimension"),
            "level",
            F.pow(F.col("tokens") / F.col("all"), F.lit(power)).alias("share"),
        )
        scale = one.agg(F.sum("share").alias("scale"))
        one = one.join(F.broadcast(scale)).select(
            "dimension", "level", (F.col("share") / F.col("scale")).alias("share")
        )
        found = one if found is None else found.union(one)
    return found


def rake(
    cells: DataFrame, targets: DataFrame, tolerance: float = 1e-3, sweeps: int = 25
) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`: tokens scaled so that every level's
    share of all weight is its target. A level without target keeps weight 0; a target
    without tokens cannot be met and the others are scaled to 1. Each sweep is one job over
    the cells and a written table; sweeps end when no marginal is off by more than
    `tolerance` of its target. Targets that contradict each other, or empty cells, can keep
    some from being met in `sweeps`: then the last sweep's weights are returned with a warning."""
    goals = {}
    for name in DIMENSIONS:
        goal = targets.where(F.col("dimension") == name).select(F.col("level").alias(name), "share")
        there = cells.where("tokens > 0").select(name).distinct()
        goal = goal.join(there, name, "left_semi")
        scale = goal.agg(F.sum("share").alias("scale"))
        goal = goal.join(F.broadcast(scale)).select(name, (F.col("share") / F.col("scale")).alias("goal"))
        goals[name] = written(goal, "goals")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(1, total))))
    for _ in range(sweeps):
        worst = F.lit(0.0)
        for name in DIMENSIONS:
            sums = now.groupBy(name).agg(F.sum("weight").alias("sum"))
            rate = sums.join(goals[name], name, "left").select(
                name,
                F.when(F.col("sum") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("sum"))
                .otherwise(0.0)
                .alias("rate"),
            )
            now = now.join(rate, name).withColumn("weight", F.col("weight") * F.col("rate"))
            now = now.withColumn(
                f"off_{name}", F.when(F.col("rate") > 0, F.abs(F.col("rate") - 1)).otherwise(0.0)
            ).drop("rate")
            worst = F.greatest(worst, F.col(f"off_{name}"))
        now = written(now.withColumn("off", worst).drop(*(f"off_{c}" for c in DIMENSIONS)), "raked")
        off = now.agg(F.max("off")).first()[0]
        now = now.drop("off")
        if off is None or off <= tolerance:
            break
    else:
        warnings.warn(f"a marginal is off by {off:.2g} of its target after {sweeps} sweeps", stacklevel=2)
    return now


def probabilities(raked: DataFrame, fraction: float) -> DataFrame:
    """raked with `probability`: proportional to weight / tokens, at most 1, so that the
    expected tokens are `fraction` of all (fewer only if no cell has more to give). Cells
    without tokens get the fraction itself. Each round but the last finds more cells that give
    all they have, so the rounds end by themselves."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    rate = F.col("weight") / F.col("tokens")
    scale = fraction * total
    while True:
        full = F.col("tokens") <= F.col("weight") * scale
        row = raked.where("tokens > 0").agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not row.free:
            break
        better = max(0.0, fraction * total - row.full) / row.free
        if better <= scale * (1 + 1e-9):
            break
        scale = better
    return raked.withColumn(
        "probability",
        F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * scale)).otherwise(fraction),
    )


def mix(
    docs: DataFrame,
    targets: DataFrame | None = None,
    fraction: float = 0.7,
    text: str = "text",
) -> DataFrame:
    """All rows of docs with topic, n_tokens, probability and selected.

    docs: doc_id, text, source, lang and more. targets: (dimension, level, share); by default
    the square roots of the levels' shares of tokens, which lifts small levels. Null sources
    and languages are the level "(none)". Texts without tokens are drawn with the fraction.
    Equal rows share their draw, and a row's draw depends on its own values and its cell's
    probability alone. Columns named as the new ones are replaced. An empty table gives an
    empty table.

    Cells are summed before anything is shuffled, so a hot source costs no more than others.
    """
    kept = docs.drop(*(c for c in docs.columns if c.lower() in NEW))
    own = _own(F.col(f"`{text}`"))
    levels = [F.col(f"__{c}").alias(c) for c in DIMENSIONS]
    narrow = kept.withColumns(own).select(*levels, F.col("__tokens").alias("tokens"))
    cells = narrow.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = written(cells, "cells")
    raked = rake(cells, tempered_targets(cells) if targets is None else targets)
    chances = written(probabilities(raked, fraction), "chances")
    few = chances.count() <= BROADCAST_CELLS
    chances = chances.select(
        *(F.col(c).alias(f"__{c}") for c in DIMENSIONS), F.col("probability").alias("__p")
    )
    keys = [f"__{c}" for c in DIMENSIONS]
    joined = kept.withColumns(own).join(F.broadcast(chances) if few else chances, keys)
    return joined.select(
        *(F.col(f"`{c}`") for c in kept.columns),
        F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"),
        F.col("__p").alias("probability"),
        (F.col("__u") < F.col("__p")).alias("selected"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs).drop("text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are drawn; repeated rows share their draw. See mix for nulls,
    empty texts and tables; columns named as the new ones keep their values."""
    docs, columns = aside(docs, NEW)
    return mix(docs).where("selected").select(*columns)

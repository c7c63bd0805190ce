"""Service graphs: edges from calls, neighbourhoods, reachability, order and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled, settled_counting


def runtime_edges(executions: DataFrame) -> DataFrame:
    """(source, kind, target, n): CALLS per caller and callee, and RETRIES where a call was
    resent. The caller is the call's, or else the execution's service; unknown ends give no
    edge."""
    calls = executions.select("service", F.explode("downstream_calls").alias("call")).select(
        F.coalesce("call.caller", "service").alias("source"),
        F.col("call.callee").alias("target"),
        F.col("call.retries").alias("retries"),
    )
    sums = calls.dropna(subset=["source", "target"]).groupBy("source", "target").agg(
        F.count("*").alias("calls"), F.count_if(F.col("retries") > 0).alias("resent")
    )
    kinds = F.array(
        F.struct(F.lit("CALLS").alias("kind"), F.col("calls").alias("n")),
        F.struct(F.lit("RETRIES").alias("kind"), F.col("resent").alias("n")),
    )
    return sums.select("source", "target", F.inline(kinds)).where("n > 0").select("source", "kind", "target", "n")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kind, other, direction) of the given nodes."""
    out = edges.select(F.col("source").alias("node"), "kind", F.col("target").alias("other"), F.lit("out").alias("direction"))
    into = edges.select(F.col("target").alias("node"), "kind", F.col("source").alias("other"), F.lit("in").alias("direction"))
    return out.union(into).join(nodes, "node", "left_semi").distinct()


def topology(edges: DataFrame) -> DataFrame:
    """(node, targets, dependents): counts of distinct direct CALLS and DEPENDS_ON ends."""
    pairs = edges.where(F.col("kind").isin("CALLS", "DEPENDS_ON")).select("source", "target").distinct()
    out = pairs.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("targets"))
    into = pairs.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("dependents"))
    return out.join(into, "node", "full").select(
        "node", F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("dependents", F.lit(0)).alias("dependents")
    )


def reachable(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, hops): all nodes that a start leads to, with the fewest hops. A start is
    its own only if a circle leads back; depth bounds the hops."""
    pairs = settled(edges.select("source", "target").distinct(), "pairs")
    first = starts.select(F.col("node").alias("start")).distinct().join(pairs.withColumnRenamed("source", "start"), "start")
    return spread(pairs, first.select("start", F.col("target").alias("node")), depth)


def spread(pairs: DataFrame, first: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, hops): the distinct first (start, node) with one hop, and all that pairs (source, target)
    lead on to, with the fewest hops. Each round joins the frontier, drops what is known and is
    written; depth bounds the hops."""
    front = known = settled(first.withColumn("hops", F.lit(1)), "front")
    hops = 1
    while not front.isEmpty() and (depth is None or hops < depth):
        hops += 1
        ahead = front.join(pairs.withColumnRenamed("source", "node"), "node").select("start", F.col("target").alias("node")).distinct()
        front = settled(ahead.join(known, ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)), "front")
        known = known.unionByName(front)
    return known


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops, boundary): what lies within depth hops, the last hop marked."""
    found = reachable(edges, roots, depth)
    return found.withColumn("boundary", F.col("hops") == depth)


def migration_order(edges: DataFrame) -> DataFrame:
    """(node, level): level 0 has no source, the next only sources before it; nodes in circles,
    and those behind them, have no level. A round takes off the nodes without open sources."""
    open_ = settled(edges.select("source", "target").distinct(), "open")
    left = settled(open_.select(F.col("source").alias("node")).union(open_.select("target")).distinct(), "left")
    done, level = None, 0
    while True:
        ready = left.join(open_.select(F.col("target").alias("node")), "node", "left_anti")
        ready = settled(ready.withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        left = settled(left.join(ready, "node", "left_anti"), "left")
        open_ = settled(open_.join(ready.withColumnRenamed("node", "source"), "source", "left_anti"), "open")
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.union(rest)


def cycles(edges: DataFrame) -> DataFrame:
    """(node, circle): nodes of strongly connected sets of two or more, or with an edge to
    themselves; circle is the set's smallest node. No table exceeds the edges: nodes that lack
    a source or a target are taken off; each other node gets the smallest node that leads to it
    as its colour; what leads back to that node within the colour is its set, and the edges
    of sets found, or between colours, go."""
    pairs = settled(edges.select("source", "target").dropna().distinct(), "pairs")
    own = settled(pairs.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("circle")), "own")
    left = settled(pairs.where("source <> target"), "left")
    found = own.limit(0)
    while not (left := _trimmed(left)).isEmpty():
        colours = _colours(left)
        ends = left.join(colours.toDF("source", "one").hint("merge"), "source").join(colours.toDF("target", "other").hint("merge"), "target")
        left = settled(ends.where("one = other").select("source", "target", F.col("one").alias("circle")), "left")
        front = settled(colours.where("node = circle"), "front")
        sets = front
        while not front.isEmpty():
            back = left.join(front.withColumnRenamed("node", "target").hint("merge"), ["target", "circle"])
            back = back.select(F.col("source").alias("node"), "circle").distinct()
            front = settled(back.join(sets.hint("merge"), ["node", "circle"], "left_anti"), "front")
            sets = settled(sets.unionByName(front), "sets")
        found = found.unionByName(sets)
        gone = sets.select("node")
        left = left.join(gone.toDF("source").hint("merge"), "source", "left_anti").join(gone.toDF("target").hint("merge"), "target", "left_anti")
        left = settled(left.select("source", "target"), "left")
    single = found.groupBy("circle").agg(F.count("*").alias("n")).where("n = 1").select("circle")
    found = found.join(single.hint("merge"), "circle", "left_anti").select("node", "circle")
    return found.unionByName(own.join(found.hint("merge"), "node", "left_anti"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges without those that start at a node without source or end at one without target."""
    size = edges.count()
    while True:
        sources, targets = edges.select(F.col("source").alias("target")), edges.select(F.col("target").alias("source"))
        kept = edges.join(targets.hint("merge"), "source", "left_semi").join(sources.hint("merge"), "target", "left_semi")
        edges, before = settled(kept.select("source", "target"), "trimmed"), size
        if (size := edges.count()) in (0, before):
            return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, circle): the smallest node that leads to each node, or the node itself."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    colours = settled(nodes.withColumn("circle", F.col("node")), "colours")
    while True:
        ahead = edges.join(colours.withColumnRenamed("node", "source").hint("merge"), "source").select(F.col("target").alias("node"), F.col("circle").alias("new"))
        best = ahead.groupBy("node").agg(F.min("new").alias("new"))
        step = colours.join(best.hint("merge"), "node", "left").withColumn("less", F.coalesce(F.col("new") < F.col("circle"), F.lit(False)))
        step = settled(step.select("node", F.when(F.col("less"), F.col("new")).otherwise(F.col("circle")).alias("circle"), "less"), "colours")
        colours = step.select("node", "circle")
        if step.where("less").isEmpty():
            return colours


def chains(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(path): all simple chains of two hops or more, up to `most` hops, or until none grows. Round by
    round, each chain grows by the edges of its end that lead to no node it has. There may be
    many more of them than edges; a bound on the hops bounds that."""
    pairs = settled(edges.select("source", "target").where("source <> target").distinct(), "pairs")
    front = pairs.select(F.array("source", "target").alias("path"))
    found, hops = front.limit(0), 1
    while most is None or hops < most:
        hops += 1
        end = F.element_at("path", -1)
        grown = front.withColumn("source", end).join(pairs, "source")
        grown = grown.where(~F.array_contains("path", F.col("target")))
        front, more = settled_counting(grown.select(F.concat("path", F.array("target")).alias("path")), "chains", F.lit(True))
        if not more:
            break
        found = found.union(front)
    return found


def chain_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, at, source, target, kind, subject): the hops of chains (path), from 1, with the subjects
    of the edges (source, kind, target, subject) between their ends, a row each."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(
        i.alias("at"), F.element_at("path", i).alias("source"), F.element_at("path", i + 1).alias("target")))
    hops = paths.select("path", F.inline(pairs))
    return hops.join(edges.select("source", "target", "kind", "subject").distinct(), ["source", "target"]).select("path", "at", "source", "target", "kind", "subject")


def merged(*graphs: DataFrame) -> DataFrame:
    """Entities (id, name, ..) of several graphs; the first graph's definition of an id stays."""
    ranked = None
    for rank, graph in enumerate(graphs):
        one = graph.withColumn("rank", F.lit(rank))
        ranked = one if ranked is None else ranked.unionByName(one, allowMissingColumns=True)
    values = [c for c in ranked.columns if c not in ("id", "rank")]
    first = F.min_by(F.struct(*values), F.struct("rank", *values))
    return ranked.groupBy("id").agg(first.alias("of")).select("id", "of.*")


def conflicts(*graphs: DataFrame) -> DataFrame:
    """Ids that graphs define in several ways."""
    every = None
    for graph in graphs:
        every = graph if every is None else every.unionByName(graph)
    values = [c for c in every.columns if c != "id"]
    return every.groupBy("id").agg(F.count_distinct(F.struct(*values)).alias("definitions")).where("definitions > 1")

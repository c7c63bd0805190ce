"""A Merkle manifest of a table, with nodes labelled by nested intervals.

Every tree's leaves are ranked, and a node carries the interval of leaf ranks that it
covers: level by level, runs of eight intervals close under a parent that covers their union
and keeps the run. Going down again, the nodes of a level meet their parents in buckets of
the level, by containment of the intervals, and what a parent covers outside a child's
interval is the child's siblings: those that end before it and those that begin after it. The
roots of the trees are the leaves of one tree above, labelled alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import table, written

FANOUT = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sealed(*values: Column) -> Column:
    """Hex sha256 of values, each '-' if null, else its bytes' number, ':' and the value."""
    parts = []
    for value in values:
        plain = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(hashes: Column) -> Column:
    """Hex sha256 of an array of hex digests, one after another."""
    return F.sha2(F.array_join(hashes, ""), 256)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, ...) with `lo` (rank in its tree by the columns of `order`, nulls first)
    and `n` (the tree's leaves).

    Rows are dealt in ranges, whatever their tree, and numbered inside each; a range's
    share of each tree is counted, and what stands before it is added. Rows equal in
    all of `order` are dealt by the place where they were read.
    """
    keys = [F.col("tree").asc(), *(F.col(c).asc_nulls_first() for c in order)]
    placed = leaves.withColumn("read_at", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(*keys, F.col("read_at")).sortWithinPartitions(*keys, "read_at")
    at = F.monotonically_increasing_id()
    numbered = written(dealt.drop("read_at").withColumn("at", at), "manifest-order")
    split = numbered.withColumn("part", F.shiftright("at", 33))
    before = W.partitionBy("tree").orderBy("part")  # a row for each range of a tree
    shares = split.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    shares = shares.select(
        "tree", "part", "first",
        (F.sum("rows").over(before) - F.col("rows")).alias("before"),
        F.sum("rows").over(W.partitionBy("tree")).alias("n"),
    )
    shares = written(shares, "manifest-shares")
    return (
        split.join(shares, ["tree", "part"])
        .withColumn("lo", F.col("before") + F.col("at") - F.col("first"))
        .drop("part", "at", "first", "before")
    )


def bucket(width: int) -> Column:
    """First leaf under the parent of a node that covers at most `width` leaves."""
    return F.col("lo") - F.col("lo") % F.lit(width * FANOUT)


def grown(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The levels above leaves (tree, lo, n, hash): level k holds (tree, lo, hi, n, hash, run),
    a node for each 8**k leaves, down to one per tree. run: (lo, hi, hash) of its children."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    below = leaves.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", "hash")
    levels, width = [], 1
    while width < most:
        run = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash"))).alias("run")
        nodes = below.where(F.col("n") > width).groupBy("tree", bucket(width).alias("start"), "n").agg(run)
        nodes = nodes.select(
            "tree",
            F.col("start").alias("lo"),
            F.array_max("run.hi").alias("hi"),
            "n",
            folded(F.col("run.hash")).alias("hash"),
            "run",
        )
        levels.append(written(nodes, f"manifest-{name}"))
        below, width = levels[-1], width * FANOUT
    return levels


def attached(nodes: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """nodes (tree, lo, hi, ...) with `path`: the siblings on the way up, nearest first, each
    level as the digests before and after; and with `top`, handed down. parents: (tree, lo,
    hi, run, path, top); width: the leaves under a whole node."""
    over = parents.select(
        "tree",
        F.col("lo").alias("start"),
        F.struct("lo", "hi").alias("over"),
        F.col("run").alias("around"),
        F.col("path").alias("on"),
        "top",
    )
    met = nodes.withColumn("start", bucket(width)).join(over, ["tree", "start"])
    met = met.where((F.col("over.lo") <= F.col("lo")) & (F.col("hi") <= F.col("over.hi")))
    before = F.filter("around", lambda r: r["hi"] <= F.col("lo"))["hash"]
    after = F.filter("around", lambda r: r["lo"] >= F.col("hi"))["hash"]
    own = F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))
    return met.select(*nodes.columns, F.concat(F.array(own), F.col("on")).alias("path"), "top")


def proven(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """leaves (tree, lo, n, ...) with their whole `path` and `top`. tops: (tree, path, top),
    what each tree's root is given and hands down, so that no tree's leaves meet."""

    def whole(nodes: DataFrame, level: int, parents: DataFrame | None) -> DataFrame:
        width = FANOUT**level
        roots = nodes.where(F.col("n") <= width).join(tops, "tree").select(*nodes.columns, "path", "top")
        if parents is None:
            return roots
        return attached(nodes.where(F.col("n") > width), parents, width).unionByName(roots)

    paths = None
    for level in range(len(levels), 0, -1):
        paths = whole(levels[level - 1], level, paths)
    return whole(leaves.withColumn("hi", F.col("lo") + 1), 0, paths).drop("hi")


def roots_of(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of each tree's root."""
    out = leaves.where("n = 1").select("tree", "hash")
    for level, nodes in enumerate(levels, 1):
        out = out.unionByName(nodes.where(F.col("n") <= FANOUT**level).select("tree", "hash"))
    return out


def proof(path: Column) -> Column:
    """Hex sha256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def refolded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, leaf, columns of `order`, ...) with `subroot`, `root` and `path` (before,
    after: the siblings' digests, level by level up to the root).

    In each tree leaves ascend by `order`, nulls first; end `order` with "leaf", so that rows
    equal in it are alike. Trees ascend by their UTF-8 bytes; the null tree is one of its own
    and comes first. A tree of one leaf has that leaf as subroot, a table of one tree has
    its subroot as root. Repeated rows are leaves each; an empty table gives an empty table.
    Rows keep their other columns, but none may be named as the operator's own: lo, n,
    hash, path, top, start, over, around, on, subroot, root, part, at, first, before, read_at.

    A tree with a third of all leaves is dealt in ranges like any other; no group holds
    more than eight nodes, and each level is an eighth of the one below.
    """
    spark = leaves.sparkSession
    known = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("+"), "tree"), F.lit("")))
    placed = ranked(known, order).withColumn("hash", F.col("leaf"))
    levels = grown(placed, "tree")
    named = roots_of(placed, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    subroots = written(ranked(named, ["name"]), "manifest-subroots")
    over = grown(subroots, "root")
    root = roots_of(subroots, over).first()
    ends = spark.range(1).select(
        F.lit("").alias("tree"),
        F.array().cast("array<struct<before string, after string>>").alias("path"),
        F.lit(root["hash"] if root else None).cast("string").alias("top"),
    )
    names = proven(subroots, over, ends).select(
        F.col("name").alias("tree"), "path", F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top")
    )
    out = proven(placed, levels, written(names, "manifest-tops"))
    tree = F.expr("substring(tree, 2)")
    return out.select(
        F.when(F.col("tree") != "", tree).alias("tree"),
        *(c for c in out.columns if c not in ("tree", "lo", "n", "hash", "top", "path")),
        "top.subroot",
        "top.root",
        "path",
    )


def document_manifest(docs: DataFrame) -> DataFrame:
    """A leaf of doc_id, source, lang, n_chars and text for every row of docs, in the tree of its
    language: doc_id, lang, leaf, subroot, root, path, and `tampered`, the leaf that the text
    with A-Z lower-cased gives, where 3 divides the crc32 of doc_id as text (else null).

    Nulls have a leaf form of their own, in any column; a null doc_id comes first in its tree
    and is never tampered with; a text of any length is hashed whole. Rows with equal doc_id
    stand in the order of their leaves, repeated rows are leaves each. Other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", UPPER, UPPER.lower())
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        "doc_id",
        F.col("lang").alias("tree"),
        sealed(*named, F.col("text")).alias("leaf"),
        F.when(tampers, sealed(*named, lower)).alias("tampered"),
    )
    return manifest(written(leaves, "manifest-leaves"), ["doc_id", "leaf"]).withColumnRenamed("tree", "lang")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = refolded(F.coalesce("tampered", "leaf"), F.col("path"))
    return (
        document_manifest(table(spark, sf_dir, "documents"))
        .select(
            "doc_id", "leaf", "subroot", "root",
            proof(F.col("path")).alias("proof_sha256"),
            again.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def _sql() -> str:
    """Twelve levels, more than any table here needs; each closes runs of eight nodes."""
    def level(k: int, name: str) -> str:
        return f"""
{name}{k + 1} AS (
  SELECT tree, lo // 8 AS lo, max(n) AS n, sha256(string_agg(h, '' ORDER BY lo)) AS h, list(h ORDER BY lo) AS run
  FROM {name}{k} WHERE n > {8**k} GROUP BY tree, lo // 8),"""

    def up(k: int, name: str, source: str) -> str:
        sibs = f"list_concat(p.run[:(x.lo // {8**k} % 8)], p.run[(x.lo // {8**k} % 8) + 2:])"
        return f"""
{source}{k + 1} AS (
  SELECT x.* REPLACE (
           x.proof || coalesce(array_to_string({sibs}, ''), '') AS proof,
           CASE WHEN p.run IS NULL THEN x.folded ELSE sha256(
             array_to_string(list_concat(p.run[:(x.lo // {8**k} % 8)], [x.folded],
                                         p.run[(x.lo // {8**k} % 8) + 2:]), '')) END AS folded)
  FROM {source}{k} x LEFT JOIN {name}{k + 1} p ON p.tree = x.tree AND p.lo = x.lo // {8 ** (k + 1)}),"""

    def tops(name: str) -> str:
        return " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n <= {8**k}" for k in range(DEEP + 1))

    deep = range(DEEP)
    part = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"
    head = " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree,
         sha256({head} || {part.format("text")}) AS leaf,
         sha256({head} || {part.format(lower)}) AS lowered,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(CAST(doc_id AS VARCHAR))),
             lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
             lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS inverted
  FROM documents),
placed AS (
  SELECT doc_id, tree, leaf, CASE WHEN xor(inverted, 4294967295) % 3 = 0 THEN lowered ELSE leaf END AS given,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lo,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
a0 AS (SELECT tree, lo, n, leaf AS h FROM placed),{"".join(level(k, "a") for k in deep)}
subroots AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS lo, count(*) OVER () AS n
             FROM ({tops("a")})),
b0 AS (SELECT '' AS tree, lo, n, h FROM subroots),{"".join(level(k, "b") for k in deep)}
roots AS ({tops("b")}),
x0 AS (SELECT doc_id, leaf, tree, lo, '' AS proof, given AS folded FROM placed),{"".join(up(k, "a", "x") for k in deep)}
y0 AS (
  SELECT x.doc_id, x.leaf, '' AS tree, s.lo, s.h AS subroot, r.h AS root, x.proof, x.folded
  FROM x{DEEP} x JOIN subroots s ON s.name = x.tree JOIN roots r ON true),{"".join(up(k, "b", "y") for k in deep).rstrip(",")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM y{DEEP}
"""


DEEP = 8  # levels that the SQL spells out: 16 million leaves a tree
OP11_SQL = _sql()

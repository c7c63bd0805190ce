"""Links between operations: through schemas that they share, caches, versions and clients.

A schema that a third of all operations use would make pairs of all of them; so what shares a
schema is given as membership and as pairs with one representative, which say the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checkpoints import settled
from spanloom.operators.rules import version_pairs
from spanloom.sources.openapi import Contracts
from spanloom.sources.pointers import json_nodes, keywords, operation_pointer

PREFIX = "#/components/schemas/"
WRITES = ("POST", "PUT", "PATCH", "DELETE")
#: Header axes that part cache entries by who asks.
PRINCIPAL = ("authorization", "cookie", "proxy-authorization")


def schema_uses(c: Contracts) -> DataFrame:
    """(project, method, path, schema): component schemas that references below an operation name, as a
    written table. The references need not be looked up, so the walk gives those alone."""

    def named(node: tuple) -> bool:
        return node[5] in ("ref", "dynamic") and node[1].startswith("/paths/") and node[4].startswith(PREFIX)

    at = F.concat(F.lit("/"), F.array_join(F.slice(F.split("pointer", "/"), 2, 3), "/"))
    sites = json_nodes(c.texts, named, keywords).select("project", "doc", F.col("parent").alias("pointer"), F.col("value").alias("ref"))
    sites = sites.select("project", "doc", at.alias("at"), F.expr(f"substring(ref, {len(PREFIX) + 1})").alias("schema")).distinct()
    known = c.schemas.select("project", F.col("name").alias("schema")).distinct()
    own = c.operations.select("project", "doc", "method", "path", operation_pointer(F.col("path"), F.col("method")).alias("at"))
    uses = own.join(sites.hint("merge"), ["project", "doc", "at"]).join(known.hint("merge"), ["project", "schema"], "left_semi")
    return settled(uses.select("project", "method", "path", "schema").distinct(), "uses")


def named_operations(operations: DataFrame) -> DataFrame:
    """operations (project, method, path, identity, operation_id) by each name that a policy may use:
    (project, method, path, writes, subject)."""
    verb = F.upper("method")
    names = F.array_distinct(F.array_compact(F.array("identity", "path", F.concat_ws(" ", verb, "path"), F.nullif("operation_id", F.lit("")))))
    return operations.select("project", "method", "path", verb.isin(*WRITES).alias("writes"), F.explode(names).alias("subject"))


def cache_links(operations: DataFrame, uses: DataFrame, policies: DataFrame) -> DataFrame:
    """(project, source, kind, target): WRITES from an operation to a schema that a cached read serves,
    SERVED_BY from the schema to the read. policies: (project, subject), by a read's identity or
    path. A write invalidates the reads that two steps lead to; `invalidations` lists such pairs."""
    unit = F.concat_ws(" ", F.upper("method"), "path")
    shared = operations.join(uses.hint("merge"), ["project", "method", "path"]).select("project", "identity", "path", unit.alias("unit"), F.upper("method").isin(*WRITES).alias("writes"), "schema")
    reads = shared.where("not writes").withColumn("subject", F.explode(F.array_distinct(F.array("identity", "path"))))
    cached = reads.join(policies.select("project", "subject").distinct().hint("merge"), ["project", "subject"], "left_semi").select("project", "schema", "unit").distinct()
    writers = shared.where("writes").select("project", "schema", "unit").distinct()
    both = writers.select("project", "schema").distinct().join(cached.hint("merge"), ["project", "schema"], "left_semi")
    return writers.join(both.hint("merge"), ["project", "schema"], "left_semi").select("project", F.col("unit").alias("source"), F.lit("WRITES").alias("kind"), F.col("schema").alias("target")).unionByName(
        cached.join(both.hint("merge"), ["project", "schema"], "left_semi").select("project", F.col("schema").alias("source"), F.lit("SERVED_BY").alias("kind"), F.col("unit").alias("target"))
    )


def invalidations(links: DataFrame) -> DataFrame:
    """(project, writer, read, schema): pairs of cache_links, by the first schema that they share. A
    schema of m writers and n cached reads gives m times n; for links of chosen operations."""
    writes = links.where("kind = 'WRITES'").select("project", F.col("source").alias("writer"), F.col("target").alias("schema"))
    reads = links.where("kind = 'SERVED_BY'").select("project", F.col("target").alias("read"), F.col("source").alias("schema"))
    return writes.join(reads.hint("merge"), ["project", "schema"]).groupBy("project", "writer", "read").agg(F.min("schema").alias("schema"))


def cache_findings(operations: DataFrame, uses: DataFrame, policies: DataFrame) -> DataFrame:
    """(project, id, subject, detail).

    policies: (project, place, subject, layer, ttl, key, stale, vary (array), scope); place orders the
    policies of a subject. APICACHE001: cached reads whose first policy has a ttl and whose schemas
    are written, with the first writer and how many there are, once for each schema; 002: subjects whose layers declare
    different stale policies; 003: keys that policies of a writer and of a reader share. Such keys are
    PARTITIONED instead where their policies vary by different headers, by one that tells who asks,
    or have different scopes; detail says which."""
    first = policies.groupBy("project", "subject").agg(F.min_by("ttl", "place").alias("ttl")).where("ttl is not null")
    links = cache_links(operations, uses, policies)
    written = links.where("kind = 'WRITES'").groupBy("project", F.col("target").alias("schema")).agg(F.count("*").alias("n"), F.min("source").alias("one"))
    unit = F.concat_ws(" ", F.upper("method"), "path")
    reads = operations.where(~F.upper("method").isin(*WRITES)).select("project", "method", "path", unit.alias("unit"), F.explode(F.array_distinct(F.array("identity", "path"))).alias("subject"))
    served = reads.join(first.hint("merge"), ["project", "subject"]).join(uses.hint("merge"), ["project", "method", "path"]).select("project", "subject", "schema").distinct()
    counted = served.join(written.hint("merge"), ["project", "schema"]).groupBy("project", "subject").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    stale = counted.select("project", F.lit("APICACHE001").alias("id"), "subject", F.concat_ws(" ", F.col("n").cast("string"), "one").alias("detail"))
    layered = policies.where("stale <> ''").groupBy("project", "subject").agg(F.count_distinct("stale").alias("kinds"), F.array_sort(F.collect_set("stale")).alias("all"))
    layers = policies.groupBy("project", "subject").agg(F.count_distinct("layer").alias("layers"))
    torn = layered.join(layers.hint("merge"), ["project", "subject"]).where("kinds > 1 and layers > 1")
    conflicts = torn.select("project", F.lit("APICACHE002").alias("id"), "subject", F.array_join("all", ",").alias("detail"))
    names = named_operations(operations).groupBy("project", "subject").agg(F.bool_or("writes").alias("writes"), F.bool_or(~F.col("writes")).alias("reads"))
    keyed = policies.where("key <> ''").join(names.hint("merge"), ["project", "subject"], "left")
    vary = F.array_sort(F.array_distinct(F.transform(F.coalesce("vary", F.array().cast("array<string>")), F.lower)))
    keyed = keyed.withColumn("axes", F.when(F.size(vary) > 0, vary)).withColumn("scope", F.lower(F.nullif("scope", F.lit(""))))
    personal = F.arrays_overlap("axes", F.array(*(F.lit(p) for p in PRINCIPAL)))
    keys = keyed.groupBy("project", "key").agg(
        F.count("*").alias("n"), F.bool_or("writes").alias("writes"), F.bool_or("reads").alias("reads"), F.count_distinct("axes").alias("axes"),
        F.bool_or(personal).alias("personal"), F.count_distinct("scope").alias("scopes"),
    ).where("n > 1 and writes and reads")
    why = F.when(F.col("axes") > 1, "VARY").when(F.col("personal"), "PRINCIPAL").when(F.col("scopes") > 1, "SCOPE")
    joint = keys.withColumn("why", why).select(
        "project", F.when(F.col("why").isNull(), "APICACHE003").otherwise("PARTITIONED").alias("id"), F.col("key").alias("subject"), F.coalesce("why", F.lit("")).alias("detail")
    )
    return reduce(DataFrame.unionByName, [stale, conflicts, joint])


def overlap_risks(operations: DataFrame, policies: DataFrame) -> DataFrame:
    """(project, subject, path): cache policies whose subject holds the path of an operation that
    writes, literally. Paths begin with a slash, so the texts that begin at a slash of a subject
    meet them by equality; a subject of n characters and s slashes has at most n s of them."""
    writes = operations.where(F.upper("method").isin(*WRITES) & F.col("path").startswith("/")).select("project", "path").distinct()
    asked = policies.select("project", "subject").distinct()
    starts = F.filter(F.sequence(F.lit(1), F.length("subject")), lambda i: F.substr("subject", i, F.lit(1)) == "/")
    runs = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.length("subject") - i + 1), lambda n: F.substr("subject", i, n))))
    runs = F.when(F.length("subject") > 0, F.array_distinct(runs))
    return asked.withColumn("path", F.explode(runs)).join(writes.hint("merge"), ["project", "path"]).select("project", "subject", "path")


def migration_links(c: Contracts, calls: DataFrame) -> DataFrame:
    """(project, source, kind, target, via). SCHEMA_DEP: operations that share a schema, each with the
    first of the schema's operations; VERSION_DEP: operations of one path in adjacent versions;
    CLIENT_IMPACT: clients (calls: project, client, method?, path) and the operations they call,
    any method where a call tells none. Operations are 'METHOD path'."""
    unit: Column = F.concat_ws(" ", F.upper("method"), "path")
    members = schema_uses(c).select("project", "schema", unit.alias("unit"))
    first = members.groupBy("project", "schema").agg(F.min("unit").alias("one"))
    shared = members.join(first.hint("merge"), ["project", "schema"]).where("unit <> one").groupBy("project", F.col("one").alias("source"), F.col("unit").alias("target")).agg(F.min("schema").alias("via"))
    named = c.operations.select("project", "path", unit.alias("unit"), F.upper("method").alias("verb")).distinct()
    versions = version_pairs(named, ("project",)).select("project", F.col("earlier").alias("source"), F.col("later").alias("target"), F.col("tail").alias("via"))
    met = calls.select("project", "client", F.upper("method").alias("asked"), "path").distinct().join(named.hint("merge"), ["project", "path"])
    met = met.where("asked is null or asked = '' or asked = verb")
    used = met.select("project", F.concat(F.lit("client:"), "client").alias("source"), F.col("unit").alias("target"), F.col("path").alias("via")).distinct()
    return reduce(DataFrame.unionByName, [
        shared.withColumn("kind", F.lit("SCHEMA_DEP")), versions.withColumn("kind", F.lit("VERSION_DEP")), used.withColumn("kind", F.lit("CLIENT_IMPACT")),
    ]).select("project", "source", "kind", "target", "via")

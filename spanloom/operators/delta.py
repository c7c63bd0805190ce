"""Snapshots and the differences between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import short_hash

#: Domains whose facts must be known.
REQUIRED = ("contracts", "routes", "clients", "graph", "runtime", "security", "reliability")


def snapshot_id(findings: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row (snapshot_id, rows): a hash of all rows that their order does not change and that
    the ignored (measurement) columns do not enter. Rows are hashed, equal hashes counted in
    65,536 groups, and the groups' digests combined, so no list holds all rows."""
    values = [c for c in sorted(findings.columns) if c not in ignore]
    row = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
    hashed = findings.select(row.alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    parts = hashed.groupBy(F.substring("row", 1, 4).alias("part")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "row", "n"))), ","), 256).alias("digest"),
        F.sum("n").alias("n"),
    )
    whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "digest"))), ",")
    return parts.agg(F.sha2(whole, 256).alias("snapshot_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def save_snapshot(findings: DataFrame, path: str, label: str, ignore: tuple[str, ...] = ()) -> str:
    """Writes the rows under their content id and returns it. Rows that are there already under that
    id are kept as they are; the catalogue beside them gets a line (snapshot_id, label, rows)."""
    spark = findings.sparkSession
    row = snapshot_id(findings, ignore).first()
    name = row.snapshot_id
    there = _exists(spark, path) and not list_snapshots(spark, path).where(F.col("snapshot_id") == name).isEmpty()
    if not there:
        findings.write.mode("overwrite").parquet(f"{path}/rows/snapshot_id={name}")
    line = spark.range(1).select(F.lit(name).alias("snapshot_id"), F.lit(label).alias("label"), F.lit(row.rows).alias("rows"), F.current_timestamp().alias("saved"))
    line.write.mode("append").parquet(f"{path}/catalogue")
    return name


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalogue")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, label, rows): one row a snapshot, with the label of its last saving."""
    lines = spark.read.parquet(f"{path}/catalogue")
    return lines.groupBy("snapshot_id").agg(F.max_by("label", F.struct("saved", "label")).alias("label"), F.max("rows").alias("rows"))


def load_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of the one snapshot whose id, beginning of the id, or any label is `name`."""
    lines = spark.read.parquet(f"{path}/catalogue")
    found = lines.where(F.col("snapshot_id").startswith(name) | (F.col("label") == name)).select("snapshot_id").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} snapshot fits {name!r}")
    return spark.read.parquet(f"{path}/rows/snapshot_id={found[0].snapshot_id}")


def first_rows(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key in order, with the number of `more` that are left out."""
    place = W.partitionBy(*keys).orderBy(*order)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("more"))
    kept = rows.withColumn("__at", F.row_number().over(place)).where(F.col("__at") <= k).drop("__at")
    return kept.join(counts, keys).withColumn("more", F.greatest(F.lit(0).cast("long"), F.col("more") - k))


def regressions(
    changes: DataFrame, findings: tuple[DataFrame, DataFrame], operations: tuple[DataFrame, DataFrame],
    unknowns: tuple[DataFrame, DataFrame],
) -> DataFrame:
    """(id, key, severity) from an old and a new snapshot: APITEMP001 breaking changes (key,
    classification), 002 new findings (key, severity) of severity CRITICAL or HIGH, 003 operations
    (key) that are gone, 004 facts (subject, missing) of a required domain that are newly unknown."""
    def of(rows: DataFrame, check: str, severity: str) -> DataFrame:
        return rows.select(F.lit(check).alias("id"), "key", F.lit(severity).alias("severity"))

    broken = changes.where("classification = 'BREAKING'")
    domain = F.split("subject", ":")[0]
    facts = [u.select("subject", "missing").distinct() for u in unknowns]
    lost = facts[1].where(domain.isin(*REQUIRED)).join(facts[0], ["subject", "missing"], "left_anti")
    gone = operations[0].select("key").distinct().join(operations[1], "key", "left_anti")
    return (
        of(broken, "APITEMP001", "HIGH").union(of(snapshot_regressions(*findings), "APITEMP002", "HIGH"))
        .union(of(gone, "APITEMP003", "HIGH")).union(of(lost.withColumn("key", F.concat_ws("|", "subject", "missing")), "APITEMP004", "MEDIUM"))
    )


def keyed_findings(findings: DataFrame) -> DataFrame:
    """(key, digest, evidence) of findings (id, entity_ids, description, evidence count, place):
    the key is id|first entity, and of equal keys the last place counts."""
    subject = F.coalesce(F.try_element_at("entity_ids", F.lit(1)), F.lit(""))
    values = [c for c in sorted(findings.columns) if c != "place"]
    digest = short_hash(F.to_json(F.struct(*values)))
    return findings.select(
        F.concat("id", F.lit("|"), subject).alias("key"), digest.alias("digest"), "evidence", "place"
    ).groupBy("key").agg(F.max_by(F.struct("digest", "evidence"), "place").alias("of")).select("key", "of.*")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change, evidence_added, evidence_removed): added, removed or changed rows by key and
    digest; equal rows are left out."""
    a = old.select("key", F.col("digest").alias("was"), F.col("evidence").alias("had"))
    b = new.select("key", F.col("digest").alias("now"), F.col("evidence").alias("has"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") != F.col("now"), "changed")
    )
    had, has = (F.coalesce(c, F.lit(0)) for c in ("had", "has"))
    return a.join(b, "key", "full").withColumn("change", change).where("change is not null").select(
        "key",
        "change",
        F.greatest(F.lit(0), has - had).alias("evidence_added"),
        F.greatest(F.lit(0), had - has).alias("evidence_removed"),
    )


def transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(transition) of names (kind, name): '+capability:x', '-domain:y'."""
    def signed(rows: DataFrame, sign: str) -> DataFrame:
        return rows.select(F.concat(F.lit(sign), "kind", F.lit(":"), "name").alias("transition"))

    a, b = old.select("kind", "name").distinct(), new.select("kind", "name").distinct()
    return signed(b.exceptAll(a), "+").union(signed(a.exceptAll(b), "-"))


def snapshot_regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """APITEMP002: findings of severity CRITICAL or HIGH that the old snapshot does not have;
    old, new: (key, severity)."""
    worse = new.where(F.col("severity").isin("CRITICAL", "HIGH"))
    return worse.join(old.select("key"), "key", "left_anti").select(
        F.lit("APITEMP002").alias("id"), "key", "severity"
    )


def key_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change) of the distinct keys that only one snapshot has."""
    a, b = old.select("key").distinct(), new.select("key").distinct()
    gone = a.exceptAll(b).withColumn("change", F.lit("removed"))
    return b.exceptAll(a).withColumn("change", F.lit("added")).union(gone)

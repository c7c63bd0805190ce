"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

1. Equal texts fold into one representative. Document frequencies of five-word shingles are
   counted over all representatives in a table of 2**20 hashed cells. What other shingles add
   to a cell is taken off again, so rare shingles count as rare at any corpus size with the same
   memory. A shingle weighs (1 + log tf) * (1 + log((1 + n) / (1 + df))).
2. Improved consistent weighted sampling draws 36 samples of each representative's shingles;
   two texts agree on a sample with the probability of their weighted Jaccard similarity.
   Minima of 36 hashes are a second set, in which all shingles weigh the same: there the
   probability is that of the plain Jaccard similarity. It is needed as the many copies of one
   text make their common shingles frequent: these weigh little then and the edits much.
3. Twelve bands of three samples of each set put representatives that are similar in either
   measure into common buckets (a pair at 0.8 in one of them is missed by 1 in 5,000).
4. In a bucket every member is verified against one hub, so pairs grow with members, not
   their square. Links join documents into classes. Buckets that still hold several classes
   are compared block by block: the members outside a bucket's largest class with all others,
   first on their samples, then on their texts. Only links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spanloom.llm.common import code_points, list_array, small_batches, table, take_turn, text_slices, written
from spanloom.llm.components import components
from spanloom.llm.counting import dense_sums
from spanloom.llm.hashing import BASE, INVERSE, MIX, folded, mixed, power

WORDS = 5
CELLS = 1 << 20
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS  # of each set: weighted, then plain
AGREE = 18  # equal samples of a set that make a pair worth verifying; of pairs at 0.8 1 in 40,000 has fewer
BLOCK = 2048  # members of a bucket compared with others at once
SMALL = 64  # members up to which buckets are compared many at a time
POOLED = 4096  # members of small buckets in one group, about
POOL = 1 << 16


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, ...]:
    """Pools of r, log c and beta, and a multiplier per sample that picks from them."""
    rng = np.random.default_rng(8)
    r, c = rng.gamma(2, 1, POOL), rng.gamma(2, 1, POOL)
    odd = rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    return *(x.astype(np.float32) for x in (r, np.log(c), rng.random(POOL))), odd


def shingles(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles (sorted hashes) and how often each occurs.

    Words are runs of letters and digits, case folded. A text of one to four words is one
    shingle; a text without words has none.
    """
    points, lengths = code_points([t + " " for t in texts])
    chars = folded()[points].astype(np.uint64)
    inside = chars > 0
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * power(BASE, len(chars)))])
    words = mixed((total[ends] - total[starts]) * power(INVERSE, len(chars))[starts])
    runs = sum(
        np.roll(words, -k) * power(BASE, WORDS + 1)[k + 1] for k in range(WORDS)
    ) if len(words) else words
    last = np.searchsorted(starts, np.cumsum(lengths))
    first = 0
    for end in last:
        size = end - first
        if size >= WORDS:
            yield np.unique(mixed(runs[first : end - WORDS + 1]), return_counts=True)
        elif size:
            one = (words[first:end] * power(BASE, WORDS + 1)[1 : size + 1]).sum()
            yield mixed(np.array([one], np.uint64)), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = end


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Documents per cell of shingle hashes; a bounded table, CELLS numbers for any input."""

    def add(held: np.ndarray, batch: pa.RecordBatch) -> None:
        take_turn("near duplicates")
        for _, texts in text_slices(batch.column(0)):
            cells = np.concatenate([h for h, _ in shingles(texts)]) >> np.uint64(44)
            held += np.bincount(cells.astype(np.int64), minlength=CELLS)

    return dense_sums(docs.select(F.col(text).alias("text")), add, CELLS)


def rarity(counts: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency of each cell's shingles, from `n` documents.

    All shingles of a cell share its count. Those that are there by chance are, with four
    deviations, taken off; a shingle's frequency is what is left, 1 at least.
    """
    chance = counts.mean()
    frequency = np.maximum(1.0, counts - chance - 4 * np.sqrt(chance))
    return 1 + np.log(np.maximum(1.0, (1 + n) / (1 + frequency)))


def weigh(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[(hashes >> np.uint64(44)).astype(np.int64)]


def sample(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The consistent weighted samples of one document, as SAMPLES hashes."""
    rate, log_c, beta, odd = _draws()
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    log_w = np.log(weights).astype(np.float32)
    each = np.arange(SAMPLES)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14)]
        place = ((odd[:, None] * h) >> np.uint64(48)).astype(np.int32)
        r, b = rate[place], beta[place]
        steps = np.floor(log_w[at : at + (1 << 14)] / r + b)
        score = log_c[place] - r * (steps - b) - r
        least = score.argmin(axis=1)
        low = score[each, least]
        code = h[least] + steps[each, least].astype(np.int64).astype(np.uint64) * MIX[0]
        out = np.where(low < best, mixed(code), out)
        best = np.minimum(best, low)
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The consistent samples of one document with equal weights, as SAMPLES hashes."""
    odd = _draws()[-1]
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        best = np.minimum(best, (odd[:, None] * hashes[at : at + (1 << 14)]).min(axis=1))
    return mixed(best)


def both_samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The upper halves of the weighted samples and then of the plain ones."""
    every = np.concatenate([sample(hashes, weights), minima(hashes)])
    return (every >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similarity(left: tuple, right: tuple, idf: np.ndarray, plain: bool = True) -> float:
    """Weighted Jaccard of two texts' (hashes, counts), or with `plain` the plain one where that is
    larger; 0 if either has no shingle. With it, a pair with enough shingles in common is linked even
    where its rare shingles, which weigh most, differ."""
    (ha, ca), (hb, cb) = left, right
    if not len(ha) or not len(hb):
        return 0.0
    wa, wb = weigh(ha, ca, idf), weigh(hb, cb, idf)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = np.minimum(wa[ia], wb[ib]).sum()
    weighted = common / (wa.sum() + wb.sum() - common)
    return float(max(weighted, len(ia) / (len(ha) + len(hb) - len(ia))) if plain else weighted)


def _signed(docs: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    @arrow_udf("array<int>")
    def signature(column: pa.Array) -> pa.Array:
        take_turn("near duplicates")
        held, lengths, none = [], [], np.zeros(0, np.int32)
        for _, texts in text_slices(column):
            for h, c in shingles(texts):
                held.append(both_samples(h, weigh(h, c, shared.value)) if len(h) else none)
                lengths.append(len(held[-1]))
        values = np.concatenate(held) if held else none
        return list_array(values, np.array(lengths, np.int64), pa.int32())

    return docs.select(F.col("doc_id").alias("rep"), signature.asNondeterministic()(F.col(text)).alias("samples"))


def _verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast, at: float, plain: bool) -> DataFrame:
    """The pairs (a, b) of documents whose texts are at least `at` similar."""
    @arrow_udf("double")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        take_turn("near duplicates")
        out = []
        for start, mine in text_slices(left):
            others = right.slice(start, len(mine)).to_pylist()
            for a, b in zip(shingles(mine), shingles([t or "" for t in others]), strict=True):
                out.append(similarity(a, b, shared.value, plain))
        return pa.array(out, pa.float64())

    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("left")), "a").join(
        texts.select(F.col("rep").alias("b"), F.col("text").alias("right")), "b"
    )
    return both.where(similar.asNondeterministic()("left", "right") >= at).select("a", "b")


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs with at least AGREE equal samples of either set."""
    left = reps.select(F.col("rep").alias("a"), F.col("samples").alias("left"))
    right = reps.select(F.col("rep").alias("b"), F.col("samples").alias("right"))

    def same(first: int) -> Column:
        one, other = (F.slice(c, first, SAMPLES) for c in ("left", "right"))
        return F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda e: e))

    enough = (same(1) >= AGREE) | (same(1 + SAMPLES) >= AGREE)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _compare(group: pa.Table, idf: np.ndarray, threshold: float, plain: bool) -> list[tuple[int, int]]:
    """Links between different classes of one block (low: True) and another (high: True).

    Pairs that share an earlier band are left to that band's bucket. Pairs are verified from
    the best agreement down, and not if a link found here has joined their classes already.
    """
    band, rep = group.column("band")[0].as_py(), group.column("rep").to_pylist()
    label = group.column("label").to_numpy()
    samples = np.stack(group.column("samples").to_numpy(zero_copy_only=False)).T.copy()
    rows = np.flatnonzero(group.column("low").to_numpy(zero_copy_only=False))
    cols = np.flatnonzero(group.column("high").to_numpy(zero_copy_only=False))
    texts, known, joined, found = group.column("text"), {}, {}, []
    across = samples[:, cols]

    def of(i: int) -> tuple:
        if i not in known:
            known[i] = next(shingles([texts[i].as_py() or ""]))
        return known[i]

    for at in range(0, len(rows), 256):
        mine = rows[at : at + 256]
        down = samples[:, mine]
        sets = np.zeros((2, len(mine), len(cols)), np.int8)
        wanted = label[mine][:, None] != label[cols]
        for b in range(2 * BANDS):
            same = np.zeros(wanted.shape, np.int8)
            for k in range(b * ROWS, (b + 1) * ROWS):
                same += (down[k][:, None] == across[k]).view(np.int8)
            sets[b // BANDS] += same
            if b < band:
                wanted &= same < ROWS
        equal = sets.max(axis=0)
        i, j = np.nonzero(wanted & (equal >= AGREE))
        order = np.argsort(-equal[i, j], kind="stable")
        for a, b in zip(mine[i[order]].tolist(), cols[j[order]].tolist(), strict=True):
            one, other = _root(joined, label[a]), _root(joined, label[b])
            if one != other and similarity(of(a), of(b), idf, plain) >= threshold:
                joined[max(one, other)] = min(one, other)
                found.append((rep[a], rep[b]))
    return found


def _compare_pool(group: pa.Table, idf: np.ndarray, threshold: float, plain: bool) -> list[tuple[int, int]]:
    """Links between different classes within each of many small buckets, as _compare has them."""
    bucket, band, label, rep = (group.column(c).to_numpy() for c in ("bucket", "band", "label", "rep"))
    samples = np.stack(group.column("samples").to_numpy(zero_copy_only=False))
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1))
    sizes = np.diff(np.append(starts, len(order)))
    left, right = [], []
    for size in np.unique(sizes).tolist():  # at most SMALL
        first = starts[sizes == size][:, None]
        i, j = np.triu_indices(size, 1)
        left.append(order[(first + i).ravel()])
        right.append(order[(first + j).ravel()])
    a, b = np.concatenate(left), np.concatenate(right)
    other = label[a] != label[b]
    a, b, kept, scores = a[other], b[other], [], []
    for at in range(0, len(a), 1 << 13):
        x, y = a[at : at + (1 << 13)], b[at : at + (1 << 13)]
        equal = samples[x] == samples[y]
        shared = equal.reshape(len(x), 2 * BANDS, ROWS).all(axis=2)
        most = equal.reshape(len(x), 2, SAMPLES).sum(axis=2).max(axis=1)
        good = np.flatnonzero((shared.argmax(axis=1) == band[x]) & (most >= AGREE))
        kept.append(good + at)
        scores.append(most[good])
    at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    at = at[np.argsort(-np.concatenate(scores), kind="stable")] if len(at) else at
    wanted = np.unique(np.concatenate([a[at], b[at]]))
    texts = group.column("text").take(pa.array(wanted)).to_pylist()
    known = dict(zip(wanted.tolist(), shingles([t or "" for t in texts]), strict=True)) if texts else {}
    joined: dict[int, int] = {}
    found = []
    for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True):
        one, two = (_root(joined, int(label[i])) for i in (x, y))
        if one != two and similarity(known[x], known[y], idf, plain) >= threshold:
            joined[max(one, two)] = min(one, two)
            found.append((int(rep[x]), int(rep[y])))
    return found


def _root(joined: dict[int, int], x: int) -> int:
    while x in joined:
        x = joined[x]
    return x


def _blockwise(
    members: DataFrame, labels: DataFrame, known: DataFrame, shared: Broadcast, threshold: float, plain: bool
) -> DataFrame:
    """Links (a, b) between the classes that share a bucket.

    members: (bucket, band, rep). labels: (rep, label). known: (rep, samples, text). The
    largest class of a bucket is cut into blocks, the rest into others; each block of the
    rest meets every block of both, so a group holds two blocks whatever the bucket's size.
    Buckets of up to SMALL members are compared in groups of about POOLED members.
    """
    marked = members.join(labels, "rep", "left").select(
        "bucket", "band", "rep", F.coalesce("label", "rep").alias("label")
    )
    classes = marked.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = (
        classes.groupBy("bucket")
        .agg(
            F.max_by("label", F.struct("n", "label")).alias("main"),
            F.max("n").alias("n_main"),
            F.sum("n").alias("size"),
        )
        .where("size > n_main")
        .select(
            "bucket",
            "main",
            F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"),
            F.ceil((F.col("size") - F.col("n_main")) / BLOCK).cast("int").alias("others"),
            "size",
        )
    )
    mixed = written(mixed, "mixed")
    small = marked.join(mixed.where(F.col("size") <= SMALL).select("bucket"), "bucket")
    total = mixed.where(F.col("size") <= SMALL).agg(F.sum("size")).first()[0] or 0
    pool = F.pmod(F.xxhash64("bucket", F.lit(8)), F.lit(-(-total // POOLED) or 1))
    mixed = mixed.where(F.col("size") > SMALL)

    def key(kind: int, first: Column, second: Column, low: Column, high: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            first.alias("first"),
            second.alias("second"),
            low.alias("low"),
            high.alias("high"),
        )

    own = F.pmod(F.xxhash64("rep"), F.when(F.col("main") == F.col("label"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    yes, no = F.lit(True), F.lit(False)
    as_main = F.transform(
        F.sequence(F.lit(0), F.col("others") - 1), lambda j: key(0, F.col("block"), j, no, yes)
    )
    as_other = F.concat(
        F.transform(
            F.sequence(F.lit(0), F.col("mains") - 1), lambda i: key(0, i, F.col("block"), yes, no)
        ),
        F.transform(
            F.sequence(F.lit(0), F.col("others") - 1),
            lambda j: key(
                1,
                F.least(F.col("block"), j),
                F.greatest(F.col("block"), j),
                F.col("block") <= j,
                F.col("block") >= j,
            ),
        ),
    )
    dealt = marked.join(mixed, "bucket").withColumn("block", own)
    dealt = dealt.select(
        "bucket",
        "band",
        "rep",
        "label",
        F.explode(F.when(F.col("main") == F.col("label"), as_main).otherwise(as_other)).alias("to"),
    ).select("bucket", "band", "rep", "label", "to.*")

    def compare(group: pa.Table) -> pa.Table:
        take_turn("near duplicates")
        found = _compare(group, shared.value, threshold, plain)
        kind = pa.int64()
        return pa.table(
            {"a": pa.array([x for x, _ in found], kind), "b": pa.array([y for _, y in found], kind)}
        )

    def compare_pool(group: pa.Table) -> pa.Table:
        take_turn("near duplicates")
        found = _compare_pool(group, shared.value, threshold, plain)
        kind = pa.int64()
        return pa.table(
            {"a": pa.array([x for x, _ in found], kind), "b": pa.array([y for _, y in found], kind)}
        )

    grouped = dealt.join(known, "rep").groupBy("bucket", "kind", "first", "second")
    pooled = small.withColumn("pool", pool).join(known, "rep").groupBy("pool")
    links = "a long, b long"
    return grouped.applyInArrow(compare, links).union(pooled.applyInArrow(compare_pool, links))


def _one_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row for each doc_id, that of its greatest text, beside all rows
    without one; and the doc_ids of several rows, or None."""
    rows = docs.where("doc_id is not null").groupBy("doc_id").count()
    several = written(rows.where("count > 1").select("doc_id"), "several")
    if several.isEmpty():
        return docs, None
    greatest = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return docs.join(several, "doc_id", "left_anti").union(greatest), several


def near_classes(docs: DataFrame, text: str = "text", threshold: float = 0.8, plain: bool = True) -> DataFrame:
    """near_duplicates with h1, h2 and h3, which tell texts apart, for documents (one row a
    doc_id)."""
    docs, _ = _one_each(docs.select("doc_id", F.col(text).alias("text")))
    own, key = F.col("text"), ["h1", "h2", "h3"]
    keyed = docs.select(
        "doc_id", F.xxhash64(own).alias("h1"), F.crc32(own.cast("binary")).alias("h2"), F.length(own).alias("h3")
    )
    keyed = written(keyed, "keyed")
    reps = written(keyed.where("h3 is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "reps")
    chosen = reps.where("rep is not null").select(F.col("rep").alias("doc_id"))
    distinct = docs.join(chosen, "doc_id", "left_semi")
    idf = rarity(document_frequencies(distinct), chosen.count())
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # CELLS numbers, once for all steps
    drawn = written(_signed(distinct, shared, "text").where(F.size("samples") > 0), "signed")
    band = [
        F.xxhash64(F.lit(i), *(F.col("samples")[i * ROWS + j] for j in range(ROWS)))
        for i in range(2 * BANDS)
    ]
    banded = drawn.select("rep", F.posexplode(F.array(*band)).alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(sizes, "bucket"), "members")
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    known = docs.withColumnRenamed("doc_id", "rep").join(weight.select("rep"), "rep", "left_semi")
    known = known.join(drawn, "rep")
    known = written(known, "known")
    hubs = (
        members.join(weight, "rep")
        .groupBy("bucket")
        .agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    )
    stars = (
        members.join(hubs, "bucket")
        .where("rep <> hub")
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        .distinct()
    )
    links = written(_verified(_agreeing(stars, known), known, shared, threshold, plain), "links")
    labels = components(links).withColumnRenamed("node", "rep")
    more = written(_blockwise(members, labels, known, shared, threshold, plain), "links")
    if not more.isEmpty():
        labels = components(links.union(more)).withColumnRenamed("node", "rep")

    named = reps.join(labels, "rep", "left").select(
        *key, F.coalesce("label", "rep").alias("class_id")
    )
    return keyed.join(named, key, "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = 0.8, plain: bool = True) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id that the document is linked to, one row a row.

    Two documents are linked if their texts are equal or the Jaccard similarity of their
    five-word shingles, weighted by TF-IDF or (unless `plain` is False) plain, is at least
    `threshold`; classes are the connected components. A null text is linked to none; equal empty texts, or equal texts
    without words, form a class. Texts are used whole, however long. Rows that share a doc_id
    are one document, which has the greatest of their texts; a row with a null doc_id gets its
    copies' class, or null if it has none. An empty table gives an empty table; other columns
    are ignored.
    """
    found = near_classes(docs, text, threshold, plain).select("doc_id", "class_id")
    _, several = _one_each(docs.select("doc_id", F.col(text).alias("text")))
    if several is None:
        return found
    named = docs.select("doc_id").join(several, "doc_id", "left_semi").join(found, "doc_id")
    return found.join(several, "doc_id", "left_anti").union(named.select("doc_id", "class_id"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the row with its smallest doc_id.

    Of rows that share that doc_id the least in column order stays. Rows with a null doc_id
    stay if no other row has their text, or one of them if only such rows do; those with a
    null text too have no copies and stay. An empty table gives an empty table.
    """
    small_batches(spark)
    found = written(near_classes(docs), "classes")
    extra = found.where("doc_id <> class_id").select("doc_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = F.min(F.struct(*columns)).alias("__row")
    kept = docs.where("doc_id is not null").join(extra, "doc_id", "left_anti").select(*columns)
    several = written(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if not several.isEmpty():
        one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("__row.*")
        kept = kept.join(several, "doc_id", "left_anti").select(*columns).union(one)
    lone = written(found.where("doc_id is null"), "unnamed")
    if not lone.isEmpty():
        unnamed = docs.where("doc_id is null")
        alone = lone.where("class_id is null and h3 is not null").select("h1", "h2", "h3").distinct()
        own = F.col("text")
        keyed = unnamed.select(
            F.struct(*columns).alias("__row"), F.xxhash64(own).alias("h1"),
            F.crc32(own.cast("binary")).alias("h2"), F.length(own).alias("h3"),
        )
        one = keyed.join(alone, ["h1", "h2", "h3"], "left_semi").groupBy("h1", "h2", "h3")
        kept = kept.union(unnamed.where("text is null").select(*columns))
        kept = kept.union(one.agg(F.min("__row").alias("__row")).select("__row.*"))
    return kept

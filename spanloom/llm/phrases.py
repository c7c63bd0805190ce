"""Collocated phrases by partitioned mining.

Documents are dealt into a few shards. A phrase that stands in a language often enough stands
in some shard at least as often as the shard's share of the language's words asks; so each shard
is mined at its own, proportionally lower support, what any shard finds frequent are
the candidates, and these are counted over all documents. Phrases grow by a word a level, and
only out of shorter ones that are frequent.

Mining goes by 64-bit hashes of phrases: equal hashes can only add candidates. Counting goes
by the phrases themselves, so counts are exact. What is frequent reaches the tasks as a bitmap of
hashes of at most 32 MB, which may let more phrases be counted, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches, table, take_turn, written
from spanloom.llm.hashing import mixed
from spanloom.llm.words import Words, blocks, byte_table, word_hashes, words_of

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = byte_table(b" \t", BREAKS)
SHARDS = 4  # a power of two; few, so that a support of 10 stays above 2 in a shard of average size
BITS = (1 << 20, 1 << 28)  # of a bitmap, least and most
PARTS = 1024  # of a bitmap, each made by one task
TURN = np.uint64(0x9E3779B97F4A7C15)  # an odd number: orders the words of a phrase


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set, by its highest bits."""
    at = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame) -> Broadcast:
    """A bitmap of the column h, sixteen bits a row or as many as are allowed, in all tasks."""
    rows, bits = hashes.count(), BITS[0]
    while bits < min(BITS[1], 16 * rows):
        bits *= 2
    shift, width = 64 - bits.bit_length() + 1, bits // PARTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(shift)
            part = (at // np.uint64(width)).astype(np.int64)
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(width, np.bool_))[(at[part == p] % np.uint64(width)).astype(np.int64)] = True
        for p, flags in held.items():
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([p], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()])}
            )

    part = F.shiftrightunsigned("h", 64 - PARTS.bit_length() + 1)
    out = np.zeros((PARTS, width // 8), np.uint8)
    for row in hashes.select("h").repartition(part).mapInArrow(fill, "part int, bits binary").collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out.ravel())


class Runs:
    """The phrases of a block: hashes by their first word's place, and which of them stand
    within a piece and are made of frequent parts."""

    def __init__(self, words: Words, langs: list[str]) -> None:
        self.words = words
        of = {lang: np.uint64(xxhash.xxh64_intdigest(lang)) for lang in set(langs)}
        seeds = np.array([of[lang] for lang in langs], np.uint64)
        self.h = mixed(word_hashes(words.names)[words.ids] ^ seeds[words.text])
        self.first, self.size = self.h, 1
        self.ok = np.ones(len(self.h), np.bool_)

    def keep(self, bits: np.ndarray) -> None:
        self.ok &= has(bits, self.h)

    def longer(self) -> None:
        """A word more: both phrases that are a word shorter must be kept."""
        size, piece = self.size, self.words.piece
        fits = self.ok[:-1] & self.ok[1:] & (piece[: len(self.ok) - 1] == piece[size:])
        self.h = mixed(self.h[:-1] * TURN + self.first[size:])
        self.ok, self.size = fits, size + 1


def _runs(rows: list[tuple], texts: list[bytes], below: list[Broadcast]) -> Runs:
    """The phrases that are a word longer than the last of `below` tells frequent ones of."""
    runs = Runs(words_of(texts, TABLE), [r[0] for r in rows])
    for bits in below:
        if len(runs.h) < 2:
            runs.ok = runs.ok[:0]
            return runs
        runs.keep(bits.value)
        runs.longer()
    return runs


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, shard, word, h, f) from docs (lang, shard, text): rows of a block's words with a
    null shard, and a row of all words of a shard with a null word; to be summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("phrases")
        for rows, texts in blocks(batches, BREAKS):
            runs = _runs(rows, texts, [])
            words, size = runs.words, max(1, len(runs.words.names))
            names = sorted({r[0] for r in rows})
            at = {lang: i for i, lang in enumerate(names)}
            of = np.array([at[r[0]] for r in rows])[words.text]
            keys, first, counts = np.unique(of * size + words.ids, return_index=True, return_counts=True)
            groups, sums = np.unique(np.array([at[r[0]] * SHARDS + r[1] for r in rows])[words.text], return_counts=True)
            none = pa.nulls(len(groups), pa.string())
            lang = pa.array(names, pa.string()).take(pa.array(np.concatenate([keys // size, groups // SHARDS])))
            word = words.names.take(pa.array(keys % size)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    lang,
                    pa.concat_arrays([pa.nulls(len(keys), pa.int32()), pa.array(groups % SHARDS, pa.int32())]),
                    pa.concat_arrays([word, none]),
                    pa.array(np.concatenate([runs.h[first].view(np.int64), np.zeros(len(groups), np.int64)])),
                    pa.array(np.concatenate([counts, sums])),
                ],
                names=["lang", "shard", "word", "h", "f"],
            )

    return docs.mapInArrow(count, "lang string, shard int, word string, h long, f long")


def mined(docs: DataFrame, below: list[Broadcast]) -> DataFrame:
    """(h): the phrases that are frequent in a shard. docs: lang, shard, local (the shard's
    support), text; below: what is frequent of each smaller size. The shard takes the lowest bits of
    h, so that rows are summed by one number; should hashes meet, the lower support counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("phrases")
        for rows, texts in blocks(batches, BREAKS):
            runs = _runs(rows, texts, below)
            at = np.flatnonzero(runs.ok)
            of = runs.words.text[at]
            hashes = runs.h[at] & ~np.uint64(SHARDS - 1) | np.array([r[1] for r in rows], np.uint64)[of]
            local = np.array([r[2] for r in rows], np.int32)[of]
            for least in np.unique(local).tolist():
                found, counts = np.unique(hashes[local == least], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)),
                        pa.array(np.full(len(found), least, np.int32)),
                        pa.array(counts.astype(np.int32)),
                    ],
                    names=["h", "local", "f"],
                )

    rows = docs.mapInArrow(count, "h long, local int, f int")
    sums = rows.groupBy("h").agg(F.sum("f").alias("f"), F.min("local").alias("local"))
    return sums.where("f >= local").select("h")


def counted(docs: DataFrame, below: list[Broadcast], candidates: Broadcast, support: int) -> DataFrame:
    """(lang, phrase, h, a): the candidates that stand in a language `support` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("phrases")
        for rows, texts in blocks(batches, BREAKS):
            runs = _runs(rows, texts, below)
            at = np.flatnonzero(runs.ok)
            at = at[has(candidates.value, runs.h[at])]
            if not len(at):
                continue
            words, size = runs.words, len(runs.words.names)
            names = sorted({r[0] for r in rows})
            place = {lang: i for i, lang in enumerate(names)}
            key = np.array([place[r[0]] for r in rows])[words.text[at]]
            for k in range(runs.size):  # numbers of a block's phrases: exact, as hashes need not be
                _, key = np.unique(key * size + words.ids[at + k], return_inverse=True)
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            at = at[first]
            parts = [words.names.take(pa.array(words.ids[at + k])) for k in range(runs.size)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
            lang = pa.array([rows[i][0] for i in words.text[at].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [lang, phrase.cast(pa.large_string()).cast(pa.string()), pa.array(runs.h[at].view(np.int64)), pa.array(counts)],
                names=["lang", "phrase", "h", "a"],
            )

    rows = docs.mapInArrow(count, "lang string, phrase string, h long, a long")
    return rows.groupBy("lang", "phrase").agg(F.min("h").alias("h"), F.sum("a").alias("a")).where(F.col("a") >= support)


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exact for counts under 10**15."""
    return F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))"
        f" div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))"
    )


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact counts per language: its words' number (lang, n), and the words, pairs and triples
    that stand in it `support` times or more (lang, phrase, h, a), as written tables."""
    small_batches(docs.sparkSession)
    cut = docs.select(
        F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(f"`{text}`"), F.lit(SHARDS)).cast("int").alias("shard"),
        F.col(f"`{text}`").alias("text"),
    )
    sums = count_words(cut).groupBy("lang", "shard", "word").agg(F.min("h").alias("h"), F.sum("f").alias("f"))
    sums = written(sums.where(F.col("word").isNull() | (F.col("f") >= support)), "phrases-words")
    words = sums.where("word is not null").select("lang", F.col("word").alias("phrase"), "h", F.col("f").alias("a"))
    shares = sums.where("word is null")
    totals = written(shares.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
    local = F.expr(f"cast((cast({support} as decimal(10,0)) * f + n - 1) div n as int)")
    supports = written(shares.join(totals, "lang").select("lang", "shard", local.alias("local")), "phrases-supports")
    dealt = cut.join(supports, ["lang", "shard"]).select("lang", "shard", "local", "text")
    below, levels = [bitmap(words)], [words]
    for size in (2, 3):
        candidates = bitmap(written(mined(dealt, below), f"phrases-{size}-candidates"))
        found = written(counted(cut.select("lang", "text"), below, candidates, support), f"phrases-{size}")
        candidates.unpersist()
        levels.append(found)
        if size < 3:
            below.append(bitmap(found))
    return totals, *levels


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 10, cover: int = 50, top: int = 2000
) -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n,
    score.

    Texts are lower-cased (A-Z), parted into pieces at .,;:!? and line ends, and into words at
    blanks and tabs. a: how often the phrase stands within pieces, `support` or more; l and r: the
    counts of its parts at the cut with the lowest score (the first of equal ones); n: the
    language's words. A pair is left out if a triple around it has `cover` percent of its count or
    more. The `top` of each language are returned, by score, count and the phrase's bytes.

    A null lang is "und", a null or empty text has no words, repeated rows and copies count each,
    other columns are ignored, an empty table gives an empty table. Texts over 8 MB are cut
    between pieces, so a task holds no more than that, or one piece.
    """
    totals, words, pairs, triples = frequent_phrases(docs, text, lang, support)

    def part(of: DataFrame, name: str) -> DataFrame:
        return of.select("lang", F.col("phrase").alias(f"{name}_part"), F.col("a").alias(name))

    two = (
        pairs.select(
            "lang", "phrase", "a",
            F.substring_index("phrase", " ", 1).alias("l_part"),
            F.substring_index("phrase", " ", -1).alias("r_part"),
        )
        .join(part(words, "l"), ["lang", "l_part"])
        .join(part(words, "r"), ["lang", "r_part"])
        .withColumn("score", cut_score("a", "l", "r"))
    )
    ends = triples.select(
        "lang", "phrase", "a",
        F.substring_index("phrase", " ", 1).alias("l1_part"),
        F.substring_index("phrase", " ", -2).alias("r1_part"),
        F.substring_index("phrase", " ", 2).alias("l2_part"),
        F.substring_index("phrase", " ", -1).alias("r2_part"),
    )
    three = ends
    for of, name in ((words, "l1"), (pairs, "r1"), (pairs, "l2"), (words, "r2")):
        three = three.join(part(of, name), ["lang", f"{name}_part"])
    first = F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"), cut_score("a", "l1", "r1").alias("score"))
    second = F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"), cut_score("a", "l2", "r2").alias("score"))
    three = three.select("lang", "phrase", "a", first.alias("first"), second.alias("second"))
    lowest = F.when(F.col("first.score") <= F.col("second.score"), F.col("first")).otherwise(F.col("second"))
    three = three.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.*")
    inside = ends.select("lang", F.explode(F.array("l2_part", "r1_part")).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = F.coalesce(F.lit(100) * F.col("longer") < F.lit(cover) * F.col("a"), F.lit(True))
    two = two.join(inside, ["lang", "phrase"], "left").where(free)
    kept = two.select("lang", "phrase", "a", "l", "r", "score").unionByName(three)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(32)).alias("salt")
    some = kept.select("*", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best)))
    some = some.where(F.col("rank") <= top)
    whole = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return whole.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))

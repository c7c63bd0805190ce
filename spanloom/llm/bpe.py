"""Byte-level BPE encoding and decoding with a given vocabulary.

A word is a doubly linked list of symbols; a priority queue holds the merge ranks of
neighbouring pairs, and entries whose pair has changed meanwhile are skipped when they
come up. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spanloom.llm.common import Memory, forget_with, list_array, small_batches, table, take_turn, text_slices

#: Fixed value: the word pattern that byte-level vocabularies of this format come with.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HELD = 400_000  # words that a worker remembers; twice, at most, of some 100 bytes each
SLICE = 1 << 22  # characters whose distinct runs are encoded at once


def byte_letters() -> list[str]:
    """The character by which the file format writes each byte: itself if it is printable
    and no space, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    other = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [other.get(b, chr(b)) for b in range(256)]


class ByteBpe:
    """A vocabulary file's merges and strings, and a memory of encoded words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        #: By rank the merged id, and by left id the rank of each right id it merges with.
        self.merged: list[int] = []
        self.ranks: list[dict[int, int]] = [{}] * (1 + max(vocab.values()))
        for pair in data["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left]] = self.ranks[vocab[left]] or {}
            self.ranks[vocab[left]].setdefault(vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])
        get = [self.ranks[x].get for x in self.byte_ids]
        #: The rank of each pair of bytes, -1 if there is none.
        self.first = [g(x, -1) for g in get for x in self.byte_ids]
        value = {c: b for b, c in enumerate(letters)}
        strings = {i: bytes(value[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        strings |= {i: s.encode() for s, i in self.special.items()}
        self.table = pa.array(map(strings.get, range(max(strings) + 1)), pa.large_binary())
        self.words = regex.compile(WORDS)
        self.cut = (
            regex.compile("|".join(f"({regex.escape(s)})" for s in self.special))
            if self.special
            else None
        )
        self.by_word = Memory(HELD)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: always the pair of lowest rank next, leftmost first."""
        size, first, ranks, merged = len(word), self.first, self.ranks, self.merged
        ids = [self.byte_ids[b] for b in word]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        now = [first[a << 8 | b] for a, b in zip(word, word[1:])]  # rank of the pair at a symbol
        now.append(-1)
        queue = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if now[i] != rank:
                continue  # stale: the pair has changed since
            j, left = after[i], before[i]
            after[i] = right = after[j]
            ids[i] = own = merged[rank]
            ids[j] = now[i] = now[j] = -1
            if right < size:
                before[right] = i
                if (found := ranks[own].get(ids[right], -1)) >= 0:
                    now[i] = found
                    heapq.heappush(queue, found << 32 | i)
            if left >= 0:
                now[left] = found = ranks[ids[left]].get(own, -1)
                if found >= 0:
                    heapq.heappush(queue, found << 32 | left)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        if (ids := self.by_word.recall(word)) is None:
            ids = array("i", self.merge(word.encode("utf-8", "surrogatepass"))).tobytes()
            self.by_word.keep(word, ids)
        return ids

    def _run(self, run: str) -> bytes | None:
        """Ids of a run that follows a lone space: mostly one word and one sign of
        punctuation. None if the run does not decide them alone (see encode)."""
        if run.isalpha():
            return self._word(" " + run)
        if run == "" or run[0].isspace() or run[-1].isspace():
            return None
        if run[-1] in ".,!?;:" and run[:-1].isalpha():
            return self._word(" " + run[:-1]) + self._word(run[-1])
        return self._words(" " + run)

    def _words(self, text: str) -> bytes:
        return b"".join(map(self._word, self.words.findall(text)))

    def _whole(self, text: str) -> bytes:
        """Ids of any text; special tokens' strings give their ids."""
        if self.cut is None:
            return self._words(text)
        parts = (p for p in self.cut.split(text) if p)
        return b"".join(
            np.array([self.special[p]], "<i4").tobytes() if p in self.special else self._words(p)
            for p in parts
        )

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after another, and each text's number of ids.

        A lone space between two other characters always starts a word. So texts are cut at
        spaces, the distinct runs of all texts are encoded once each, and every text takes
        its runs' ids. A text with other spacing next to a space, or with a special token, is
        cut into words as a whole.
        """
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        size = split.value_lengths().to_numpy().astype(np.int64)
        runs = split.flatten().dictionary_encode()
        at = runs.indices.to_numpy().copy()
        known = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [self._run(r) for r in known]
        odd = np.array([x is None for x in ids], bool)
        firsts = np.cumsum(size) - size
        odd_texts = np.logical_or.reduceat(odd[at], firsts)
        extra = []
        for i, text in enumerate(texts):
            first = known[at[firsts[i]]]
            if odd_texts[i] or any(s in text for s in self.special):
                size[i] = -size[i]
                extra.append(self._whole(text))
            else:
                extra.append(self._words(first))
        at[firsts] = len(known) + np.arange(len(texts))
        whole = np.flatnonzero(size < 0)
        if len(whole):  # such a text keeps its first run only, which stands for all
            size = np.abs(size)
            kept = np.ones(len(at), bool)
            for i in whole.tolist():
                kept[firsts[i] + 1 : firsts[i] + size[i]] = False
            at = at[kept]
            size[whole] = 1
        held = [x or b"" for x in ids] + extra
        table = pa.array(held, pa.large_binary())
        lengths = np.fromiter(map(len, held), np.int64, len(held))[at] // 4
        starts = np.cumsum(size) - size
        flat = np.frombuffer(joined(table.take(pa.array(at))), "<i4")
        return flat, np.add.reduceat(lengths, starts)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The vocabulary's strings of each document's ids, concatenated."""
        found = self.table.take(pa.array(ids))
        data, ends = joined(found), np.cumsum(np.concatenate([[0], lengths]))
        places = np.frombuffer(found.buffers()[1], np.int64)[ends + found.offset]
        places = (places - places[0]).tolist()
        return [bytes(data[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]


def joined(strings: pa.LargeBinaryArray) -> memoryview:
    """All bytes of an array that a take has made, one string after another."""
    _, places, data = strings.buffers()
    ends = np.frombuffer(places, np.int64)[strings.offset :]
    return memoryview(data or b"")[ends[0] : ends[len(strings)]]


@lru_cache(maxsize=1)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


forget_with(load.cache_clear)


def encode_decode(text: Column, path: str) -> Column:
    """struct(ids array<int>, decoded string) of a text; null and empty texts give an empty
    array and an empty text. Bytes that form no UTF-8 decode to U+FFFD."""

    @arrow_udf("ids array<int>, decoded string")
    def run(column: pa.Array) -> pa.Array:
        take_turn("bpe")
        bpe, ids, sizes, decoded = load(path), [np.zeros(0, np.int32)], [], []
        for _, texts in text_slices(column, SLICE):
            flat, lengths = bpe.encode(texts)
            ids.append(flat)
            sizes.append(lengths)
            decoded += [x.decode("utf-8", "replace") for x in bpe.decode(flat, lengths)]
        lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        parts = [list_array(np.concatenate(ids), lengths, pa.int32()), pa.array(decoded, pa.string())]
        return pa.StructArray.from_arrays(parts, names=["ids", "decoded"])

    return run.asNondeterministic()(text)  # keeps Spark from running it twice for two uses


def decode(ids: Column, path: str) -> Column:
    """The text of an array of token ids (null: null). Bytes that form no UTF-8 become U+FFFD;
    ids outside the vocabulary are an error."""

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        take_turn("bpe")
        bpe = load(path)
        lengths = pc.fill_null(column.value_lengths(), 0).to_numpy().astype(np.int64)
        found = bpe.decode(column.flatten().to_numpy(), lengths)
        texts = (x.decode("utf-8", "replace") for x in found)
        valid = column.is_valid().to_pylist()
        return pa.array((t if v else None for t, v in zip(texts, valid, strict=True)), pa.string())

    return run(ids)


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows of docs with `ids` and the text `decoded` from them.

    Rows are encoded one by one and whole, so ties, repeated rows and their order have no effect;
    null and empty texts have no ids and decode to an empty text; an empty table gives an
    empty table; columns named ids, decoded or __coded are replaced.
    """
    kept = docs.drop(*(c for c in docs.columns if c.lower() in ("ids", "decoded", "__coded")))
    coded = kept.withColumn("__coded", encode_decode(F.col(f"`{text}`"), path))
    return coded.select(*(F.col(f"`{c}`") for c in kept.columns), "__coded.*")


def digests(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs, path).select(
        *(c for c in docs.columns if c != "text"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, tokenizer_path("byte_bpe_50k.json"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document with its token ids and the digests of both directions."""
    small_batches(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    coded = round_trip(docs.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Token ids in Arrow stream files of fixed-size lists.

Documents in ascending doc_id order become one run of ids. Every file is an Arrow stream of
batches with equal-length sequences `ids` and a `mask` (1: an id, 0: padding after a file's
last id), so the id at place p of a file is at row p // LENGTH, item p % LENGTH of a mapped
file. A second stream beside it names the file's documents and where they start.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from spanloom.llm.bpe import byte_letters, joined
from spanloom.llm.common import Memory, forget_with, scratch, small_batches, table, take_turn, text_slices, written

LENGTH = 2048
BATCH = 64  # sequences a record batch
END = 2
HELD = 400_000  # words that a worker remembers; twice, at most, of some 100 bytes each
SLICE = 1 << 22  # characters whose distinct runs are encoded at once
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the library
#: Fixed value: the word pattern of the vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

PLACES = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


class WordEncoder:
    """The tokenizers library's ids of a text, word by word, remembering the words.

    The file's normalizer composes characters, reads all white space as a space and lowers
    case; its words never hold white space. So a run between white space is normalized and
    cut into words on its own, and the library's model turns each new word into ids.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words = regex.compile(WORDS)
        self.by_word = Memory(HELD)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if (ids := self.by_word.recall(word)) is None:
            letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = self._packed([t.id for t in self.model.tokenize(letters)])
            self.by_word.keep(word, ids)
        return ids

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = unicodedata.normalize("NFC", run)
        low = run.lower() if "\u03a3" not in run else "".join(c.lower() for c in run)
        if low.isalpha():
            return self._word(low)
        if low and low[-1] in ".,!?;:" and low[:-1].isalpha():
            return self._word(low[:-1]) + self._word(low[-1])
        found = (PLAIN if low.isascii() else self.words).findall(low)
        return b"".join(map(self._word, found))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of ids.

        Texts are cut at white space, and the distinct runs of all of them are encoded once
        each. The library encodes texts with special tokens or separators as a whole.
        """
        odd = [any(s in t for s in self.special) or ODD_SPACE.search(t) is not None for t in texts]
        split = pc.utf8_split_whitespace(pa.array(("" if o else t for t, o in zip(texts, odd, strict=True)), pa.string()))
        runs = split.flatten().dictionary_encode()
        at = runs.indices.to_numpy()
        held = [self._run(r) for r in runs.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat = np.frombuffer(joined(pa.array(held, pa.large_binary()).take(pa.array(at))), self.kind)
        width = np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, held), np.int64, len(held))[at] // width
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(split.value_lengths().to_numpy().astype(np.int64))])
        cuts = ends[cuts]
        lengths = np.diff(cuts)
        if any(odd):
            parts = [flat[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.frombuffer(self._whole(texts[i]), self.kind)
                lengths[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, lengths


@lru_cache(maxsize=1)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


forget_with(load.cache_clear)


class _SequenceWriter:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, sink: pa.NativeFile, kind: str) -> None:
        self.kind = np.dtype(kind)
        ids, mask = pa.from_numpy_dtype(self.kind), pa.bool_()
        self.schema = pa.schema([("ids", pa.list_(ids, LENGTH)), ("mask", pa.list_(mask, LENGTH))])
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH * LENGTH:
            self._write(self.held // LENGTH)

    def _write(self, rows: int) -> None:
        run = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        ids = np.zeros(rows * LENGTH, self.kind)
        mask = np.zeros(rows * LENGTH, np.bool_)
        taken = min(len(run), len(ids))
        ids[:taken], mask[:taken] = run[:taken], 1
        self.parts, self.held = [run[taken:]], len(run) - taken
        for at in range(0, rows, BATCH):
            cut = slice(at * LENGTH, min(rows, at + BATCH) * LENGTH)
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), LENGTH) for x in (ids, mask)
            ]
            self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._write(-(-self.held // LENGTH))
        self.stream.close()


def write_token_files(
    docs: DataFrame, path: str, folder: str, text: str = "text",
    end: int = END, bytes_a_file: int = 64 << 20,
) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order with the ids of the tokenizer at
    `path`; returns a row per file: file (its number, in order), path, documents, tokens.

    A task sorts one range of doc_ids, encodes each text, adds the end id and writes, under a name of its own attempt
    that it returns, so a task that is run again leaves no half-written file in use. Texts
    cross the network once, whole, however long. Rows with equal or null doc_id stand together,
    nulls first, in the order of a hash of their texts; ranges are cut within them too, and
    equal rows are dealt at random, so a repeated doc_id or row fills no task. A null
    text is empty and has the end id alone; no rows give one file without documents. Other
    columns are ignored, and the files lie in `folder` until the caller removes them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("token files")
        encoder, task = load(path), TaskContext.get()
        number = task.partitionId()
        name = f"{folder}/part-{number:06d}-{task.taskAttemptId()}"
        store, place = pafs.FileSystem.from_uri(name)
        store.create_dir(place.rpartition("/")[0])
        places: list[tuple] = []
        with store.open_output_stream(place + ".ids.arrow") as sink:
            out = _SequenceWriter(sink, encoder.kind)
            for batch in batches:
                names = batch.column(0).to_pylist()
                for at, texts in text_slices(batch.column(1), SLICE):
                    ids, lengths = encoder.encode(texts)
                    ids = np.insert(ids, np.cumsum(lengths), end)
                    starts = out.total + np.cumsum(lengths + 1) - lengths - 1
                    places += zip(names[at : at + len(texts)], starts.tolist(), (lengths + 1).tolist(), strict=True)
                    out.add(ids)
            out.close()
        with (
            store.open_output_stream(place + ".docs.arrow") as sink,
            pa.ipc.new_stream(sink, PLACES) as stream,
        ):
            columns = [pa.array([p[i] for p in places], PLACES.field(i).type) for i in range(3)]
            stream.write_batch(pa.record_batch(columns, schema=PLACES))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        made = ([number], [name], [len(places)], [out.total])
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(made, kinds, strict=True)],
            names=["file", "path", "documents", "tokens"],
        )

    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    files = max(1, -(-docs.agg(size).first()[0] // bytes_a_file))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(text)]
    spread = docs.select("doc_id", text).repartitionByRange(files, *order, F.rand(6))
    columns = "file int, path string, documents long, tokens long"
    made = spread.sortWithinPartitions(*order).mapInArrow(write, columns)
    return written(made, "token-files")


class TokenFile:
    """Random access to one file: mapped where it is local, else read whole. A run of ids
    within one batch is a view of the mapping; masks are bits and are unpacked."""

    def __init__(self, name: str) -> None:
        store, path = pafs.FileSystem.from_uri(name)
        local = isinstance(store, pafs.LocalFileSystem)
        source = (
            pa.memory_map(path + ".ids.arrow")
            if local
            else pa.BufferReader(store.open_input_stream(path + ".ids.arrow").read())
        )
        self.batches = list(pa.ipc.open_stream(source))
        with store.open_input_stream(path + ".docs.arrow") as file:
            self.places = pa.ipc.open_stream(file).read_all()
        self.starts = np.cumsum([0, *(b.num_rows * LENGTH for b in self.batches)])

    def read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = [], []
        first = int(np.searchsorted(self.starts, at, side="right")) - 1
        while n > 0:
            begin = at - self.starts[first]
            taken = int(min(n, self.starts[first + 1] - at))
            for out, column in ((ids, 0), (mask, 1)):
                flat = self.batches[first].column(column).values.slice(begin, taken)
                out.append(flat.to_numpy(zero_copy_only=column == 0))
            at, n, first = at + taken, n - taken, first + 1
        if len(ids) == 1:
            return ids[0], mask[0]
        none = np.zeros(0, np.uint16), np.zeros(0, np.bool_)
        return (np.concatenate(ids), np.concatenate(mask)) if ids else none


def read_documents(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, file, start (ids of all documents before it),
    n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    running = W.orderBy("file")  # one row a file
    starts = files.withColumn("before", F.sum("tokens").over(running) - F.col("tokens"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(name)
                at, n = (file.places.column(c).to_numpy() for c in ("at", "n"))
                sums = []
                for a, size in zip(at.tolist(), n.tolist(), strict=True):
                    ids, mask = file.read(a, size)
                    if not mask.all():
                        raise ValueError(f"padding inside a document of {name}")
                    sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                yield pa.RecordBatch.from_arrays(
                    [
                        file.places.column("doc_id").combine_chunks(),
                        pa.array(np.full(len(at), number, np.int32)),
                        pa.array(at + before),
                        pa.array(n),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "file", "start", "n_tokens", "ids_crc32"],
                )

    kind = "doc_id long, file int, start long, n_tokens long, ids_crc32 long"
    spread = starts.select("file", "path", "before")
    count = max(1, files.count())
    return spread.repartition(count, "file").mapInArrow(read, kind)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, path, scratch(spark, "tokens"))
    return read_documents(files).select("doc_id", "start", "n_tokens", "ids_crc32")

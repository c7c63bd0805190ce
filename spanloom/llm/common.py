"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir.

    Where the setting is absent in local mode (tests), a temporary folder is set once; a
    cluster without it is an error, as executors share no local folder. Nothing here is
    deleted, as later reads depend on it: clear the folder when the job's results are used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: computed once, without lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_memories: weakref.WeakSet = weakref.WeakSet()
_forgetters: list[Callable[[], object]] = []
_turn = [""]


def forget_with(forget: Callable[[], object]) -> None:
    """Has `forget` called where one operator's turn in a worker ends: it drops tables,
    vocabularies and the like that the operator made there."""
    _forgetters.append(forget)


def take_turn(owner: str) -> None:
    """Called by an operator in a Python worker, which Spark hands on from stage to stage: what
    another operator remembered there is freed."""
    if _turn[0] != owner:
        for memory in _memories:
            memory.recent, memory.older = {}, {}
        for forget in _forgetters:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _turn[0] = owner


class Memory:
    """A bounded memory: when `recent` is full it becomes `older`, and what is still used comes
    back from there, so frequent keys stay and rare ones go."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        _memories.add(self)

    def recall(self, key: str) -> bytes | None:
        if (value := self.recent.get(key)) is None:
            if (value := self.older.get(key)) is not None:
                self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(self.recent) >= self.size:
            self.older, self.recent = self.recent, {}
        self.recent[key] = value


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows that a Python worker gets at once, for texts of several KB each. This
    lowers a setting of the session for good, as DataFrames read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def train_fold(id_column="doc_id"):
    """True for rows to learn from: crc32 of the id as text, modulo 3, is not 1 (null: True)."""
    held = F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1
    return ~F.coalesce(held, F.lit(False))


def aside(docs: DataFrame, new: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that an operator's new ones would replace renamed, and the
    columns that give them back under their names."""
    clash = {c: f"__kept_{c}" for c in docs.columns if c.lower() in new}
    back = [F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(clash), back


def text_slices(column: pa.Array, chars: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts (null: empty), each run about `chars` long, with its first row."""
    run, start, held = [], 0, 0
    for i, text in enumerate(column.to_pylist()):
        text = text or ""
        if run and held + len(text) > chars:
            yield start, run
            run, start, held = [], i, 0
        run.append(text)
        held += len(text)
    if run:
        yield start, run


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts as numbers, and each text's length."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), lengths

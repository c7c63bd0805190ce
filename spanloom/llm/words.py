"""Words of many texts at once, as numbers of a block's own dictionary."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from spanloom.llm.hashing import BASE, INVERSE, mixed, power

GAP, BREAK = 0x20, 0x0A
BLOCK = 4 << 20  # bytes of text whose words are numbered together


def byte_table(gaps: bytes, breaks: bytes = b"") -> bytes:
    """For bytes.translate: A-Z lower-cased, what parts words a blank, what parts pieces a line
    feed. Blanks and line feeds must be among gaps or breaks."""
    table = bytearray(bytes(range(256)).lower())
    for marks, to in ((gaps, GAP), (breaks, BREAK)):
        for mark in marks:
            table[mark] = to
    return bytes(table)


class Words(NamedTuple):
    ids: np.ndarray  # of each word, in order
    text: np.ndarray  # of each word, the place of its text in the block
    piece: np.ndarray  # of each word, the number of its piece; pieces end with their text
    names: pa.Array  # the distinct words, as bytes


def words_of(texts: list[bytes], table: bytes) -> Words:
    flat = np.frombuffer(b"\n".join(texts).translate(table), np.uint8)
    inside = (flat != GAP) & (flat != BREAK)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat[inside]))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    first = np.cumsum([0, *(len(t) + 1 for t in texts)][:-1])
    text = np.searchsorted(first, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(flat == BREAK), starts)
    return Words(coded.indices.to_numpy().astype(np.int64), text, piece, coded.dictionary)


def word_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    if not len(names):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(names.buffers()[2], np.uint8)[: offsets[-1]].astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * power(BASE, len(data)), out=sums[1:])
    back = power(INVERSE, len(data) + 1)[offsets[:-1]]
    return mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * back)


def blocks(batches: Iterator[pa.RecordBatch], breaks: bytes = b"") -> Iterator[tuple[list[tuple], list[bytes]]]:
    """The last column of the batches as whole texts (null: empty), about BLOCK bytes at a
    time, each with the values of the other columns. A longer text is cut at its last byte of
    `breaks` within BLOCK bytes, if it has one, or else at the next after them; its parts
    follow each other."""
    rows, texts, held = [], [], 0
    for batch in batches:
        *others, column = batch.columns
        for row, text in zip(zip(*(c.to_pylist() for c in others), strict=True), column.cast(pa.binary()).to_pylist(), strict=True):
            text = text or b""
            while True:
                part = text
                if breaks and len(text) > BLOCK:
                    at = max(text.rfind(bytes([b]), 0, BLOCK) for b in breaks)
                    if at < 0:
                        after = [p for b in breaks if (p := text.find(bytes([b]), BLOCK)) >= 0]
                        at = min(after, default=len(text))
                    part, text = text[: at + 1], text[at + 1 :]
                else:
                    text = b""
                rows.append(row)
                texts.append(part)
                held += len(part)
                if held >= BLOCK:
                    yield rows, texts
                    rows, texts, held = [], [], 0
                if not text:
                    break
    if rows:
        yield rows, texts

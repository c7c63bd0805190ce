"""Noisy-channel restoration of disguised words.

What was written is read as a lattice: a leetspeak character may stand for a letter or for
itself, separators between short pieces may be dropped, a letter repeated three times or
more may be one or two. Viterbi picks the likeliest path under a character 4-gram model.
Every run of letters, digits and leetspeak symbols that has more than one reading is decoded,
its edges included, and so is every row of three or more pieces of up to three characters of
which at least two, and half, are single letters. All else has one path only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import code_points, forget_with, take_turn, text_slices
from spanloom.llm.counting import dense_sums

LETTERS = 27  # 0: no letter; 1-26: a-z, accents removed
ORDER = 4
#: The letters that leetspeak characters stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t",
}
STANDS, ITSELF, DROPPED, KEPT, REPEATED = 1.5, 1.0, 1.0, 0.5, 2.0  # costs in nats

HIT = re.compile(r"[0-9@$!+]|([^\W\d_])\1\1", re.I)
PIECE, GAP = r"(?:[^\W_]|[@$!+])", r"(?:(?![@$!+])[\W_])"
SPACED = re.compile(rf"(?<![^\W_@$!+]){PIECE}{{1,3}}(?:{GAP}+{PIECE}{{1,3}}){{2,}}(?!{PIECE})")
GAPS = re.compile(f"{GAP}+")
HELD = 20_000


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The model's code of each code point: its base letter, case folded."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x250):
        base = unicodedata.normalize("NFKD", chr(point).lower())[0]
        if "a" <= base <= "z":
            out[point] = ord(base) - 96
    return out


forget_with(letter_codes.cache_clear)


def letter_model(docs: DataFrame, text: str = "text", prior: float = 5.0) -> np.ndarray:
    """log P(letter | three before), from the 4-grams of all texts; LETTERS**4 numbers.

    Each order is interpolated with the one below it, `prior` times. Runs of what is no
    letter count as one.
    """

    def add(held: np.ndarray, batch: pa.RecordBatch) -> None:
        take_turn("toxicity")
        for _, texts in text_slices(batch.column(0)):
            points, _ = code_points(["   " + t + " " for t in texts])
            codes = letter_codes()[points].astype(np.int32)
            keep = np.ones(len(codes), bool)
            keep[2:] = (codes[2:] > 0) | (codes[1:-1] > 0)
            codes = codes[keep]
            grams = codes[:-3]
            for k in (1, 2, 3):
                grams = grams * LETTERS + codes[k : len(codes) - 3 + k]
            counted = np.bincount(grams, minlength=LETTERS**ORDER)
            held[: LETTERS**ORDER] += counted

    counts = dense_sums(docs.select(F.col(text).alias("text")), add, LETTERS**ORDER)
    counts = counts.reshape((LETTERS,) * ORDER).astype(np.float64)
    chance = np.full(LETTERS, 1 / LETTERS)
    for order in range(1, ORDER + 1):
        part = counts.sum(axis=tuple(range(ORDER - order)))
        chance = (part + prior * chance) / (part.sum(axis=-1, keepdims=True) + prior)
    return np.log(chance).astype(np.float32)


class Restorer:
    """Restores texts under a letter model; remembers the spans it has decoded."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.reshape(-1).tolist()
        self.codes = letter_codes()
        self.held: dict[str, str] = {}

    def _lattice(self, span: str, spaced: bool) -> list[list[tuple[str, float]]]:
        slots, i = [], 0
        while i < len(span):
            char, end = span[i], i + 1
            while end < len(span) and span[end] == char:
                end += 1
            if char.isalpha() and end - i >= 3:
                costs = {char: REPEATED, char * 2: REPEATED, char * (end - i): 0.0}
                slots.append(list(costs.items()))
                i = end
                continue
            if char in LEET:
                slots.append([(x, STANDS) for x in LEET[char]] + [(char, ITSELF)])
            elif spaced and (gap := GAPS.match(span, i)):
                slots.append([("", DROPPED), (gap[0], KEPT)])
                i = gap.end()
                continue
            else:
                slots.append([(char, 0.0)])
            i += 1
        return slots

    def _viterbi(self, slots: list[list[tuple[str, float]]]) -> str:
        """State: the codes of the last three letters. The span stands between spaces."""
        size = LETTERS**3
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for slot in [*slots, [(" ", 0.0)]]:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (cost, path) in paths.items():
                for out, price in slot:
                    at, total = state, cost + price
                    for char in out:
                        code = int(self.codes[ord(char)])
                        if code == 0 and at % LETTERS == 0:
                            continue
                        total -= self.model[at * LETTERS + code]
                        at = (at * LETTERS + code) % size
                    if at not in after or total < after[at][0]:
                        after[at] = (total, (path, out))
            paths = after
        path, parts = min(paths.values(), key=lambda x: x[0])[1], []
        while path is not None:
            path, out = path
            parts.append(out)
        return "".join(reversed(parts))[:-1]

    def _span(self, span: str, spaced: bool) -> str:
        low = span.lower()
        if (found := self.held.get(low)) is None:
            found = self._viterbi(self._lattice(low, spaced))
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[low] = found
        return span if found == low else found

    def _spaced(self, span: str) -> str:
        sizes = [len(p) == 1 and not p.isdigit() for p in GAPS.split(span)]
        return self._span(span, True) if sum(sizes) >= max(2, len(sizes) / 2) else span

    def restore(self, text: str) -> str:
        text = SPACED.sub(lambda m: self._spaced(m[0]), text)
        parts, done = [], 0
        for hit in HIT.finditer(text):
            start, end = hit.span()
            if start < done:
                continue
            while start > done and (text[start - 1].isalnum() or text[start - 1] in LEET):
                start -= 1
            while end < len(text) and (text[end].isalnum() or text[end] in LEET):
                end += 1
            parts += [text[done:start], self._span(text[start:end], False)]
            done = end
        return "".join([*parts, text[done:]]) if parts else text

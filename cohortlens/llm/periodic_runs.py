"""Periodic runs of words, caught online by dyadic blocks.

A run has a smallest period q and at least max(24, 3 q) words, so the stretch on which word i
equals word i + q has at least 2 q words, and 16 at least. For a power of two b with b < q <= 2 b it
therefore holds a whole block of b words that starts at a multiple of b (for q <= 8, one of 8 words).
Such a completed block is a catcher: it waits for its words to come again at a distance of more
than b and at most 2 b. For each level and each appended word exactly one catcher can be
answered by the b words that end there, so a word costs one comparison of fingerprints a level.
A caught square is extended in both directions by comparing suffixes and prefixes; squares of
one run meet at the same ends and merge. All words that a batch appends advance together, as arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import hold_memory

#: Words of the smallest catcher: a run of 24 words or more holds one, also at periods below 8.
BASE = 8
#: Words handed to the catchers at once; texts longer than that go alone.
WORDS_AT_ONCE = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RunSettings:
    """A run has at least ``least_words`` words and ``least_periods`` periods.

    The catchers are complete from 24 words and 3 periods on; smaller values are refused.
    """

    least_words: int = 24
    least_periods: int = 3

    def __post_init__(self) -> None:
        if self.least_words < 3 * BASE or self.least_periods < 3:
            raise ValueError("catchers need runs of 24 words and 3 periods or more")


def _values(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number per word, equal for equal words, and the fingerprint letter it stands for.

    Texts follow one another, each ended by a number of its own that equals nothing.
    """
    seen: dict[bytes, int] = {}
    flat: list[int] = []
    number = seen.setdefault
    for row in words:
        flat.extend([number(w, len(seen)) for w in row])
        flat.append(-1)
    numbers = np.array(flat, dtype=np.int64)
    ends = np.flatnonzero(numbers < 0)
    numbers[ends] = len(seen) + np.arange(len(ends))
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    return numbers, mixed


class _Suffixes:
    """Fingerprints of any stretch of the appended words, from prefix sums."""

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        self.power = np.empty(n + 1, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(np.full(n, _STEP), out=self.power[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters * self.power[:n], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``a`` and from ``b`` >= ``a`` on agree, by fingerprint."""
        left = (self.sums[a + length] - self.sums[a]) * self.power[b - a]
        return left == self.sums[b + length] - self.sums[b]

    def longest(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on, or before them; at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            ok = self.same(a - middle, b - middle, middle) if back else self.same(a, b, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def _caught(prints: np.ndarray, size: int, nearest: int, farthest: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of squares caught by blocks of ``size`` words, one per chain of blocks.

    Distances run from ``nearest`` to ``nearest + size - 1``, so a window that has just ended
    answers exactly one catcher.
    """
    starts = np.arange(nearest, len(prints))
    blocks = (starts - nearest) // size * size
    hit = prints[starts] == prints[blocks]
    blocks, distance = blocks[hit], (starts - blocks)[hit]
    near = distance <= farthest
    blocks, distance = blocks[near], distance[near]
    order = np.lexsort((blocks, distance))
    blocks, distance = blocks[order], distance[order]
    # A block right after another one at the same distance belongs to the same stretch.
    first = np.ones(len(blocks), bool)
    first[1:] = (distance[1:] != distance[:-1]) | (blocks[1:] != blocks[:-1] + size)
    return blocks[first], distance[first]


def _holds(numbers: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether [start, end) really has the period and no neighbour extends it."""
    if not np.array_equal(numbers[start : end - period], numbers[start + period : end]):
        return False
    before = start > 0 and numbers[start - 1] == numbers[start - 1 + period]
    after = end < len(numbers) and numbers[end] == numbers[end - period]
    return not before and not after


def _stretch(numbers: np.ndarray, block: int, distance: int, low: int, high: int) -> tuple[int, int]:
    """Ends of the stretch of period ``distance`` around the word at ``block``, word by word."""
    unequal = np.flatnonzero(numbers[low : high - distance] != numbers[low + distance : high]) + low
    at = int(np.searchsorted(unequal, block))
    start = int(unequal[at - 1]) + 1 if at else low
    end = int(unequal[at]) if at < len(unequal) else high - distance
    return start, max(end, start) + distance


def runs_of_texts(words: list[list[bytes]], settings: RunSettings = RunSettings()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start, then period.

    Fingerprints only propose: each run is checked word by word, and a text in which one fails is
    done again with plain comparisons. Equal words are equal byte strings.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    # Long texts first, so that the levels for long periods need only look at the front.
    order = sorted((i for i, w in enumerate(words) if len(w) >= settings.least_words), key=lambda i: -len(words[i]))
    if not order:
        return found
    numbers, letters = _values([words[i] for i in order])
    sizes = np.array([len(words[i]) for i in order])
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    suffixes = _Suffixes(letters)
    caught: list[tuple[np.ndarray, np.ndarray]] = []
    size = BASE
    while True:
        least = 1 if size == BASE else size + 1
        # A period of ``least`` or more needs a text of so many words.
        long_enough = int(np.searchsorted(-sizes, -settings.least_periods * least, side="right"))
        if not long_enough:
            break
        reach = int(ends[long_enough - 1])
        if reach >= size:
            at = np.arange(reach - size + 1)
            prints = suffixes.sums[at + size] - suffixes.sums[at]
            prints *= suffixes.power[reach - at]
            caught.append(_caught(prints, size, least, 2 * size))
            if size == BASE:
                caught.append(_caught(prints, size, size + 1, 2 * size))
        size *= 2
    block = np.concatenate([b for b, _ in caught])
    distance = np.concatenate([d for _, d in caught])
    if not len(block):
        return found
    text = np.searchsorted(ends, block)
    inside = block + distance < ends[text]
    block, distance, text = block[inside], distance[inside], text[inside]
    start = block - suffixes.longest(block, block + distance, block - begins[text], True)
    end = block + distance + suffixes.longest(block, block + distance, ends[text] - block - distance, False)
    length = end - start
    enough = length >= np.maximum(settings.least_words, settings.least_periods * distance)
    runs: dict[int, dict[tuple[int, int], int]] = {}
    for t, s, e, d in zip(text[enough].tolist(), start[enough].tolist(), end[enough].tolist(), distance[enough].tolist()):
        ends_of = runs.setdefault(t, {})
        # Multiples of a period reach the same ends; the smallest one is the run's.
        ends_of[s, e] = min(d, ends_of.get((s, e), d))
    for t, ends_of in runs.items():
        low, high = int(begins[t]), int(ends[t])
        if not all(_holds(numbers, s, e, d) for (s, e), d in ends_of.items()):
            mine = text == t
            ends_of = {}
            for b, d in zip(block[mine].tolist(), distance[mine].tolist()):
                s, e = _stretch(numbers, b, d, low, high)
                if e - s >= max(settings.least_words, settings.least_periods * d):
                    ends_of[s, e] = min(d, ends_of.get((s, e), d))
        found[order[t]] = sorted((s - low, e - s, d) for (s, e), d in ends_of.items())
    return found


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text as the run query reads them.

    With h the CRC-32 of the id in decimal and g = h // 10, every tenth text (h % 10 = 0) has the
    words from a = g % n on replaced by its own words a, a + 1, ... again and again with period
    1 + (n - a) // (3 + g % 8). A text without an id stays as it is.
    """
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties to the smaller start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_SCHEMA = (
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, start bigint, length bigint, period bigint, "
    "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = strongest(runs)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()
    return (runs, *first, *digests)


def run_columns(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: RunSettings = RunSettings(), name: str = "periodic"
) -> DataFrame:
    """Add a struct column ``name``: all runs, the strongest one and two checksums.

    Words are what lies between ASCII spaces, of the text rewritten by :func:`repeated_words`.
    ``runs`` lists (start, length, period) by start, then period; ``runs_sha256`` is of their lines,
    ``collapsed_sha256`` of the words outside repetitions, joined by one space.

    Every row is read whole and on its own, so there is no shuffle and nothing to skew; short
    texts go through the catchers together, about half a million words at once, and a longer one
    alone in memory that grows with its words. Null and empty texts have no words and no runs: four
    nulls, an empty list, the checksums of nothing. A null id leaves its text as it is. Ties go to the smaller
    start, then period. Repeated rows get the same result; an empty table gives an empty table.
    Other columns stay whatever their names; one called ``name`` is replaced.
    """

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        hold_memory("periodic")
        for ids, texts in batches:
            rows: list[tuple] = []
            waiting: list[list[bytes]] = []
            held = 0
            for i, t in zip(ids, texts):
                words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
                waiting.append(repeated_words(int(i) if isinstance(i, str) else None, words))
                held += len(words)
                if held >= WORDS_AT_ONCE:
                    rows += [_row(w, r) for w, r in zip(waiting, runs_of_texts(waiting, settings))]
                    waiting, held = [], 0
            rows += [_row(w, r) for w, r in zip(waiting, runs_of_texts(waiting, settings))]
            yield pd.DataFrame(
                {
                    "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r[0]] for r in rows],
                    **{c: pd.array([r[k] for r in rows], dtype="Int64") for k, c in enumerate(("start", "length", "period", "exponent_milli"), 1)},
                    **{c: [r[k] for r in rows] for k, c in enumerate(("runs_sha256", "collapsed_sha256"), 5)},
                }
            )

    found: Column = F.pandas_udf(find, _SCHEMA)(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string"))
    return docs.withColumn(name, found)

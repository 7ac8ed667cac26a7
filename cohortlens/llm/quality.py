"""Quality rules: base counters and compression bands."""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import hold_memory

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of bytes per compressed byte, for a text or a chunk of any length.

    ``knots`` lists (bytes, least ratio, largest ratio) in ascending order; between two knots the
    limits rise with the logarithm of the length, outside they stay. Short texts compress badly
    whatever they say, and long ones find more to refer back to. A whole text must lie inside the band of
    its length. So must its chunks: for each of ``chunk_bytes`` the text is cut into chunks of that
    size, the rest at the end judged by the band of its own length, and the text is rejected if
    chunks with more than ``bad_share`` of its bytes lie outside. The limits leave running text
    of several languages inside; random bytes in base 64 (ratio 1.05 to 1.31) are below them from 256
    bytes on, in hexadecimal (1.92 at 4096 bytes) from 4096 on, repeated sentences above from 256 on.
    """

    knots: tuple[tuple[int, float, float], ...] = (
        (64, 0.0, 2.0),
        (128, 0.9, 2.0),
        (256, 1.15, 2.1),
        (512, 1.3, 2.4),
        (1024, 1.5, 2.7),
        (2048, 1.72, 3.0),
        (4096, 1.95, 3.4),
        (8192, 2.02, 3.7),
        (16384, 2.1, 4.0),
        (65536, 2.2, 4.5),
    )
    chunk_bytes: tuple[int, ...] = (4096, 1024)
    bad_share: float = 0.2
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        """Least and largest ratio of ``size`` bytes."""
        sizes = [math.log2(k[0]) for k in self.knots]
        place = math.log2(max(1, size))
        at = bisect.bisect_right(sizes, place)
        if at in (0, len(sizes)):
            return self.knots[at and -1][1:]
        share = (place - sizes[at - 1]) / (sizes[at] - sizes[at - 1])
        (_, low, high), (_, next_low, next_high) = self.knots[at - 1 : at + 1]
        return low + share * (next_low - low), high + share * (next_high - high)


def base_counters(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    n_symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = -1
        for i, window in enumerate(windows):
            if times[window] > 1:
                n_repeat += i + 2 - max(covered, i - 1)
                covered = i + 2
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat


def _ratio(data: bytes | memoryview, compressor: zstandard.ZstdCompressor) -> float:
    return len(data) / max(1, len(compressor.compress(data)))


def _inside(data: bytes | memoryview, bands: Bands, compressor: zstandard.ZstdCompressor) -> bool:
    low, high = bands.limits(len(data))
    return low <= _ratio(data, compressor) <= high


def compression_verdict(text: str, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, largest share of its bytes in chunks outside their band, and whether it passes."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 0.0, 0.0, False
    ratio = _ratio(data, compressor)
    low, high = bands.limits(len(data))
    view, share = memoryview(data), 0.0
    for size in bands.chunk_bytes:
        chunks = [view[i : i + size] for i in range(0, len(data), size)]
        bad = sum(len(c) for c in chunks if not _inside(c, bands, compressor))
        share = max(share, bad / len(data))
    return ratio, share, low <= ratio <= high and share <= bands.bad_share


_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, bad_share double, base_failed boolean, kept boolean"
)


def quality_columns(docs: DataFrame, text: str = "text", bands: Bands = Bands(), name: str = "quality") -> DataFrame:
    """Add a struct column ``name`` with base counters, compression figures and the verdict.

    Every row is judged on its own whole text, so there is no shuffle and nothing to skew; all
    columns and all rows stay. Null and empty texts have no words and fail the base rule. Ties
    and repeated rows do not matter; an empty table gives an empty table; a column called
    ``name`` is replaced.
    """

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold_memory("quality")
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            rows = []
            for t in texts:
                t = t if isinstance(t, str) else ""
                counts = base_counters(t)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                ratio, share, passed = compression_verdict(t, bands, compressor)
                rows.append((*counts, ratio, share, failed, passed and not failed))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.withColumn(name, F.pandas_udf(judge, _SCHEMA)(F.col(f"`{text}`").cast("string")))

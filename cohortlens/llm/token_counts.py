"""Token counts from pre-token frequencies, without ids."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import cache
from operator import mul

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortlens.llm.common import hold_memory, tokenizer_bytes

#: Pre-tokens whose count a worker remembers; later ones are counted once per slice of texts.
_REMEMBERED = 500_000
_SLICE = 1000
#: Longer units are counted each time, so what a worker remembers does not grow with texts.
_LONGEST = 256
#: A run of white space keeps its last character back if text follows; a space joins that text.
_UNITS = regex.compile(r" ?\S+|\s+(?!\S)|\s+")


class PieceCounter:
    """Number of tokens of texts by the pre-tokens they consist of.

    A pre-token here is a word with one space before it (or white space between words): for the
    byte-level tokenizer its ends are always ends of pre-tokens, and for a sentencepiece model
    pieces never go across a space that follows text. So counts of parts add up.
    """

    def __init__(self, name: str, definition: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.is_model = name.endswith(".model")
        self._special: list[str] = []
        if self.is_model:
            self._library = SentencePieceProcessor(model_proto=definition)
        else:
            self._library = Tokenizer.from_str(definition.decode("utf-8"))
            self._special = sorted((t.content for t in self._library.get_added_tokens_decoder().values()), key=len, reverse=True)
            self._cuts = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")")
        self._remembered: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """Parts of a text whose token counts add up to that of the text."""
        if not text:
            return []
        if any(s in text for s in self._special):
            # The library cuts a text at its special strings before anything else.
            return [u for part in self._cuts.split(text) for u in ([part] if part in self._special else self.pre_tokens(part))]
        spaced = "  " in text
        if self.is_model:
            return [text] if spaced or text[0] == " " or text[-1] == " " or "▁" in text else text.split(" ")
        if spaced:
            return _UNITS.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def _count(self, units: list[str]) -> list[int]:
        if self.is_model:
            return [len(x) for x in self._library.encode(units, num_threads=1)]
        return [len(x) for x in self._library.encode_batch_fast(units, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        """Count each distinct pre-token once, then join the counts to each text's frequencies."""
        frequencies = [Counter(self.pre_tokens(t)) for t in texts]
        known = self._remembered
        distinct = set().union(*frequencies)
        unknown = [w for w in distinct if w not in known]
        new = dict(zip(unknown, self._count(unknown))) if unknown else {}
        pieces = {w: known[w] for w in distinct if w in known} | new
        for w in unknown[: max(0, _REMEMBERED - len(known))]:
            if len(w) <= _LONGEST:
                known[w] = new[w]
        return [sum(map(mul, f.values(), map(pieces.__getitem__, f))) for f in frequencies]


@cache
def piece_counter(name: str, definition: bytes) -> PieceCounter:
    return PieceCounter(name, definition)


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", name: str = "tokens") -> DataFrame:
    """Add a struct column ``name`` with ``n_bytes`` and ``n_tokens`` of each whole text.

    Distinct pre-tokens meet their frequencies inside a task, so no row leaves its partition:
    about a quarter of all (document, pre-token) pairs are rare words, which a join over the
    cluster would move at a size near that of the text itself. Null and empty texts count 0;
    special strings inside texts are treated as the library does by default; all rows and columns
    stay; repeated rows get equal counts; an empty table stays empty; a column called ``name`` is
    replaced.
    """
    definition = tokenizer_bytes(tokenizer)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold_memory("token_counts", piece_counter.cache_clear)
        counter = piece_counter(tokenizer, definition)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            tokens = [n for i in range(0, len(texts), _SLICE) for n in counter(texts[i : i + _SLICE])]
            yield pd.DataFrame({"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens}, dtype="int64")

    return docs.withColumn(name, F.pandas_udf(count, "n_bytes long, n_tokens long")(F.col(f"`{text}`").cast("string")))

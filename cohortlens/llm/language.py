"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import id_remainder

#: Most languages that can be learnt; prototypes of all of them are sent to every task.
MOST_LANGUAGES = 8192
#: Distinct letters share this many random vectors by code point; scripts in use have fewer.
_LETTERS = 4096
_BLANK = _LETTERS - 1
_SLICE = 1 << 21


@dataclass(frozen=True)
class ProfileSettings:
    """Length of the hypervectors, letters in an n-gram (2 to 5), and the seed of the letters."""

    dimensions: int = 1024
    gram: int = 3
    seed: int = 20


@cache
def letter_vectors(settings: ProfileSettings) -> np.ndarray:
    """Random signs for each letter; ``[p, letter]`` is the vector rotated by ``p`` places."""
    signs = np.random.default_rng(settings.seed).integers(0, 2, (_LETTERS, settings.dimensions), np.int8) * 2 - 1
    return np.stack([np.roll(signs, p, axis=1) for p in range(settings.gram)])


def letters(text: str) -> np.ndarray:
    """Numbers of the lower-case letters of a text, one blank for each gap and at both ends."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    words = kept.split()
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points == 32, _BLANK, points % _BLANK)


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def gram_counts(text: str, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the different n-grams of a whole text and how often each occurs."""
    numbers = letters(text)
    if len(numbers) and len(numbers) < gram:
        numbers = np.concatenate([numbers, np.full(gram - len(numbers), _BLANK)])
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(numbers) - gram + 1, _SLICE):
        part = numbers[start : start + _SLICE + gram - 1]
        code = np.zeros(len(part) - gram + 1, np.int64)
        for p in range(gram):
            code = code * _LETTERS + part[p : p + len(code)]
        own, times = np.unique(code, return_counts=True)
        if len(codes):
            codes, index = np.unique(np.concatenate([codes, own]), return_inverse=True)
            counts = np.bincount(index, weights=np.concatenate([counts, times]), minlength=len(codes)).astype(np.int64)
        else:
            codes, counts = own, times
    return codes, counts


def gram_vectors(codes: np.ndarray, settings: ProfileSettings) -> np.ndarray:
    """Hypervector of each n-gram: its letters' vectors, rotated by their places, multiplied."""
    rotated = letter_vectors(settings)
    bound = np.ones((len(codes), settings.dimensions), np.int8)
    rest = codes
    for p in range(settings.gram):
        bound *= rotated[p, rest % _LETTERS]
        rest = rest // _LETTERS
    return bound


class _Bundler:
    """Bundles documents; the vectors of n-grams met before are kept up to a bound."""

    def __init__(self, settings: ProfileSettings, most: int = 30_000) -> None:
        self.settings, self.most = settings, most
        self.codes = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, settings.dimensions), np.int8)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """One sum of n-gram vectors per text."""
        grams = [gram_counts(t, self.settings.gram) for t in texts]
        new = np.setdiff1d(np.concatenate([g[0] for g in grams] or [self.codes]), self.codes)
        if len(new):
            keep = len(self.codes) + len(new) <= self.most
            codes = np.concatenate([self.codes if keep else self.codes[:0], new])
            vectors = np.concatenate([self.vectors if keep else self.vectors[:0], gram_vectors(new, self.settings)])
            if not keep:
                everything = np.unique(np.concatenate([g[0] for g in grams]))
                codes, vectors = everything, gram_vectors(everything, self.settings)
            order = np.argsort(codes)
            self.codes, self.vectors = codes[order], vectors[order]
        out = np.zeros((len(texts), self.settings.dimensions), np.float32)
        for i, (codes, counts) in enumerate(grams):
            for s in range(0, len(codes), 8192):
                at = np.searchsorted(self.codes, codes[s : s + 8192])
                out[i] += counts[s : s + 8192].astype(np.float32) @ self.vectors[at].astype(np.float32)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def learn_prototypes(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", settings: ProfileSettings = ProfileSettings()) -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of its documents' bundles, each of length one.

    ``usable`` is a condition on the columns of ``docs``. Rows without a language or without a
    letter teach nothing; repeated rows teach as often as they occur. Every task adds up its own
    rows and sends one vector per language, rounded to whole millionths so that the sum does not
    depend on the order; the sums are added by language and dimension. What reaches the driver is
    one vector per language, at most ``MOST_LANGUAGES``.
    """
    rows = docs.where(usable).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = _Bundler(settings)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = _texts(batch["text"]), batch["lang"].tolist()
            for s in range(0, len(texts), 256):
                whole = np.rint(_unit(bundle(texts[s : s + 256]).astype(np.float64)) * 1e6).astype(np.int64)
                for name, vector in zip(langs[s : s + 256], whole):
                    if vector.any():
                        sums[name] = sums.get(name, 0) + vector
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = rows.where("lang IS NOT NULL").mapInPandas(add_up, "lang string, vector array<long>")
    added = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("vector"))
    learnt = vectors.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(learnt) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: np.array([v["value"] for v in r["vector"]], np.float64) for r in learnt}


def predict_columns(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", settings: ProfileSettings = ProfileSettings(), name: str = "language") -> DataFrame:
    """Add a struct column ``name`` with ``lang_pred`` and ``score`` for each whole text.

    Documents and prototypes are compared by cosine after the mean of the prototypes is taken off
    both, which leaves what tells languages apart; the score maps the best cosine to 0 to 1. The
    language that sorts first wins a tie. A null text or one without a letter is ``und`` with
    score 0, and so is every text if nothing was learnt. All rows and columns stay, an empty table
    stays empty, and a column called ``name`` is replaced.
    """
    names = sorted(prototypes)
    units = _unit(np.array([prototypes[n] for n in names]).reshape(len(names), -1)) if names else np.zeros((0, settings.dimensions))
    centre = units.mean(axis=0) if len(names) > 1 else np.zeros(settings.dimensions)
    directions = _unit(units - centre).astype(np.float32)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bundle = _Bundler(settings)
        for batch in batches:
            texts = _texts(batch)
            best, score = [], []
            for s in range(0, len(texts), 256):
                sums = bundle(texts[s : s + 256])
                spoken = sums.any(axis=1)
                cosines = _unit(_unit(sums) - centre.astype(np.float32)) @ directions.T
                for has_letters, row in zip(spoken, cosines):
                    known = bool(has_letters) and len(names) > 0
                    k = int(row.argmax()) if known else -1
                    best.append(names[k] if known else "und")
                    score.append(float(np.clip((1 + row[k]) / 2, 0, 1)) if known else 0.0)
            yield pd.DataFrame({"lang_pred": best, "score": np.array(score, float)})

    return docs.withColumn(name, F.pandas_udf(predict, "lang_pred string, score double")(F.col(f"`{text}`").cast("string")))


def held_out(id_column: Column) -> Column:
    """Ids that nothing is learnt from; a null id is not among them and not learnt from either."""
    return F.coalesce(id_remainder(id_column, 5) == 0, F.lit(False))

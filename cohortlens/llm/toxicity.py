"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from cohortlens.llm.common import hold_memory, id_remainder, stored

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class TrainingSettings:
    """``positives`` and ``unlabelled`` bound the number of documents that the fit looks at.

    A word is a feature if it is more frequent in positives than in unlabelled text by ``least_z``
    standard deviations and if, by the class prior, at least ``least_posterior`` of the texts that
    hold it are positive. ``prior`` is used where no labelled negative tells the class prior.
    """

    positives: int = 8_000
    unlabelled: int = 16_000
    least_documents: int = 3
    least_z: float = 4.0
    least_posterior: float = 0.7
    prior: float = 0.1
    steps: int = 500
    rate: float = 0.1
    decay: float = 3e-6
    step_back: float = 1.0


@dataclass(frozen=True)
class ToxicityModel:
    """Weights per hashed word and a bias; a text's score uses each of its words once."""

    bias: float
    weights: dict[int, float] = field(repr=False)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        g = self.bias + math.fsum(get(w, 0.0) for w in word_hashes(text))
        return 1 / (1 + math.exp(-g)) if g > -700 else 0.0


def word_hashes(text: str | None) -> set[int]:
    """Hashes of the different lower-case words of a text."""
    return {xxh32_intdigest(w) for w in set(_WORD.findall((text or "").lower()))}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: TrainingSettings = TrainingSettings()) -> ToxicityModel:
    """Linear classifier on the given word hashes that minimises the non-negative PU risk.

    Risk: prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)]) with the logistic
    loss. When the corrected negative part is below zero, the step goes uphill on it (scaled by
    ``step_back``), as in the non-negative estimator. Without positives, or without unlabelled
    text, nothing can be learnt: the score is the prior (0.5 without one) everywhere.
    """
    if not positive or not unlabelled:
        p = min(max(prior if not positive else 0.5, 1e-3), 0.5)
        return ToxicityModel(math.log(p / (1 - p)), {})
    docs = positive + unlabelled
    lengths = np.array([len(d) for d in docs])
    flat = np.concatenate([np.asarray(d, np.int64) for d in docs]) if lengths.sum() else np.zeros(0, np.int64)
    words, col = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(docs)), lengths)
    n_words, n_docs, n_pos = len(words), len(docs), len(positive)
    share = np.zeros(n_docs)
    share[:n_pos] = 1 / n_pos
    of_unlabelled = np.zeros(n_docs)
    of_unlabelled[n_pos:] = 1 / len(unlabelled)
    theta = np.append(np.zeros(n_words), math.log(prior / (1 - prior)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        g = np.bincount(row, weights=theta[col], minlength=n_docs) + theta[-1]
        up, down = _sigmoid(g), _sigmoid(-g)
        negative_risk = float(np.dot(of_unlabelled - prior * share, np.logaddexp(0, g)))
        toward_positive = -prior * share * down
        toward_negative = (of_unlabelled - prior * share) * up
        if negative_risk >= 0:
            slope = toward_positive + toward_negative
        else:
            slope = -settings.step_back * toward_negative
        gradient = np.append(np.bincount(col, weights=slope[row], minlength=n_words), slope.sum())
        gradient[:-1] += settings.decay * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta - settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel(float(theta[-1]), dict(zip(words.tolist(), theta[:-1].tolist())))


def _hashes(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        hold_memory("toxicity")
        return pd.Series([sorted(word_hashes(t if isinstance(t, str) else None)) for t in texts], dtype=object)

    return hashes(text)


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` ids of smallest hash: the same rows whatever the partitioning."""
    return ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text: str = "text", label: str = "toxic", settings: TrainingSettings = TrainingSettings()) -> ToxicityModel:
    """Fit on documents whose id satisfies ``usable`` (a condition on a column ``id``).

    Positives are documents labelled 1; the unlabelled text is drawn from all usable documents,
    whatever their label, so it has the mixture that the class prior describes. The prior is the
    share of 1 among the labelled usable documents. Both samples are bounded by ``settings`` and
    chosen by hash. Null ids and null labels are not used; repeated rows count once, and of different
    texts with one id one counts. No documents or no labels give a model with the prior alone.
    """
    ids = docs.select(F.col(f"`{id_column}`").alias("id")).where("id IS NOT NULL").where(usable)
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(usable)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n, n_pos = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("y") == 1, 1))).first()
    prior = n_pos / n if 0 < n_pos < n else settings.prior
    positive = _sample(known.where("y = 1").join(ids, "id", "left_semi").select("id"), settings.positives)
    chosen = positive.withColumn("kind", F.lit(1)).unionByName(_sample(ids, settings.unlabelled).withColumn("kind", F.lit(0)))
    chosen = stored(chosen.groupBy("id").agg(F.collect_set("kind").alias("kinds")), "sample")
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "kinds", _hashes(F.col("text")).alias("words"))
    # Of several texts with one id the one whose words come first counts, whatever the partitioning.
    rows = stored(rows.groupBy("id", "kinds").agg(F.min("words").alias("words")), "words")
    sizes = rows.agg(*[F.count_if(F.array_contains("kinds", kind)) for kind in (1, 0)]).first()
    prior = min(max(prior, 1e-3), 0.999)
    words = rows.select("id", "kinds", F.explode("words").alias("word"))
    features = _features(words, *sizes, prior, settings) if all(sizes) else words.select("word").limit(0)
    held = words.join(F.broadcast(stored(features, "features")), "word").groupBy("id", "kinds").agg(F.sort_array(F.collect_list("word")).alias("words"))
    found = held.orderBy("id").collect()
    of_kind = []
    for kind, size in zip((1, 0), sizes):
        own = [np.array(r["words"], np.int64) for r in found if kind in r["kinds"]]
        of_kind.append(own + [np.zeros(0, np.int64)] * (size - len(own)))
    return fit_nnpu(*of_kind, prior, settings)


def _features(words: DataFrame, n_pos: int, n_unl: int, prior: float, settings: TrainingSettings) -> DataFrame:
    """Words of the sampled documents that are features, from their counts in both samples.

    Each needs ``least_documents`` positives to hold it, so there are at most a third as many as
    the positives have words.
    """
    counts = words.groupBy("word").agg(*[F.count_if(F.array_contains("kinds", kind)).alias(name) for kind, name in ((1, "k"), (0, "m"))])
    p, q = F.col("k") / n_pos, F.col("m") / n_unl
    both = (F.col("k") + F.col("m")) / (n_pos + n_unl)
    z = (p - q) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / n_pos + 1 / n_unl))
    posterior = prior * p / F.greatest(q, F.lit(0.5 / n_unl))
    return counts.where((F.col("k") >= settings.least_documents) & (z >= settings.least_z) & (posterior >= settings.least_posterior)).select("word")


def score_column(text: Column, model: ToxicityModel) -> Column:
    """Score of each whole text; a null or empty text has no words and gets the bias alone."""
    shared = model

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        hold_memory("toxicity")
        return pd.Series([shared.score(t if isinstance(t, str) else None) for t in texts], dtype=float)

    return scores(text)


def held_out(id_column: Column) -> Column:
    """Ids kept out of learning; a null id is not among them, but has no label to learn either."""
    return F.coalesce(id_remainder(id_column, 3) == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", settings: TrainingSettings = TrainingSettings(), name: str = "toxicity") -> DataFrame:
    """Add column ``name``: a score in 0 to 1 for every row, learnt from ids that are not held out.

    Scoring reads one text at a time: no shuffle, all rows and columns stay, repeated rows get
    equal scores, an empty table stays empty. A column called ``name`` is replaced.
    """
    model = fit(docs, labels, id_remainder(F.col("id"), 3) != 1, id_column, text, settings=settings)
    return docs.withColumn(name, score_column(F.col(f"`{text}`"), model))

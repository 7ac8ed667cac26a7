"""Registered queries and inner steps that have no SQL, against plain loops written for the tests."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from xxhash import xxh32_intdigest

from cohortlens.llm import language, toxicity
from cohortlens.llm.packing import differencing
from cohortlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


# --- op2 -------------------------------------------------------------------------------------------


def plain_bundle(text, signs):
    """Sum over all places of the product of three letters' vectors, rotated by 2, 1 and 0."""
    numbers = language.letters(text or "")
    total = np.zeros(signs.shape[1])
    for a, b, c in zip(numbers, numbers[1:], numbers[2:]):
        total += np.roll(signs[a], 2) * np.roll(signs[b], 1) * signs[c]
    return total


def test_languages_equal_plain_cosines(spark):
    settings = language.ProfileSettings()
    signs = language.letter_vectors(settings)[0].astype(float)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    bundles = {d["doc_id"]: plain_bundle(d["text"], signs) for d in docs}
    learnt = {}
    for d in docs:
        bundle = bundles[d["doc_id"]]
        if remainder(d["doc_id"], 5) and d["lang"] is not None and bundle.any():
            learnt[d["lang"]] = learnt.get(d["lang"], 0) + bundle / np.linalg.norm(bundle)
    names = sorted(learnt)
    units = [learnt[n] / np.linalg.norm(learnt[n]) for n in names]
    centre = sum(units) / len(units)
    away = [u - centre for u in units]
    found = {r["doc_id"]: r for r in QUERIES["op2_language_profiles"](spark, FOLDER).collect()}
    assert len(found) == len(docs)
    for d in docs:
        row, bundle = found[d["doc_id"]], bundles[d["doc_id"]]
        assert row["held_out"] == (remainder(d["doc_id"], 5) == 0)
        if not bundle.any():
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        off = bundle / np.linalg.norm(bundle) - centre
        cosines = [off @ a / np.linalg.norm(off) / np.linalg.norm(a) for a in away]
        assert row["score"] == pytest.approx((1 + max(cosines)) / 2, abs=1e-4)
        assert max(cosines) - cosines[names.index(row["lang_pred"])] < 1e-4


# --- op9 -------------------------------------------------------------------------------------------


def plain_risk(theta, words, positive, unlabelled, prior):
    """(risk with its correction, corrected negative part) of a linear score over words."""
    def mean(docs, loss):
        return sum(loss(theta[-1] + sum(theta[words.index(w)] for w in d)) for d in docs) / len(docs)

    soft = lambda g: math.log1p(math.exp(g))
    negative = mean(unlabelled, soft) - prior * mean(positive, soft)
    return prior * mean(positive, lambda g: soft(-g)) + negative, negative


def plain_fit(positive, unlabelled, prior, s):
    """Adam on slopes taken from differences of the risk."""
    words = sorted({int(w) for d in positive + unlabelled for w in d})
    theta = [0.0] * len(words) + [math.log(prior / (1 - prior))]
    first, second, uphill = [0.0] * len(theta), [0.0] * len(theta), 0
    for step in range(1, s.steps + 1):
        part = 0 if plain_risk(theta, words, positive, unlabelled, prior)[1] >= 0 else 1
        uphill += part
        slopes = []
        for k in range(len(theta)):
            sides = []
            for move in (1e-5, -1e-5):
                other = list(theta)
                other[k] += move
                sides.append(plain_risk(other, words, positive, unlabelled, prior)[part])
            slope = (sides[0] - sides[1]) / 2e-5 * (-s.step_back if part else 1)
            slopes.append(slope + (s.decay * theta[k] if k < len(words) else 0))
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope * slope
            theta[k] -= s.rate * first[k] / (1 - 0.9**step) / (math.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return dict(zip(words, theta)), theta[-1], uphill


def test_the_fit_follows_the_risk_by_differences():
    rng = np.random.default_rng(3)
    positive = [np.array(sorted({1, *rng.integers(2, 6, 2).tolist()})) for _ in range(8)]
    unlabelled = [np.array(sorted(set(rng.integers(2, 6, 2).tolist()) | ({1} if i % 5 == 0 else set()))) for i in range(15)]
    settings = toxicity.TrainingSettings(steps=60, rate=0.3, decay=0.01)
    weights, bias, uphill = plain_fit(positive, unlabelled, 0.6, settings)
    model = toxicity.fit_nnpu(positive, unlabelled, 0.6, settings)
    assert 0 < uphill < 60  # both branches of the estimator were taken
    assert model.bias == pytest.approx(bias, abs=1e-3)
    assert {w: pytest.approx(v, abs=1e-3) for w, v in weights.items()} == model.weights


def test_toxicity_equals_a_plain_selection_of_words(spark):
    s = toxicity.TrainingSettings()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r["toxic"] is not None}
    words = {i: {xxh32_intdigest(w) for w in re.findall(r"[^\W\d_]+", t.lower())} for i, t in docs.items()}
    usable = sorted(i for i in docs if remainder(i, 3) != 1)
    known = [i for i in labels if remainder(i, 3) != 1]
    positive = [i for i in usable if labels.get(i) == 1]
    assert len(usable) <= s.unlabelled and positive
    prior = sum(labels[i] == 1 for i in known) / len(known)
    chosen = set()
    for w in set().union(*(words[i] for i in positive)):
        k, m = sum(w in words[i] for i in positive), sum(w in words[i] for i in usable)
        p, q, both = k / len(positive), m / len(usable), (k + m) / (len(positive) + len(usable))
        z = (p - q) / math.sqrt(max(both * (1 - both), 1e-12) * (1 / len(positive) + 1 / len(usable)))
        if k >= s.least_documents and z >= s.least_z and prior * p / max(q, 0.5 / len(usable)) >= s.least_posterior:
            chosen.add(w)
    as_arrays = lambda ids: [np.array(sorted(words[i] & chosen), np.int64) for i in ids]
    model = toxicity.fit_nnpu(as_arrays(positive), as_arrays(usable), prior, s)
    rows = QUERIES["op9_toxicity"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        score = 1 / (1 + math.exp(-model.bias - sum(model.weights.get(w, 0.0) for w in words[r["doc_id"]])))
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1)
        assert abs(score - 0.7) < 1e-6 or r["predicted"] == int(score >= 0.7)


# --- op6 -------------------------------------------------------------------------------------------


def plain_differencing(lengths, windows):
    """Lists of (sum, pieces); the two partitions of largest spread are merged until one is left."""
    parts = [(n, i, [(n, [i])] + [(0, [])] * (windows - 1)) for i, n in enumerate(lengths)]
    made = len(lengths)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        a, b, rest = parts[0][2], parts[1][2], parts[2:]
        both = [(x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b))]
        both.sort(key=lambda p: -p[0])
        least = both[-1][0]
        parts = rest + [(both[0][0] - least, made, [(x - least, i) for x, i in both])]
        made += 1
    return sorted(sorted(i) for _, i in parts[0][2])


@pytest.mark.parametrize("seed", range(30))
def test_differencing_equals_plain_lists(seed):
    rng = np.random.default_rng(seed)
    windows = int(rng.integers(2, 7))
    lengths = rng.integers(1, 6 if seed % 3 == 0 else 1000, int(rng.integers(1, 40)))
    got = differencing(lengths, windows)
    assert sorted(sorted(np.flatnonzero(got == w).tolist()) for w in range(windows)) == plain_differencing(lengths.tolist(), windows)

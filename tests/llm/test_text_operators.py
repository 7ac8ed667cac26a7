"""Operators on single texts against libraries, brute force and held-out rows."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortlens.llm import language, toxicity
from cohortlens.llm.common import id_remainder, ship_package, tokenizer_bytes
from cohortlens.llm.packing import differencing, near_equal_windows, pack_documents, word_encoder
from cohortlens.llm.pieces import decode_column, encode_column, piece_table
from cohortlens.llm.quality import Bands, base_counters, compression_verdict, quality_columns
from cohortlens.llm.queries import QUERIES
from cohortlens.llm.token_counts import token_counts
from tests.llm.data import SF, odd_documents, odd_texts


def test_remainder_is_that_of_crc32(spark):
    rows = spark.range(50).select("id", id_remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


# --- sentencepiece -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_those_of_the_library(pieces):
    table, rng = piece_table(tokenizer_bytes("piece_bpe_32k.model")), random.Random(3)
    texts = odd_texts() + ["".join(rng.choice("ab -=*/_.é\n▁日<>01") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice(["the", "ing", " ", "  ", "====", "aaa", "\t\t", "//"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text, ids in zip(texts, table.encode(texts)):
        expected = [1, *pieces.encode(text), 2]
        assert ids.tolist() == expected
        assert table.decode(ids) == pieces.decode(expected)


def test_decoding_of_any_ids_equals_the_library(pieces):
    table, rng = piece_table(tokenizer_bytes("piece_bpe_32k.model")), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(262), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert table.decode(np.array(ids, np.int64)) == pieces.decode(ids)


def test_piece_columns_take_nulls_and_repeats(spark, pieces):
    ship_package(spark)
    docs = odd_documents(spark)
    rows = docs.select("text", encode_column(F.col("text")).alias("ids")).withColumn("back", decode_column(F.col("ids"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = [1, *pieces.encode(r["text"] or ""), 2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected and r["back"] == pieces.decode(expected)


def test_registered_round_trip(spark, pieces):
    rows = QUERIES["op4_sentencepiece_round_trip"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 200
    for r in rows:
        ids = [1, *pieces.encode(r["text"] or ""), 2]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()


# --- token counts --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, pieces, name):
    ship_package(spark)
    docs = odd_documents(spark)
    counted = token_counts(docs, tokenizer=name).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(counted) == docs.count()
    for r in counted:
        text = r["text"] or ""
        expected = pieces.encode(text) if name.endswith(".model") else library.encode(text, add_special_tokens=False).ids
        assert (r["tokens"]["n_bytes"], r["tokens"]["n_tokens"]) == (len(text.encode()), len(expected)), text


def test_registered_counts(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op7_token_counts"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    for r in rows:
        n = len(library.encode(r["text"], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(r["text"].encode()), n, n > 512)


# --- packing -------------------------------------------------------------------------------------


def test_word_ids_equal_those_of_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = odd_texts()
    for text, ids in zip(texts, word_encoder(tokenizer_bytes("word_bpe_49k.json"))(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_differencing_of_a_known_example():
    # The classic example 8, 7, 6, 5, 4 ends in a difference of 2.
    lengths = np.array([8, 7, 6, 5, 4])
    sums = np.bincount(differencing(lengths, 2), weights=lengths)
    assert sorted(sums) == [14, 16]


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_near_equal_and_within_capacity(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 300).astype(int), 1, 4095)
    owner, start, part, window = near_equal_windows(lengths, 4096)
    sums = np.bincount(window, weights=part)
    assert sums.max() <= 4096 and sums.max() - sums.min() < 200
    assert (np.bincount(owner, weights=part) == lengths).all()


def check_packing(rows, texts, end_id=2, capacity=4096):
    """Every id in exactly one piece, windows without gaps and within capacity."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    sums = [sum(r["length"] for r in own) for own in windows.values()]
    return sum(capacity - s for s in sums if s & (s - 1)) / sum(sums)


def test_registered_packing(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(QUERIES["op6_packed_windows"](spark, SF).collect(), texts) < 0.02


def test_packing_of_odd_documents(spark):
    ship_package(spark)
    docs = odd_documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = pack_documents(docs, capacity=64, windows=4, spare=2).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(packed.collect(), texts, capacity=64)
    again = pack_documents(odd_documents(spark))
    assert again.where("doc_id IS NULL AND start = 0").count() == odd_documents(spark).where("doc_id IS NULL").count()


# --- quality -------------------------------------------------------------------------------------


def plain_counters(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_base_counters_equal_plain_ones():
    rng = random.Random(5)
    texts = odd_texts() + ["".join(rng.choice(["a", "b", " ", "\n", "#", "\x0b", "é", "\xa0", "|"]) for _ in range(120)) for _ in range(400)]
    for text in texts:
        assert base_counters(text) == plain_counters(text), text


def plain_verdict(text):
    """Whole text and chunks of 4096 and 1024 bytes against limits read off the knots by interpolation."""
    data, knots = text.encode(), np.array(Bands().knots)

    def outside(part):
        ratio = len(part) / len(zstandard.compress(part, 3))
        low, high = (np.interp(np.log2(len(part)), np.log2(knots[:, 0]), knots[:, k]) for k in (1, 2))
        return not low <= ratio <= high

    if not data or outside(data):
        return False
    for size in (4096, 1024):
        parts = [data[i : i + size] for i in range(0, len(data), size)]
        if sum(len(p) for p in parts if outside(p)) > 0.2 * len(data):
            return False
    return True


def mixed_texts(texts, rng):
    """Texts with half as much again of something that is no prose, at the end or in the middle."""
    for t in texts:
        n = len(t) // 2
        noise = base64.b64encode(rng.randbytes(n)).decode()[:n]
        yield t + noise
        yield t[:n] + noise + t[n:]
        yield t + rng.randbytes(n).hex()[:n]
        yield t + (t[:80] * (n // 80 + 1))[:n]


def test_bands_reject_repeats_and_noise_and_keep_prose(spark):
    compressor, rng = zstandard.ZstdCompressor(level=3), random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    prose = [r for r in docs if plain_counters(r["text"] or "")[0] >= 50]
    for language in ("en", "de", "fr", "es"):
        kept = [compression_verdict(r["text"], Bands(), compressor)[2] for r in prose if r["lang"] == language and plain_counters(r["text"])[4] == 0]
        assert len(kept) > 50 and np.mean(kept) >= 0.99
    long = [r["text"] for r in prose if len(r["text"]) > 6000 and plain_counters(r["text"])[4] == 0][:40]
    mixed = list(mixed_texts(long, rng))
    assert [compression_verdict(t, Bands(), compressor)[2] for t in mixed] == [plain_verdict(t) for t in mixed]
    rejected = np.array([not plain_verdict(t) for t in mixed]).reshape(-1, 4).mean(axis=0)
    assert rejected[0] == rejected[1] == 1 and (rejected >= 0.9).all()
    for n in (256, 512, 1024, 4096, 20_000):
        assert not compression_verdict(base64.b64encode(rng.randbytes(n)).decode()[:n], Bands(), compressor)[2]
        assert not compression_verdict(("buy cheap things here now. " * n)[:n], Bands(), compressor)[2]
        assert compression_verdict(rng.randbytes(n).hex()[:n], Bands(), compressor)[2] == (n < 4096)
    assert compression_verdict("", Bands(), compressor) == (0.0, 0.0, False)


def test_limits_between_knots():
    bands = Bands()
    assert [bands.limits(k[0]) for k in bands.knots] == [k[1:] for k in bands.knots]
    assert bands.limits(1) == bands.limits(64) and bands.limits(10**9) == bands.limits(65536)
    lows = [bands.limits(n)[0] for n in range(64, 70_000, 97)]
    assert lows == sorted(lows)


def test_quality_query_and_odd_rows(spark):
    rows = QUERIES["op10_compression_bands"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    for r in rows:
        counts = plain_counters(r["text"] or "")
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        passed = plain_verdict(r["text"] or "")
        assert r["base_failed"] == failed and r["kept"] == (passed and not failed)
    docs = odd_documents(spark)
    judged = quality_columns(docs)
    assert judged.count() == docs.count() and judged.where("text IS NULL AND quality.kept").count() == 0
    assert quality_columns(docs.limit(0)).count() == 0


# --- language ------------------------------------------------------------------------------------


def test_gram_vectors_bind_rotated_letters():
    settings = language.ProfileSettings(dimensions=64)
    base = language.letter_vectors(settings)[0]
    numbers = language.letters("abc")
    codes, counts = language.gram_counts("abc", 3)
    assert counts.tolist() == [1, 1, 1] and len(numbers) == 5
    a, b, c = (base[n] for n in numbers[1:4])
    code = (numbers[1] * 4096 + numbers[2]) * 4096 + numbers[3]
    bound = language.gram_vectors(np.array([code]), settings)[0]
    assert (bound == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_bundles_are_sums_of_gram_vectors():
    settings = language.ProfileSettings(dimensions=128)
    texts = ["The cat sat on the mat", "", "12 34", "ñandú " * 50, "x"]
    bundler = language._Bundler(settings, most=20)
    for _ in range(2):
        for text, vector in zip(texts, bundler(texts)):
            codes, counts = language.gram_counts(text, 3)
            assert (vector == (counts[:, None] * language.gram_vectors(codes, settings)).sum(0)).all()


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "the quick brown fox " * 40
    whole = language.gram_counts(text, 3)
    monkeypatch.setattr(language, "_SLICE", 37)
    assert all((a == b).all() for a, b in zip(whole, language.gram_counts(text, 3)))


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op2_language_profiles"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND length(text) > 30").collect()
    assert len(rows) > 150
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    learnt = language.learn_prototypes(docs, F.col("doc_id").isNotNull())
    rows = language.predict_columns(docs, learnt).collect()
    assert len(rows) == docs.count()
    for r in rows:
        spoken = any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang_pred"] == "und") == (not spoken)
    nothing = language.predict_columns(docs, language.learn_prototypes(docs.limit(0), F.lit(True)))
    assert {r["language"]["lang_pred"] for r in nothing.collect()} == {"und"}


# --- toxicity ------------------------------------------------------------------------------------


def test_risk_is_corrected_by_the_class_prior():
    rng = np.random.default_rng(7)
    marked = [np.array([1, *rng.choice(np.arange(10, 60), 8, replace=False)]) for _ in range(200)]
    mixed = [np.append(rng.choice(np.arange(10, 60), 8, replace=False), [1] if i % 10 == 0 else []).astype(int) for i in range(1000)]
    model = toxicity.fit_nnpu(marked, mixed, 0.1)
    score = lambda words: 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(w, 0) for w in words))))
    assert score([1, 11, 12]) > 0.7 and score([11, 12, 13]) < 0.3


def test_nothing_to_learn_from():
    assert toxicity.fit_nnpu([], [np.array([1])], 0.1).score("a") == pytest.approx(0.1)
    assert toxicity.fit_nnpu([np.array([1])], [], 0.1).score(None) == pytest.approx(0.5)


def test_held_out_toxic_documents_are_found(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op9_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in scored if r["toxic"] == 1]
    clean = [r for r in scored if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.8
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)


def test_toxicity_of_odd_rows(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    labels = spark.createDataFrame([(2, 1, 1), (2, 1, 1), (3, None, None), (None, 1, 1)], schema)
    scored = toxicity.score_documents(docs, labels)
    assert scored.count() == docs.count() and scored.where("toxicity IS NULL OR toxicity < 0 OR toxicity > 1").count() == 0
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == docs.count()

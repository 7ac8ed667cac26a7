"""SimHash near-duplicates found through Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortlens.llm.common import free_names, hold_memory, small_or_not, stored
from cohortlens.llm.links import components

#: The 64 bits are cut into three segments; each is padded with zeros to the 23 bits of the code.
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the perfect binary Golay code.
_GENERATOR = 0b101011100011
#: A bucket with more fingerprints is joined in blocks of this size.
_BLOCK = 512
#: Ids are broadcast up to this many bytes as written; in memory they take some thirty times that.
_SMALL_IDS = 4 << 20
_SLICE = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of one text as an unsigned 64-bit integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    for i in range(0, n, _SLICE):
        raw = hashes[i : i + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """Fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        hold_memory("simhash", _code.cache_clear)
        values = [fingerprint(t if isinstance(t, str) else None, shingle) for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return fingerprints(text)


@cache
def _code() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word, and the error pattern of each syndrome."""

    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (_GENERATOR << (bit - 11)), x)
        return x

    single = 1 << np.arange(23)
    patterns = [0, *single]
    patterns += [a | b for i, a in enumerate(single) for b in single[:i]]
    patterns += [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j]]
    patterns = np.array(patterns, np.int64)
    errors = np.zeros(2048, np.int64)
    errors[remainder(patterns)] = patterns
    step = 1 << 16
    syndromes = np.concatenate([remainder(np.arange(i, i + step)).astype(np.int16) for i in range(0, 1 << 23, step)])
    return syndromes, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within three bits of each 23-bit word (the code is perfect)."""
    syndromes, errors = _code()
    return (words ^ errors[syndromes[words]]) >> 11


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each word the indices that it and its 23 neighbours decode to, one or six different.

    Two words that differ in at most two bits have a neighbour in common, so they share a key.
    """
    around = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    return golay_index(around)


def _segment(values: np.ndarray, i: int) -> np.ndarray:
    start, width = _SEGMENTS[i]
    return (values >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.int64)


def bucket_keys(values: np.ndarray) -> list[np.ndarray]:
    """Join keys of each fingerprint: a segment as it is and a Golay key of the next one.

    At most two bits differ, so one of three segments is equal and the next one differs in at
    most two bits; each linked pair meets in at least one key.
    """
    keys = []
    for i in range(3):
        exact = _segment(values, i)
        fuzzy = golay_keys(_segment(values, (i + 1) % 3))
        keys.append((exact[:, None] << 14) + (fuzzy << 2) + i)
    return [np.unique(row) for row in np.concatenate(keys, axis=1)]


def _keys(fp: Column) -> Column:
    @F.pandas_udf("array<long>")
    def keys(fingerprints: pd.Series) -> pd.Series:
        hold_memory("simhash", _code.cache_clear)
        return pd.Series(bucket_keys(fingerprints.to_numpy(np.int64).view(np.uint64)), dtype=object)

    return keys(fp)


def fingerprint_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a`` < ``b`` of different fingerprints that differ in at most ``max_bits`` bits.

    ``prints`` has one distinct non-null long column ``fp``. Buckets are joined on their key;
    the few with more than ``_BLOCK`` fingerprints are cut into that many times more keys on one
    side and repeated on the other, so no task gets a whole one and no pair is lost.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys are complete for at most two differing bits")
    keyed = stored(prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key")), "keys")
    crowded = keyed.groupBy("key").count().where(F.col("count") > _BLOCK)
    crowded = stored(crowded.select("key", F.ceil(F.col("count") / _BLOCK).cast("int").alias("parts")), "crowded")
    left = right = keyed.withColumn("part", F.lit(0))
    if not crowded.isEmpty():
        marked = keyed.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        left = marked.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        right = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    l, r = left.select("key", "part", F.col("fp").alias("a")), right.select("key", "part", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return l.join(r, (l.key == r.key) & (l.part == r.part) & close).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``id``, ``fp``, ``group`` (one fingerprint of the group), ``component_id`` per row of ``docs``.

    Rows with one fingerprint are one node, so copies are never paired; links between different
    fingerprints are followed to the end. ``component_id`` is the smallest id of the group, null
    if all its ids are null. Null and empty texts have fingerprint 0 and are linked like others.
    Repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), fingerprint_column(F.col(f"`{text}`"), shingle).alias("fp"))
    rows = stored(rows, "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), max_bits), "a", "b")
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    least = linked.groupBy("group").agg(F.min("least").alias("component_id"))
    of_print = linked.select("fp", "group").join(least, "group")
    return rows.join(of_print, "fp").select("id", "fp", "group", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest id, with all its columns.

    If several rows of a group have that id (repeated rows), or the group has no id at all, one of
    them stays. The decision is made on narrow tables. Rows whose id occurs once are kept by a join
    on the id, broadcast if the ids are small as written; only rows whose id occurs several times
    get their fingerprint computed again. Null and empty texts are documents like others; an empty
    table stays empty; columns may have any names.
    """
    id_ = F.col(f"`{id_column}`")
    groups = stored(simhash_groups(docs, id_column, text, shingle, max_bits), "groups")
    chosen = F.col("id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.count_if(chosen).alias("chosen")).where("chosen > 0")
    ids = stored(ids.select(F.col("id").alias("kept_id"), (F.col("times") == 1).alias("single")), "ids")
    single = small_or_not(stored(ids.where("single").select("kept_id"), "single-ids"), _SMALL_IDS)
    once = docs.join(single, id_.eqNullSafe(single["kept_id"]), "left_semi")
    several = ids.where("NOT single").select("kept_id")
    if several.isEmpty():
        return once
    several = small_or_not(stored(several, "several-ids"), _SMALL_IDS)
    fp, group = free_names(docs, "simhash", "simhash_group")
    rows = docs.join(several, id_.eqNullSafe(several["kept_id"]), "left_semi").withColumn(fp, fingerprint_column(F.col(f"`{text}`"), shingle))
    marked = groups.where(chosen).join(several, groups["id"].eqNullSafe(several["kept_id"]), "left_semi")
    marked = marked.groupBy(F.col("fp").alias("marked_fp"), F.col("id").alias("marked_id")).agg(F.first("group").alias(group))
    marked = small_or_not(stored(marked, "marked"))
    found = rows.join(marked, (F.col(fp) == marked["marked_fp"]) & id_.eqNullSafe(marked["marked_id"]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.unionByName(found.drop(marked["marked_fp"], marked["marked_id"]).dropDuplicates([group]).select(*columns))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

"""Ring sharding, the prefix trie and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import periodic_runs, prefix_trie
from cohortlens.llm.common import ship_package, table
from cohortlens.llm.periodic_runs import RunSettings, collapse, repeated_words, run_columns, runs_of_texts, strongest
from cohortlens.llm.prefix_trie import conversation_trie, turn_sequences
from cohortlens.llm.queries import ORACLES, QUERIES
from cohortlens.llm.sharding import ring_shards
from tests.llm.data import SF, odd_documents
from tools.compare import differences

NOTHING = hashlib.sha256(b"").hexdigest()


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 7 partitions that stay 7 however little they hold."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


# --- ring -----------------------------------------------------------------------------------------


def position(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def plain_ring(keys, shards, nodes, slack=0.0):
    """Shard counts per key: keys one by one in ring order, each to the first shard with room."""
    tokens = sorted((position(f"shard/{s}/{j}"), s) for s in range(shards) for j in range(nodes))
    n = len(keys)
    room = [n // shards + (s < n % shards) for s in range(shards)] if not slack else [-(-round(n * (1 + slack) * 1000) // (shards * 1000))] * shards

    def arc(key):
        return sum(t < position(key or "") for t, _ in tokens) % len(tokens)

    got = Counter()
    for a, _, key in sorted((arc(k), position(k or ""), (k is not None, k or "")) for k in keys):
        s = next(s for _, s in tokens[a:] + tokens[:a] if room[s])
        room[s] -= 1
        got[(key[1] if key[0] else None), s] += 1
    return got


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["placed"]["shard"]].append(r["placed"]["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return {s: len(x) for s, x in slots.items()}


@pytest.mark.parametrize("hot", [0, 150])
def test_ring_equals_one_key_after_another(spark, many_partitions, hot):
    rng = random.Random(3)
    keys = [str(rng.randrange(10**6)) for _ in range(300)] + ["7"] * hot + [None, None, "", ""]
    for slack in (0.0, 0.25):
        rows = ring_shards(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k", shards=7, virtual_nodes=5, slack=slack).collect()
        assert Counter((r["k"], r["placed"]["shard"]) for r in rows) == plain_ring(keys, 7, 5, slack)
        sizes = check_slots(rows)
        if not slack:
            assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1


def test_ring_keeps_rows_and_columns_and_does_not_depend_on_partitions(spark, many_partitions):
    docs = odd_documents(spark).withColumnRenamed("key", "arc").withColumnRenamed("node", "row").withColumnRenamed("group", "a.b")
    placed = ring_shards(docs, "doc_id", shards=4, virtual_nodes=3, ties=["text"])
    assert placed.columns == [*docs.columns, "placed"] and check_slots(placed.collect())
    plain = sorted(map(str, docs.collect()))
    assert sorted(map(str, placed.drop("placed").collect())) == plain
    again = ring_shards(docs.repartition(3, "text"), "doc_id", shards=4, virtual_nodes=3, ties=["text"])
    assert sorted(map(str, placed.collect())) == sorted(map(str, again.collect()))
    assert ring_shards(docs.limit(0), "doc_id", shards=4).collect() == []


def test_one_more_shard_moves_few_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id")

    def moved(slack, nodes):
        a, b = (ring_shards(docs, "doc_id", shards=n, virtual_nodes=nodes, slack=slack).select("doc_id", F.col("placed.shard").alias(f"s{n}")) for n in (10, 11))
        return a.join(b, "doc_id").agg(F.avg((F.col("s10") != F.col("s11")).cast("int"))).first()[0]

    # 1 in 11 has to move; a plain remainder would move 10 in 11.
    assert moved(0.25, 64) < 0.2
    assert moved(0.0, 64) < 0.4


def test_ring_query_equals_sql_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_ring_shards"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(got, con.sql(ORACLES["op11_ring_shards"]).df()) == ""


def test_ring_query_uses_no_python_rows(spark):
    text = QUERIES["op11_ring_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", text)


# --- trie -----------------------------------------------------------------------------------------


def plain_trie(rows):
    """Nodes of rebuilt conversations by walking every prefix."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = tuple(turns.get(leader, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(children[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check_trie(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("x") for c in ("conv", "turns", "key", "shard", "kind", "t", "ids")})
    assert sorted(map(tuple, conversation_trie(frame).collect()), key=str) == plain_trie(rows)


def random_conversations(rng, n, words, longest):
    rows = []
    for c in rng.sample(range(-20, 400), n):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for t in range(rng.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_plain_one_over_many_shards(spark, many_partitions, monkeypatch, seed):
    rng = random.Random(seed)
    ship_package(spark)
    rows = random_conversations(rng, 120, ["a", "b b", "c \x0b c c", ""], 6)
    # A crowd of equal conversations, cut over shards, and long ones that share a long beginning.
    rows += [(1000 + 20 * c, t, "user", f"same {t}") for c in range(60) for t in range(3)]
    rows += [(5000 + 20 * c, t, "user", "deep" if t < 30 + c else f"own {c}") for c in range(4) for t in range(40)]
    check_trie(spark, rows)


def test_trie_of_odd_turns(spark, many_partitions):
    ship_package(spark)
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "", "user"), (2, 5, "user", "x" * 200_000),
        (3, 2, "u", "b"), (3, 1, "u", "a"), (None, 1, "u", "a"), (21, 1, "u", "only"), (20, 1, None, "\t"), (40, 0, "a", "1"), (41, 0, "a", "1"),
        (2**62, 0, "u", "a"), (-5, 0, "u", "a"),
    ]
    check_trie(spark, rows)
    check_trie(spark, rows[1:2])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(empty).collect() == [] and turn_sequences(empty).collect() == []


def test_streamed_digest_over_parts():
    import pandas as pd

    parts = [(b"k", b"1,2"), (b"k", b"3"), (b"m", b"9")]
    batches = [pd.DataFrame(parts[:1], columns=["key", "ends"]), pd.DataFrame(parts[1:], columns=["key", "ends"])]
    got = dict(pd.concat(prefix_trie._streamed_digests(iter(batches))).itertuples(index=False))
    assert got == {b"k": hashlib.sha256(b"1,2,3").hexdigest(), b"m": hashlib.sha256(b"9").hexdigest()}


# --- runs -----------------------------------------------------------------------------------------


def plain_runs(words, least=24, periods=3):
    """Every maximal stretch of every period, the smallest period of equal stretches."""
    found = {}
    for p in range(1, len(words) // periods + 1):
        i = 0
        while i < len(words) - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, periods * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def repetitive(rng, letters, length):
    words = []
    while len(words) < length:
        unit = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        words += (unit * 12)[: rng.randrange(1, 9 * len(unit))] if rng.random() < 0.6 else unit
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_equal_plain_ones(letters):
    rng = random.Random(letters)
    texts = [repetitive(rng, letters, rng.randrange(300)) for _ in range(150)] + [[], [b"a"] * 23, [b"a"] * 24]
    got = [g for i in range(0, len(texts), 7) for g in runs_of_texts(texts[i : i + 7])]
    assert got == [plain_runs(t) for t in texts]
    assert sum(map(len, got)) > 20


def test_runs_do_not_rest_on_fingerprints(monkeypatch):
    """Fingerprints that call many different stretches equal only cost time."""
    rng = random.Random(9)
    texts = [repetitive(rng, 2, 200) for _ in range(10)]
    monkeypatch.setattr(periodic_runs._Suffixes, "same", lambda self, a, b, length: (self.sums[a] ^ self.sums[b]) % 3 < 2)
    assert runs_of_texts(texts) == [plain_runs(t) for t in texts]


def test_words_that_defeat_wrapping_fingerprints():
    word = [0]
    for _ in range(12):
        word += [1 - x for x in word]
    half = [b"%d" % x for x in word]
    other = [b"%d" % (1 - x) for x in word]
    assert runs_of_texts([half + other + half + other]) == [[]] == [plain_runs(half + other + half + other)][:1]
    assert runs_of_texts([half * 3 + other]) == [plain_runs(half * 3 + other)]


def test_settings_that_catchers_cannot_serve_are_refused():
    with pytest.raises(ValueError):
        RunSettings(least_words=20)
    with pytest.raises(ValueError):
        RunSettings(least_periods=2)
    texts = [[b"a", b"b"] * 40, [b"a"] * 60 + [b"b"] * 30]
    assert runs_of_texts(texts, RunSettings(50, 5)) == [plain_runs(t, 50, 5) for t in texts]


def plain_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and n and h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    lines = "".join("%d,%d,%d\n" % r for r in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_query_equals_plain_rows(spark):
    docs = table(spark, SF, "documents").where("n_chars < 4000")
    ids = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect() if r["doc_id"] in ids]
    assert sorted(got) == sorted(plain_row(i, t) for i, t in ids.items())
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_of_odd_documents(spark):
    ship_package(spark)
    docs = odd_documents(spark).unionByName(odd_documents(spark).limit(1).select(
        *[F.lit("ab cd " * 400_000).alias(c) if c == "text" else F.lit(8).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in odd_documents(spark).columns]
    ))
    found = run_columns(docs.withColumnRenamed("group", "runs").withColumnRenamed("label", "start")).collect()
    assert len(found) == docs.count()
    for r in found:
        p = r["periodic"]
        if len(r["text"] or "") > 50_000:
            assert [tuple(x) for x in p["runs"]] == [(0, 800_000, 2)] and p["exponent_milli"] == 400_000_000
            continue
        want = plain_row(r["doc_id"], r["text"])
        assert (r["doc_id"], len(p["runs"]), *[p[c] for c in ("start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")]) == want
    assert run_columns(docs.limit(0)).collect() == []


def test_parts_of_runs():
    assert strongest([(0, 30, 10), (5, 24, 8), (40, 9, 3)]) == (0, 30, 10)
    assert strongest([]) is None
    assert collapse([b"a", b"b"] * 3, [(0, 6, 2)]) == [b"a", b"b"]
    # Text 6 of the test tables is one of those that repeat their words.
    assert zlib.crc32(b"6") % 10 == 0 and repeated_words(None, [b"a"] * 5) == [b"a"] * 5

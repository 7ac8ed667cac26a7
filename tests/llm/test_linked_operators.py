"""Operators over many rows (links, templates, host walks) and the pipeline against brute force."""

from __future__ import annotations

import random
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import embeddings, simhash
from cohortlens.llm.common import ship_package
from cohortlens.llm.embeddings import IndexSettings, ProductIndex, cosine_links
from cohortlens.llm.html_extract import TemplateSettings, extract_main_text, host_templates, main_text, page_tokens
from cohortlens.llm.links import components
from cohortlens.llm.oracles import COSINE_LINKS_SQL, URL_RULES
from cohortlens.llm.queries import ORACLES, QUERIES
from cohortlens.llm.urls import Rule, host_edges, host_scores, judge_urls
from tests.llm.data import SF, odd_documents, odd_texts
from tests.llm.test_text_operators import check_packing
from tools.compare import differences


def groups_of(nodes, linked):
    """Smallest reachable node of each node, plainly."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# --- components ----------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components_equal_plain_ones(spark, shape):
    rng = random.Random(1)
    links = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(300)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "none": [(3, 3)],
    }[shape]
    frame = spark.createDataFrame([*links, *links[:5]], "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame, "a", "b").collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    expected = groups_of(nodes, [x for x in links if x[0] != x[1]])
    # The smallest node of a group has no row: it is its own root.
    assert {n: got.get(n, n) for n in nodes} == expected


# --- simhash -------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_plain_ones():
    for text in [*odd_texts(), None]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def test_golay_code_is_perfect_and_keys_meet():
    words = np.random.default_rng(2).integers(0, 1 << 23, 3000)
    index = simhash.golay_index(words)
    assert index.min() >= 0 and index.max() < 4096
    assert (np.bincount(simhash.golay_index(np.arange(1 << 23))) == 2048).all()
    keys = [set(k) for k in simhash.golay_keys(words).tolist()]
    assert {len(k) for k in keys} <= {1, 6}
    rng = random.Random(3)
    for w, k in zip(words.tolist(), keys):
        other = w ^ 1 << rng.randrange(23) ^ 1 << rng.randrange(23)
        assert k & set(simhash.golay_keys(np.array([other])).tolist()[0])


@pytest.mark.parametrize("block", [512, 8])
def test_fingerprint_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "_BLOCK", block)
    ship_package(spark)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            f = c
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert {(r["a"], r["b"]) for r in got} == expected and len(got) == len(expected)


def test_registered_simhash(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = groups_of(prints, linked)
    rows = QUERIES["op8_simhash_groups"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == groups[r["doc_id"]]


def test_one_document_of_each_group_stays(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert set(map(str, kept.collect())) <= set(map(str, docs.collect()))
    prints = {plain_fingerprint(r["text"]) for r in docs.collect()}
    groups = set(groups_of(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]).values())
    assert kept.count() == len(groups)
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    only_nulls = docs.where("doc_id IS NULL")
    assert simhash.drop_near_duplicates(only_nulls.union(only_nulls)).count() == 2


# --- embeddings ----------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(12):
                rows.append((i, (centre + rng.normal(size=16) * 0.09).tolist(), label))
                i += 1
    copy = rows[3][1]
    rows += [(1000 + k, copy, rows[3][2]) for k in range(40)] + [(2000, [3 * x for x in copy], rows[3][2])]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [None] * 16, 0), (3004, [float("inf")] * 16, 0), (3005, [], 0), (3006, [1.0, 2.0], 0), (3007, [2.0, 4.0], 0), (3008, [1e300, 2e300], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def plain_links(rows, least=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.max(np.abs(v))
        return v / np.linalg.norm(v)

    units = {r["vec_id"]: unit(r["embedding"]) for r in rows}
    label = {r["vec_id"]: r["label"] for r in rows}
    return [(a, b) for a in units for b in units if a < b and label[a] is not None and label[a] == label[b] and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least]


@pytest.mark.parametrize("block", [2048, 7])
def test_cosine_links_equal_brute_force(spark, block):
    ship_package(spark)
    frame = vectors(spark)
    rows = frame.collect()
    linked = plain_links(rows)
    groups = groups_of([r["vec_id"] for r in rows], linked)
    settings = IndexSettings(least_lists=8, subspaces=4, codewords=8, block=block)
    got = {r["id"]: r for r in cosine_links(frame, settings=settings).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"]) == (sum(i in pair for pair in linked), groups[i])


def test_queries_of_a_short_list_are_cut_by_their_own_number(spark, monkeypatch):
    ship_package(spark)
    rng = np.random.default_rng(7)
    frame = spark.createDataFrame([(i, ([1.0, 0, 0, 0] + rng.normal(size=4) * 0.1).tolist(), 0) for i in range(1500)], "vec_id long, embedding array<double>, label int")
    search = embeddings._search

    def bounded(index, queries, members, least):
        assert len(queries) <= 128 and len(members) <= 128, (len(queries), len(members))
        return search(index, queries, members, least)

    monkeypatch.setattr(embeddings, "_search", bounded)
    got = cosine_links(frame, settings=IndexSettings(least_lists=64, subspaces=2, codewords=8, block=64)).collect()
    rows = frame.collect()
    units = np.array([r["embedding"] for r in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = (units @ units.T >= 0.98).sum(1) - 1
    assert {r["id"]: r["n_links"] for r in got} == {r["vec_id"]: k for r, k in zip(rows, links.tolist())}


def test_probes_reach_every_list_within_the_radius():
    rng = np.random.default_rng(6)
    units = rng.normal(size=(400, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    index = ProductIndex.fit(units, 30, IndexSettings(subspaces=4, codewords=16))
    own = ((units[:, None] - index.centres[None]) ** 2).sum(2).argmin(1)
    near = ((units[:, None] - units[None]) ** 2).sum(2) <= 0.5**2
    probes = index.probes(units, 0.5)
    assert all(probes[i, own[j]] for i, j in zip(*np.nonzero(near)))


def test_vectors_travel_without_loss():
    rows = np.array([[0.5, -2.0, 0.0], [0.1, 1.0, 2.0], [1e300, 1.0, 5e-324], [np.float32(0.1), np.float32(-3e-39), -0.0], [1e39, 0.0, 1.0]])
    packed = embeddings._packed(rows)
    assert [len(b) for b in packed] == [12, 24, 24, 12, 24]
    assert np.array_equal(embeddings._unpacked(pd.Series(packed), 3), rows)


@pytest.mark.parametrize("name", ["op3_embedding_links", "op5_url_filters"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert differences(got, con.sql(ORACLES[name]).df()) == "" and (name != "op3_embedding_links" or ORACLES[name] == COSINE_LINKS_SQL)


def test_empty_vectors(spark):
    assert cosine_links(vectors(spark).limit(0)).count() == 0


# --- urls ----------------------------------------------------------------------------------------


def plain_scores(pages, edges, damping=0.85):
    hosts = sorted({h for h, _ in pages} | {h for e in edges for h in e[:2]})
    at = {h: i for i, h in enumerate(hosts)}
    result = {}
    for kind in ("allow", "block"):
        start = np.zeros(len(hosts))
        for h, v in pages:
            start[at[h]] += v == kind
        start /= max(start.sum(), 1)
        walk = np.zeros((len(hosts), len(hosts)))
        for a, b, w in edges:
            a, b = (a, b) if kind == "allow" else (b, a)
            walk[at[a], at[b]] += w
        out = walk.sum(1)
        walk = np.divide(walk, out[:, None], out=np.zeros_like(walk), where=out[:, None] > 0)
        rank = start.copy()
        for _ in range(20):
            rank = start * ((1 - damping) + damping * rank[out == 0].sum()) + damping * rank @ walk
        result[kind] = dict(zip(hosts, rank))
    return result


def test_trust_and_distrust_follow_links(spark):
    rows = [
        (1, "http://good.org/x", '<a href="http://near.net/a">n</a> <A HREF=//near.net:80/b>n</A> <a href="/own">o</a>'),
        (2, "http://near.net/x", '<a href="https://far.net/">f</a><a href="http://near.net/self">s</a>'),
        (3, "http://farm.net/x", '<a href="http://user@bad.com/q">b</a>'),
        (4, "http://bad.com/de/1", "<a href='http://far.net'>f</a>"),
        (5, "http://alone.net/", None),
        (6, None, "<a href='http://bad.com/'>b</a>"),
        (6, "no scheme", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r for r in judge_urls(pages, URL_RULES).collect()}
    edges = [("good.org", "near.net", 1), ("near.net", "far.net", 1), ("farm.net", "bad.com", 1), ("bad.com", "far.net", 1)]
    verdicts = [("good.org", "allow"), ("near.net", None), ("farm.net", None), ("bad.com", "block"), ("alone.net", None)]
    scores = plain_scores(verdicts, edges)
    for i in range(1, 6):
        assert got[i]["trust"] == pytest.approx(scores["allow"][got[i]["host"]]) and got[i]["distrust"] == pytest.approx(scores["block"][got[i]["host"]])
    assert [got[i]["verdict"] for i in range(1, 6)] == ["allow", "allow", "block", "block", "allow"]
    assert judge_urls(pages, URL_RULES).count() == 7 and got[6]["host"] == "" and got[6]["verdict"] == "allow"
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("HTTPS://Sub.EXAMPLE.org/es/x?q#f", "sub.example.org", "/es/x", "example.org/es/"),
        ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/"),
        ("http://notexample.org", "notexample.org", "", None),
        ("x://a.com/fr/?://b", "a.com", "/fr/", "com/fr/"),
        ("x://com/de/1", "com", "/de/1", "com/de/"),
        ("http://É.com?/fr/", "É.com", "", None),
        ("nothing", "", "", None),
        (None, "", "", None),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")
    r = judge_urls(pages, URL_RULES).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)


def test_the_longest_rule_wins_and_of_equal_ones_the_last(spark):
    long, short, other = Rule("block", "a.b", "/x"), Rule("allow", "b", "/x"), Rule("allow", "b", "/x/y")
    pages = spark.createDataFrame([(1, "q://a.b/x/y", None), (2, "q://c.b/x/z", None)], "page_id long, url string, html string")

    def chosen(*rules):
        return [(r["rule"], r["verdict"]) for r in judge_urls(pages, rules).orderBy("id").collect()]

    for rules in ((long, short), (short, long)):
        assert chosen(*rules) == [("a.b/x", "block"), ("b/x", "allow")]
    assert len(long.text) == len(other.text)
    assert chosen(short, long, other)[0] == ("b/x/y", "allow") and chosen(short, other, long)[0] == ("a.b/x", "block")


def test_a_host_without_links_has_one_row(spark):
    hosts = spark.createDataFrame([("a", None, None)], "host string, verdict string, html string")
    assert host_scores(hosts.select("host", "verdict"), host_edges(hosts.select("host", "html"))).count() == 1


# --- html ----------------------------------------------------------------------------------------


def test_article_is_what_remains():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav>Menu</nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Big   title</h1></header><p>One &amp; two<br>three</p>
    <aside>Side</aside><p><b>Open.<p>Next &lt;3</p><script>var a = "</p>";</script><form><input><label>Mail</label></form>
    <section id="comments"><p>First!</p></section></article><div class=ad>Buy</div><!-- <p>no</p> --><footer>&copy; x</footer>"""
    assert main_text(page) == "Big title\n\nOne & two three\n\nOpen.\n\nNext <3"


@pytest.mark.parametrize(
    "page",
    [
        "<html class='no-search'><body class='home has-sidebar header-fixed'><p>Text</p></body></html>",
        "<body><article class='post comments-open'><p>Text</p></article><div class='sidebar'>Side</div></body>",
        "<body><main class='search'><p>Text</p></main></body>",
        "<body><div class='no-nav content'><p>Around</p><article><p>Text</p></article><p>After</p></div></body>",
        "<main><div class='with-sidebar'><div class='no-banner'><article><p>Text</p><div class='share'>Share</div></article></div></div></main>",
        "<article><p>Text</p><section id='comments'><article class='comment'><p>First!</p></article></section></article>",
        "<article><p>Text</p></article><div class='related'><article class='related-item'><p>Other</p></article></div><aside><article><p>Side</p></article></aside>",
        "<div class='layout comments-open'><article class='post comments-open'><p>Text</p></article></div>",
        "<div class='popup' hidden><article><p>Hidden</p></article></div><p>Text</p>",
    ],
)
def test_class_words_on_wrappers_keep_the_article(page):
    assert main_text(page) == "Text"


@pytest.mark.parametrize("source", [None, "", "   ", "<", "<p", "a < b", "<p a='x>y", "<!-- x", "<script>x", "</p></div>", "<a>" * 500, "&#x41;&bogus;"])
def test_broken_pages_do_not_crash(source):
    assert isinstance(main_text(source), str)


def test_plain_text_and_character_references():
    assert main_text("a < b &amp; c") == "a < b & c"
    assert main_text("<p title='x > y'>A\u00a0B</p>") == "A B"


def test_template_words_are_no_content(spark):
    ship_package(spark)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, expected = [], {}
    for i in range(30):
        text = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(3)]
        body = "".join(f"<p>{t}</p>" for t in text)
        rows.append((i, "http://a.org/x", f"<div><div>Welcome to our site</div><div>Read this first</div>{body}<div>Tell your friends now</div></div>"))
        expected[i] = "\n\n".join(text)
    rows += [(100 + i, "http://b.org/x", "<p>The same page each time, all of it</p><p>And more</p>") for i in range(30)]
    rows += [(200, None, "<p>No host</p>"), (201, "http://a.org/y", None), (202, "http://c.org", "")]
    extra = ("host", "template", "_host", "_template")
    pages = spark.createDataFrame([(*r, *extra) for r in rows], "page_id long, url string, html string, host string, template string, _host string, _template string")
    extracted = extract_main_text(pages).collect()
    assert all(tuple(r[c] for c in extra) == extra for r in extracted)
    got = {r["page_id"]: r["text"] for r in extracted}
    assert len(got) == len(rows)
    assert all(got[i] == t for i, t in expected.items())
    assert all(got[100 + i] == "The same page each time, all of it\n\nAnd more" for i in range(30))
    assert (got[200], got[201], got[202]) == ("No host", "", "")
    assert extract_main_text(pages.limit(0)).count() == 0
    # On a host with too few pages for an outer template the frame is a part; without support there is no template at all.
    assert extract_main_text(pages, settings=TemplateSettings(least_pages=100)).where("page_id = 0").first()["text"] == expected[0]
    assert extract_main_text(pages, settings=TemplateSettings(least_support=100, least_pages=100)).where("page_id = 0").first()["text"].startswith("Welcome")


def test_copies_of_a_page_count_once(spark):
    ship_package(spark)
    page = lambda i: f"<div><div>Welcome to our site</div><p>Story{i} a{i} b{i}</p><p>c{i} d{i}</p><div>Tell your friends now</div></div>"
    story = lambda i: f"Story{i} a{i} b{i}\n\nc{i} d{i}"
    # One page a thousand times beside ten others; copies of a page without the template beside 40 pages with it.
    rows = [("http://a.org/x", page(0), story(0))] * 1000 + [("http://a.org/x", page(i), story(i)) for i in range(1, 11)]
    rows += [("http://b.org/x", "<p>Plain page</p>", "Plain page")] * 50 + [("http://b.org/x", page(i), story(i)) for i in range(40)]
    got = extract_main_text(spark.createDataFrame(rows, "url string, html string, expected string"))
    assert got.count() == len(rows) and got.where("text <> expected").count() == 0


def test_articles_of_the_test_pages(spark):
    rows = QUERIES["op1_template_extraction"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["text"]
        inside = main_text(r["html"][r["html"].index("<article>") :].split("</article>")[0])
        assert r["text"] == inside


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, frame = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        frame = spark.createDataFrame(frame.collect(), docs.schema)
        counts.append(frame.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    check_packing(corpus_pipeline.run(spark, SF).collect(), texts)


def test_pipeline_of_odd_rows(spark):
    frame = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() >= 0
        assert stage(spark, frame.limit(0), SF).count() == 0


def test_the_rest_does_not_need_this_package():
    code = (
        "import sys; sys.modules['cohortlens.llm'] = None\n"
        "import importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline',) or name.startswith('cohortlens.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "del sys.modules['cohortlens.llm']; sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') for k in q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True)


# --- optional parts of templates -----------------------------------------------------------------


def story(rng, words=60):
    paragraphs = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.randint(words // 2, words))) for _ in range(4)]
    return paragraphs


def texts_of(spark, rows):
    """Extracted text by page; rows are (page_id, url, html)."""
    ship_package(spark)
    return {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_optional_parts_and_small_hosts_come_out_clean(spark):
    rng, rows, want = random.Random(21), [], {}

    def page(host, parts, notice="", frame=("", "")):
        i = len(rows)
        body = [f"<p>{p}</p>" for p in parts]
        middle = len(body) // 2
        html = "".join([frame[0], "<div>", *body[:middle], notice, *body[middle:], "</div>", frame[1]])
        rows.append((i, f"http://{host}/{i}", html))
        want[i] = "\n\n".join(parts)

    # A notice on half of the pages, an offer on a third, sometimes both; no telling names.
    for i in range(40):
        notice = "<section><p>Read the rules of this place before you write to us</p></section>" * (i % 2) + "<div><span>Offer</span> of the week is here</div>" * (i % 3 == 0)
        page("half.org", [*story(rng), *["As they say every rose has its thorn"] * (i % 4 > 1)], notice)
    # Five pages with the same words around each story.
    for i in range(5):
        page("small.org", story(rng), frame=("<div>All about gardens and trees</div>", "<div>Written by the garden club, tell your friends</div>"))
    got = texts_of(spark, rows)
    assert got == want


def test_near_copies_and_shared_passages_stay(spark):
    rng, rows, want = random.Random(22), [], {}

    def page(host, parts):
        i = len(rows)
        rows.append((i, f"http://{host}/{i}", "<div>" + "".join(f"<p>{p}</p>" for p in parts) + "</div>"))
        want[i] = "\n\n".join(parts)

    for _ in range(30):
        page("news.org", story(rng))
    # Six near copies of one story, each with another last paragraph; a passage quoted on five other pages.
    copied, passage = story(rng), " ".join(story(rng)[0].split()[:40])
    for _ in range(6):
        page("news.org", [*copied[:3], story(rng)[0]])
    for _ in range(5):
        page("news.org", [*story(rng)[:3], passage, story(rng)[0]])
    for _ in range(4):
        page("copies.org", [*copied[:3], story(rng)[0]])
    assert texts_of(spark, rows) == want


def plain_classes(pages, settings):
    """Parts of one host by comparing whole occurrence vectors, and every page by itself."""
    tokens = [page_tokens(p, settings) for p in dict.fromkeys(pages)]
    vectors = {t: tuple(p.get(t, (0,))[0] for p in tokens) for p in tokens for t in p}
    classes = {}
    for t, v in vectors.items():
        classes.setdefault(v, []).append(t)
    support = {v: sum(x > 0 for x in v) for v in classes}
    element = {v: any(p[t][2] for t in ts for p in tokens if t in p) for v, ts in classes.items()}
    large = {
        v: sorted(ts, key=lambda t: np.mean([p[t][1] for p in tokens if t in p])) for v, ts in classes.items()
        if len(ts) >= settings.least_tokens and support[v] >= settings.least_support
        and (support[v] >= settings.share * len(tokens) or element[v])
    }
    outer = {v for v in large if len(tokens) >= settings.least_pages and support[v] >= settings.share * len(tokens)}
    parts = set()
    for v, ts in large.items():
        gaps, valid = {}, v not in outer
        for p, n in zip(tokens, v):
            if n:
                row = [p[t][1] for t in ts]
                valid &= all(a < b for a, b in zip(row, row[1:]))
                for w, us in large.items():
                    if us[0] in p and support[w] > support[v]:
                        before = {sum(p[u][1] < place for u in us) for place in row}
                        valid &= gaps.setdefault(w, before) == before and len(before) == 1
        if valid:
            parts.add(frozenset(ts))
    return {t for v in outer for t in large[v]}, parts


def test_templates_equal_plain_deduction(spark):
    ship_package(spark)
    rng, settings = random.Random(23), TemplateSettings()
    rows, hosts = [], {}
    for h, n in enumerate((30, 12, 6, 3, 2)):
        bits = [f"<div><b>bit{h}</b> {' '.join(story(rng)[0].split()[:4])}</div>" for _ in range(5)]
        for i in range(n):
            chosen = [b for k, b in enumerate(bits) if k == 0 or rng.random() < 0.5]
            if rng.random() < 0.3:
                rng.shuffle(chosen)
            body = [f"<p>{p}</p>" for p in story(rng, 20)]
            html = "<main>" + "".join([*chosen[:2], *body, *chosen[2:]]) + "</main>"
            rows += [(f"h{h}", html)] * (1 + (i == 0))
            hosts.setdefault(f"h{h}", []).append(html)
    found = host_templates(spark.createDataFrame(rows, "host string, html string").repartition(4), settings).collect()
    got = {r["host"]: ({t["token"] for t in r["outer"] or []}, {frozenset(p) for p in r["parts"] or []}) for r in found}
    for host, pages in hosts.items():
        assert got.get(host, (set(), set())) == plain_classes(pages, settings), host
    assert any(parts for _, parts in got.values()) and any(outer for outer, _ in got.values())

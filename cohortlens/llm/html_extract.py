"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens with equal occurrence vectors over the pages of a host form a class. Classes on nearly all
pages are the outer template; others are optional parts if they are valid: their tokens stand in
one order, inside one gap of every class that is on more pages. What is left are the slots.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortlens.llm.common import free_names, small_or_not, stored
from cohortlens.llm.urls import host_column

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")

# Fixed values of HTML: what ends a text block, what has no end tag, what holds no running text.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math object canvas audio video".split())
_NO_TEXT = frozenset("head nav footer aside form button select option label dialog menu search fieldset".split())
_CLOSED_BY = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: Words in class, id or role that name an element which is not the article.
_NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login register comment comments commentlist disqus respond reply replies discussion sidebar sidebars aside widget widgets "
    "related recommended recommendations breadcrumb breadcrumbs menu menus nav navigation navbar topbar footer masthead "
    "share sharing social toolbar pagination pager copyright complementary contentinfo search skip".split()
)
#: Such words that only count outside the article.
_PAGE_HEADER = frozenset({"header"})
#: Elements that no such word drops: on them it tells about the page (has-sidebar, comments-open).
_WRAPPERS = frozenset("html body main article".split())
#: Such words that name lists of other articles (readers' comments, teasers) and their entries.
_OTHER_ARTICLES = frozenset("comment comments commentlist respond reply replies discussion related recommended recommendations".split())
#: Class names that tell a state of an article, not what it is.
_STATE = re.compile(r"\b(?:has|no|with|without)-[\w-]+|\b[\w-]+-(?:open|closed|enabled|disabled|on|off)\b", re.I)


@dataclass(frozen=True)
class TemplateSettings:
    """When a class of tokens with equal occurrence vectors belongs to a host's template.

    It must hold ``least_tokens`` tokens. In ``share`` of the different pages of a host with
    ``least_pages`` of them it is the outer template. A class that occurs on ``least_support``
    different pages and brings an element of its own, or is in ``share`` of the pages of a smaller
    host, is an optional part if its tokens always stand in one order and inside one gap of each
    class that is on more pages; a line without markup of its own may be quoted, and stays. Parts that would take more than ``most_dropped`` of a page's words are that page's text:
    so near copies of an article are no template. A text block of up to ``word_block`` words is
    cut into words, a longer one is one token.
    """

    least_pages: int = 8
    share: float = 0.95
    least_tokens: int = 2
    word_block: int = 12
    least_support: int = 3
    most_dropped: float = 0.4


@dataclass
class Block:
    """A run of text between block tags: its place in the page's tree and its words."""

    path: str
    words: list[str]
    in_article: bool
    dropped: bool
    place: int


def _names(rest: str) -> tuple[str, set[str]]:
    """Class, id and role as written, and the words in them."""
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)]
    label = "".join(f"[{k}={v}]" for k, v in found)
    return label, {w for _, v in found for w in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())}


class _Page:
    """Cuts a page into blocks and notes the path and place of every element."""

    def __init__(self, source: str) -> None:
        self.blocks: list[Block] = []
        self.elements: list[tuple[int, str]] = []
        self._open: list[tuple[str, str, bool, bool, frozenset[str] | None]] = []  # name, path, in article, dropped, by which words (None: not by words alone)
        self._text: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        words = entities.unescape("".join(self._text)).split()
        self._text = []
        if words:
            _, path, inside, dropped, _ = self._open[-1] if self._open else ("", "", False, False, frozenset())
            self.blocks.append(Block(path, words, inside, dropped, len(self.blocks) + len(self.elements)))

    def _start(self, name: str, rest: str) -> None:
        block = name in _BLOCKS
        if block:
            self._flush()
            while self._open and name in _CLOSED_BY.get(self._open[-1][0], ()):
                self._open.pop()
        label, parts = _names(rest) if "=" in rest else ("", set())
        _, path, inside, dropped, by = self._open[-1] if self._open else ("", "", False, False, frozenset())
        fixed = name in _NO_TEXT or bool(rest and _HIDDEN.search(rest)) or name == "header" and not inside
        words = parts & (_NOT_ARTICLE if inside else _NOT_ARTICLE | _PAGE_HEADER) if name not in _WRAPPERS else set()
        own_drop = fixed or bool(words)
        if name in _VOID or not (block or own_drop):
            return
        article = name in ("article", "main") or "main" in parts and "role=" in rest
        if name in ("article", "main") and dropped and by is not None and not (by & _OTHER_ARTICLES and _names(_STATE.sub("", rest))[1] & _OTHER_ARTICLES):
            dropped, by = False, frozenset()
        path = f"{path}/{name}{label}"
        self.elements.append((len(self.blocks) + len(self.elements), path))
        by = None if fixed or by is None else by | words
        dropped = dropped or own_drop
        self._open.append((name, path, inside or article and not dropped, dropped, by))

    def _end(self, name: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == name:
                if name in _BLOCKS or self._open[i][3]:
                    self._flush()
                del self._open[i:]
                return
        if name in _BLOCKS:
            self._flush()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(source, at)
            if m is None:
                self._text.append(source[at:])
                break
            self._text.append(source[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._text.append(m[0][9:].removesuffix("]]>"))
                continue
            rest = m["rest"] or m["rest2"] or ""
            if m["close"] or m["close2"]:
                self._end(name)
                continue
            if name in _RAW:
                if rest.endswith("/") and name in ("svg", "math", "object"):
                    continue
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|</{re.escape(name)}\Z", re.I).search(source, at)
                at = stop.end() if stop else len(source)
                self._text.append(" ")
                continue
            if name == "br":
                self._text.append(" ")
            self._start(name, rest)
        self._flush()


def _hash(*parts: str) -> int:
    value = xxh64_intdigest("\x00".join(parts))
    return value - (1 << 64) if value >= 1 << 63 else value


def _block_tokens(block: Block, settings: TemplateSettings) -> list[int]:
    if len(block.words) <= settings.word_block:
        return [_hash("word", block.path, w) for w in block.words]
    return [_hash("text", block.path, " ".join(block.words))]


def page_tokens(source: str, settings: TemplateSettings) -> dict[int, tuple[int, int, bool]]:
    """Tokens of a page: how often each occurs, its first place, and whether it is an element.

    A token is an element with its path, or a word (or a long text) with the path where it
    stands, so equal words in different places are different tokens. Elements and blocks are
    numbered in page order.
    """
    page = _Page(source)
    found: dict[int, tuple[int, int, bool]] = {}

    def note(token: int, place: int, element: bool) -> None:
        n, first, _ = found.get(token, (0, place, element))
        found[token] = n + 1, first, element

    for place, path in page.elements:
        note(_hash("tag", path), place * 4096, True)
    for block in page.blocks:
        for i, token in enumerate(_block_tokens(block, settings), 1):
            note(token, block.place * 4096 + i, False)
    return found


def _in_order(template: dict[int, float], tokens: list[int]) -> set[int]:
    """Template tokens of a page that stand in the template's order (longest such row)."""
    tails: list[float] = []
    ends: list[int] = []
    before: list[int] = []
    rows = [(i, t) for i, t in enumerate(tokens) if t in template]
    for k, (_, t) in enumerate(rows):
        at = bisect_left(tails, template[t])
        if at == len(tails):
            tails.append(template[t])
            ends.append(k)
        else:
            tails[at], ends[at] = template[t], k
        before.append(ends[at - 1] if at else -1)
    kept, k = set(), ends[-1] if ends else -1
    while k >= 0:
        kept.add(rows[k][1])
        k = before[k]
    return kept


@dataclass
class Template:
    """Tokens of a host's outer template with their mean places, and the tokens of each optional part."""

    outer: dict[int, float]
    parts: list[frozenset[int]]


def main_text(source: str | None, template: Template | None = None, settings: TemplateSettings = TemplateSettings()) -> str:
    """Text of the slots that remain when the template and what is no article are taken away."""
    if not source:
        return ""
    page = _Page(source)
    blocks = [b for b in page.blocks if not b.dropped]
    if any(b.in_article for b in blocks):
        blocks = [b for b in blocks if b.in_article]
    if template and template.outer:
        tokens = [_block_tokens(b, settings) for b in blocks]
        valid = _in_order(template.outer, [t for row in tokens for t in row])
        blocks = [b for b, row in zip(blocks, tokens) if not all(t in valid for t in row)]
    if template and template.parts:
        on_page = page_tokens(source, settings)
        # A part is on the page with all of its tokens or not at all.
        inside = {t for part in template.parts if part <= on_page.keys() for t in part}
        left = [b for b in blocks if not all(t in inside for t in _block_tokens(b, settings))]
        words = sum(len(b.words) for b in blocks)
        if words - sum(len(b.words) for b in left) <= settings.most_dropped * words:
            blocks = left
    return "\n\n".join(" ".join(b.words) for b in blocks)


def class_gaps(classes: list[int], pages: list[int], places: list[int], ranks: list[int]) -> list[tuple[int, int, int, bool]]:
    """Per class of a page and each class that is on more pages: (class, other, gap, valid).

    The four lists have one entry per token: its class, on how many pages that is, where the token
    stands, and its number in the class. ``gap`` is how many tokens of the other class come
    before; valid says that the class stands in order and in one gap. A first row compares a class
    with itself, for its order alone.
    """
    members: dict[int, list[tuple[int, int]]] = {}
    support: dict[int, int] = {}
    for c, n, place, rank in zip(classes, pages, places, ranks):
        members.setdefault(c, []).append((rank, place))
        support[c] = n
    rows = {c: [p for _, p in sorted(m)] for c, m in members.items()}
    out = []
    for c, row in rows.items():
        ordered = all(a < b for a, b in zip(row, row[1:]))
        out.append((c, c, 0, ordered))
        for other in rows:
            if support[other] > support[c]:
                before = bisect_left(rows[other], row[0])
                out.append((c, other, before, ordered and before == bisect_left(rows[other], row[-1])))
    return out


def host_templates(pages: DataFrame, settings: TemplateSettings = TemplateSettings()) -> DataFrame:
    """``host``, ``outer`` (tokens and mean places of the outer template), ``parts`` (tokens of each optional part).

    ``pages`` has columns ``host`` and ``html``. Copies of a page on a host count once: tokens are
    kept once per (host, page hash, token), so no html is shuffled. The occurrence vector of a
    token (its count in each different page of the host) is summarised by sums of hashes of (page,
    count), which combine before the shuffle, so a host with a third of all pages is a few rows per
    task. Tokens with equal summaries form a class. Classes are checked page by page for one
    order, and for one gap in each class that is on more pages; one that fails on any page is no
    part.
    """
    pages = pages.where("host <> '' AND html IS NOT NULL")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 500):
                rows = [
                    (host, page, token, n, place, element)
                    for host, page, source in zip(batch["host"][s : s + 500], batch["page"][s : s + 500], batch["html"][s : s + 500])
                    for token, (n, place, element) in page_tokens(source, settings).items()
                ]
                yield pd.DataFrame(rows, columns=["host", "page", "token", "n", "place", "element"])

    keyed = pages.select("host", F.xxhash64("html").alias("page"), "html")
    found = keyed.mapInPandas(tokens, "host string, page long, token long, n int, place int, element boolean")
    once = found.groupBy("host", "token", "page").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.first("element").alias("element"))
    once = stored(once, "tokens")
    vectors = once.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"),
        F.bit_xor(F.xxhash64("page", "n")).alias("mark"),
        F.sum(F.pmod(F.xxhash64("n", "page"), F.lit(1 << 36))).alias("mark2"),
        F.avg("place").alias("place"),
        F.first("element").alias("element"),
    ).where(F.col("pages") >= settings.least_support)
    hosts = keyed.groupBy("host").agg(F.count_distinct("page").alias("different"))
    hosts = small_or_not(stored(hosts.where(F.col("different") >= settings.least_support), "hosts"))
    classes = vectors.join(hosts, "host").groupBy("host", "different", "pages", "mark", "mark2").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("tokens"), F.bool_or("element").alias("element")
    )
    classes = classes.where(F.size("tokens") >= settings.least_tokens)
    usual = F.col("pages") >= settings.share * F.col("different")
    classes = classes.where(usual | F.col("element")).withColumn("outer", usual & (F.col("different") >= settings.least_pages))
    classes = stored(classes.withColumn("class", F.xxhash64("pages", "mark", "mark2")), "classes")

    @F.pandas_udf("array<struct<class:long,other:long,gap:int,valid:boolean>>")
    def gaps(rows: pd.Series) -> pd.Series:
        fields, out = ("class", "pages", "place", "rank"), ("class", "other", "gap", "valid")
        return pd.Series([[dict(zip(out, x)) for x in class_gaps(*([t[f] for t in row] for f in fields))] for row in rows], dtype=object)

    listed = classes.select("host", "class", "pages", F.posexplode("tokens").alias("rank", "t"))
    listed = small_or_not(stored(listed.select("host", "class", "pages", "rank", F.col("t.token").alias("token")), "class-tokens"))
    seen = once.select("host", "page", "token", "place").join(listed, ["host", "token"])
    of_page = seen.groupBy("host", "page").agg(F.collect_list(F.struct("class", "pages", "place", "rank")).alias("rows"))
    pairs = of_page.select("host", F.explode(gaps("rows")).alias("c")).groupBy("host", "c.class", "c.other")
    pairs = pairs.agg((F.bool_and("c.valid") & (F.min("c.gap") == F.max("c.gap"))).alias("valid"))
    checked = pairs.groupBy("host", "class").agg(F.bool_and("valid").alias("valid")).where("valid")
    parts = classes.where("NOT outer").join(checked, ["host", "class"], "left_semi")
    parts = parts.groupBy("host").agg(F.collect_list("tokens.token").alias("parts"))
    outers = classes.where("outer").groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("outer"))
    return outers.join(parts, "host", "full")


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", settings: TemplateSettings = TemplateSettings(), name: str = "text") -> DataFrame:
    """Add column ``name``: the main text of each page's whole html.

    Templates are deduced from all pages of a host, then each page is read on its own: first
    without the blocks of the outer template, then without those of optional parts. Hosts with
    fewer than three different pages, and pages without a host, have no template; there and everywhere,
    elements that HTML or their names mark as no article are left out, and if a page has an
    article element, only what stands in it is text. A class word never drops html, body, main or
    article, and an article or main inside an element that only a class word drops is kept, unless
    both are named as comments or related articles (a list and its entry). Blocks are joined by an empty line, white
    space inside them is one space. Null and empty html give the empty text; all rows and columns
    stay; copies of a page get equal texts and do not make its article a template by themselves;
    an empty table stays empty; a column called ``name`` is replaced. Templates are broadcast if
    their files are small, else joined by host.
    """
    host, outer, parts = free_names(pages, "host", "outer", "parts")
    keyed = pages.withColumn(host, host_column(F.col(f"`{url}`")))
    narrow = keyed.select(F.col(host).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    templates = stored(host_templates(narrow, settings), "templates").withColumnsRenamed({"host": host, "outer": outer, "parts": parts})

    @F.pandas_udf("string")
    def extract(sources: pd.Series, outers: pd.Series, optional: pd.Series) -> pd.Series:
        texts = []
        for source, row, part in zip(sources, outers, optional):
            listed = {t["token"]: t["place"] for t in row} if isinstance(row, (list, np.ndarray)) else {}
            sets = [frozenset(int(t) for t in p) for p in part] if isinstance(part, (list, np.ndarray)) else []
            template = Template(listed, sets) if listed or sets else None
            texts.append(main_text(source if isinstance(source, str) else None, template, settings))
        return pd.Series(texts, dtype=object)

    joined = keyed.join(small_or_not(templates), host, "left")
    text = extract(F.col(f"`{html}`").cast("string"), F.col(outer), F.col(parts)).alias(name)
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns if c != name], text)

"""URL filters: path rules, and trust and distrust propagated over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import small_or_not, stored

#: Address after the scheme, host up to one of its ends, path up to query or fragment.
_AFTER_SCHEME = r"(?s)^.*?://"
_HOST = r"(?s)[/?#].*$"
_PATH = r"(?s)^[^/?#]*"
_LINKS = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([a-z][a-z0-9+.-]*:)?//([^\s\"'/?#>]+)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains and the paths that start as the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class WalkSettings:
    """``damping`` of both walks, most ``rounds``, and the change at which they end.

    A host is blocked if its distrust is more than ``ratio`` times its trust.
    """

    damping: float = 0.85
    rounds: int = 20
    change: float = 1e-9
    ratio: float = 1.0


def host_column(url: Column) -> Column:
    """Host of a url with A-Z in lower case; empty for a null url or one without ``://``."""
    host = F.regexp_replace(F.regexp_replace(url, _AFTER_SCHEME, ""), _HOST, "")
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), lower).otherwise("")


def path_column(url: Column) -> Column:
    """Path of a url up to ``?`` or ``#``; empty for a null url or one without ``://``."""
    rest = F.regexp_replace(F.regexp_replace(url, _AFTER_SCHEME, ""), _PATH, "")
    return F.when(F.contains(url, F.lit("://")), F.regexp_replace(rest, r"(?s)[?#].*$", "")).otherwise("")


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does.

    Length is that of host and path together; of rules of equal length the one given last wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src``, ``dst``, ``weight``: links between different hosts, from a column ``host``.

    A link counts once per page and target. Links without a host stay on their own and are none
    between hosts; user, port and capitals of a target are dropped.
    """
    targets = F.regexp_extract_all(F.col(f"`{html}`"), F.lit(_LINKS), F.lit(2))
    clean = F.transform(targets, lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, r"^.*@", ""), r":\d*$", "")))
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(clean)).alias("dst"))
    return linked.where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _seeds(judged: DataFrame) -> DataFrame:
    """``kind``, ``node``, ``start``: the share of all seed pages of a kind that lies on a host."""
    counts = judged.where("host <> '' AND verdict IS NOT NULL").groupBy(F.col("verdict").alias("kind"), F.col("host").alias("node")).agg(F.count(F.lit(1)).alias("pages"))
    counts = stored(counts, "seeds")
    total = counts.groupBy("kind").agg(F.sum("pages").alias("total"))
    return counts.join(F.broadcast(total), "kind").select("kind", "node", (F.col("pages") / F.col("total")).alias("start"))


def host_scores(judged: DataFrame, edges: DataFrame, settings: WalkSettings = WalkSettings()) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of every host with a page or a link.

    Trust starts on pages that a rule allows and follows links; distrust starts on pages that a
    rule blocks and follows links backwards, to those who link there. Both are personalised
    PageRank in one loop of joins on the host: a walker that has no link to follow, and one that
    stops, starts again at the seeds. The state of a round is one row per host and kind, written
    to the shared folder; links are added up per host before they meet, and a host with very many
    links is split by adaptive execution.
    """
    edges = stored(edges, "edges")
    steps = edges.select(F.lit("allow").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), "weight")
    steps = steps.unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("node"), F.col("src").alias("to"), "weight"))
    out = steps.groupBy("kind", "node").agg(F.sum("weight").alias("out"))
    steps = stored(steps.join(out, ["kind", "node"]).select("kind", "node", "to", (F.col("weight") / F.col("out")).alias("share")), "steps")
    leaving = stored(steps.select("kind", "node").distinct().withColumn("leaves", F.lit(1)), "leaving")
    hosts = judged.where("host <> ''").select(F.col("host").alias("node")).union(edges.select("src")).union(edges.select("dst")).distinct()
    kinds = hosts.withColumn("kind", F.explode(F.array(F.lit("allow"), F.lit("block"))))
    start = kinds.join(_seeds(judged), ["kind", "node"], "left").join(leaving, ["kind", "node"], "left")
    start = stored(start.select("kind", "node", F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("leaves", F.lit(0)).alias("leaves")), "start")
    state = start.withColumn("rank", F.col("start"))
    for _ in range(settings.rounds):
        moved = steps.join(state.select("kind", "node", "rank"), ["kind", "node"])
        moved = moved.groupBy("kind", F.col("to").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        idle = state.groupBy("kind").agg(F.sum(F.when(F.col("leaves") == 0, F.col("rank")).otherwise(0.0)).alias("idle"))
        back = (1 - settings.damping) + settings.damping * F.col("idle")
        rank = F.col("start") * back + settings.damping * F.coalesce("moved", F.lit(0.0))
        new = state.join(moved, ["kind", "node"], "left").join(F.broadcast(idle), "kind")
        state = stored(new.select("kind", "node", "start", "leaves", F.col("rank").alias("last"), rank.alias("rank")), "ranks")
        change = state.agg(F.max(F.abs(F.col("rank") - F.col("last")))).first()[0]
        state = state.drop("last")
        if change is None or change <= settings.change:
            break
    kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0))
    return state.groupBy(F.col("node").alias("host")).agg(kind("allow").alias("trust"), kind("block").alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url: str = "url", html: str = "html", settings: WalkSettings = WalkSettings()) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust`` of every row.

    A rule's verdict holds where one fits; else the host is blocked if distrust exceeds its trust
    by ``ratio``, and allowed if not (so is a row without a host, and a host that no seed
    reaches). Repeated rows stay and weigh as often in the seeds and links; an empty table gives
    an empty table. Scores of hosts are broadcast if their files are small, else joined by hash.
    """
    address = F.col(f"`{url}`")
    narrow = pages.select(F.col(f"`{id_column}`").alias("id"), host_column(address).alias("host"), path_column(address).alias("path"), F.col(f"`{html}`").alias("html"))
    judged = narrow.withColumn("match", rule_column(F.col("host"), F.col("path"), rules)).select("id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("verdict"))
    scores = stored(host_scores(stored(judged, "judged"), host_edges(narrow), settings), "scores")
    joined = judged.join(small_or_not(scores), "host", "left")
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > settings.ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return joined.select("id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), "trust", "distrust")

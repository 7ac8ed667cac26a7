"""SQL for the operators that SQL can state, written apart from their Spark code."""

from __future__ import annotations

from collections.abc import Sequence

from cohortlens.llm.urls import Rule, WalkSettings

#: Rules of the registered URL query (fixed values).
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

COSINE_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id,
  v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def url_filter_sql(rules: Sequence[Rule], settings: WalkSettings = WalkSettings()) -> str:
    """One query with a common table for each round of both walks."""
    ordered = sorted(rules, key=lambda r: -len(r.text))

    def choose(value: str) -> str:
        cases = " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in ordered
        )
        return f"CASE {cases} END"

    link = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'']?([a-z][a-z0-9+.-]*:)?//([^\s\"''/?#>]+)"
    d = settings.damping
    parts = [
        "p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
        "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT page_id, host, path, {choose('text')} AS rule, {choose('verdict')} AS verdict FROM p)",
        f"t AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 2), lambda x: "
        "lower(regexp_replace(regexp_replace(x, '^.*@', ''), ':[0-9]*$', ''))))) AS dst FROM p WHERE host <> '')",
        "e AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM t WHERE dst <> '' AND dst <> src GROUP BY ALL)",
        "s AS (SELECT 'allow' AS kind, src AS node, dst AS nxt, w FROM e UNION ALL SELECT 'block', dst, src, w FROM e)",
        "o AS MATERIALIZED (SELECT kind, node, sum(w) AS w FROM s GROUP BY ALL)",
        "m AS MATERIALIZED (SELECT s.kind, s.node, s.nxt, s.w / o.w AS share FROM s JOIN o USING (kind, node))",
        "h AS (SELECT host AS node FROM j WHERE host <> '' UNION SELECT src FROM e UNION SELECT dst FROM e)",
        "c AS (SELECT verdict AS kind, host AS node, count(*) AS n FROM j WHERE host <> '' AND verdict IS NOT NULL GROUP BY ALL)",
        "b AS MATERIALIZED (SELECT k.kind, h.node, coalesce(c.n / sum(c.n) OVER (PARTITION BY k.kind), 0) AS start, o.node IS NULL AS idle "
        "FROM h CROSS JOIN (VALUES ('allow'), ('block')) k(kind) LEFT JOIN c USING (kind, node) LEFT JOIN o USING (kind, node))",
        "r0 AS (SELECT kind, node, start AS rank FROM b)",
    ]
    for i in range(settings.rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT b.kind, b.node, b.start * ({1 - d} + {d} * i.idle) + {d} * coalesce(g.moved, 0) AS rank FROM b "
            f"JOIN (SELECT b.kind, sum(CASE WHEN b.idle THEN r.rank ELSE 0 END) AS idle FROM b JOIN r{i} r USING (kind, node) GROUP BY b.kind) i ON i.kind = b.kind "
            f"LEFT JOIN (SELECT m.kind, m.nxt AS node, sum(r.rank * m.share) AS moved FROM m JOIN r{i} r USING (kind, node) GROUP BY ALL) g "
            "ON g.kind = b.kind AND g.node = b.node)"
        )
    last = f"r{settings.rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT page_id, j.host, path, rule, coalesce(verdict,
  CASE WHEN coalesce(x.rank, 0) > {settings.ratio} * coalesce(a.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN {last} a ON a.kind = 'allow' AND a.node = j.host LEFT JOIN {last} x ON x.kind = 'block' AND x.node = j.host
"""
    )

#: The byte table of CRC-32 from its rule, and the checksum as a fold over the bytes of a text.
_CRC_TABLE = """steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text; ``t`` of the table above must be in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    )


#: Rows one after another in ring order; each takes the first shard clockwise that has room.
RING_SHARDS_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, tokens AS MATERIALIZED (
  SELECT s, CAST('0x' || substr(md5('shard/' || s || '/' || j), 1, 12) AS BIGINT) AS token FROM range(40) a(s), range(64) b(j)
), ring AS MATERIALIZED (SELECT list(s ORDER BY token, s) AS owners FROM tokens),
d AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS position FROM documents, crc
), a AS (SELECT *, (SELECT count(*) FROM tokens WHERE token < position) % 2560 AS arc FROM d),
o AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY arc, position, CAST(doc_id AS VARCHAR) NULLS FIRST, size, text_crc32) AS k FROM a
), room AS MATERIALIZED (
  SELECT list(n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END ORDER BY s) AS room FROM (SELECT count(*) AS n FROM documents), range(40) r(s)
), walk(k, free, shard, slot) AS (
  SELECT CAST(0 AS BIGINT), room, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM room
  UNION ALL
  SELECT k, list_transform(free, lambda f, i: CASE WHEN i = s + 1 THEN f - 1 ELSE f END), s, room[s + 1] - free[s + 1] FROM (
    SELECT o.k, w.free, list_filter(list_concat(owners[o.arc + 1:], owners[:o.arc]), lambda x: w.free[x + 1] > 0)[1] AS s
    FROM walk w JOIN o ON o.k = w.k + 1, ring
  ), room
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN walk USING (k)
"""

#: Every prefix of every rebuilt conversation, grouped; subtrees by comparing prefixes.
PREFIX_TRIE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), keyed AS MATERIALIZED (
  SELECT c, md5(length(role) || ':' || role || text) AS id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS i FROM turns
), ids AS MATERIALIZED (
  SELECT c, c - c % 20 AS leader, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM keyed), crc
), rebuilt AS (
  SELECT x.c, 0 AS part, k.i, k.id, k.words FROM ids x JOIN keyed k ON k.c = x.leader AND k.i < x.h
  UNION ALL SELECT x.c, 1, k.i, k.id, k.words FROM ids x JOIN keyed k ON k.c = x.c AND k.i >= x.h
), placed AS (SELECT c, id, words, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth FROM rebuilt),
members AS MATERIALIZED (
  SELECT c, depth, words, string_agg(id, '') OVER (PARTITION BY c ORDER BY depth) AS prefix FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM ids
), ends AS (SELECT prefix, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS listed
  FROM (SELECT c, arg_max(prefix, depth) AS prefix FROM members GROUP BY c) GROUP BY prefix),
nodes AS MATERIALIZED (
  SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
    CASE WHEN depth > 0 THEN left(prefix, 32 * (depth - 1)) END AS parent FROM members GROUP BY prefix, depth
), counted AS MATERIALIZED (
  SELECT n.*, (SELECT count(*) FROM nodes m WHERE m.parent = n.prefix) AS n_children FROM nodes n
), below AS (
  SELECT n.prefix, count(*) FILTER (s.n_children = 0) AS n_leaves, sum(s.saved) AS saved_tokens
  FROM counted n JOIN counted s ON starts_with(s.prefix, n.prefix) GROUP BY n.prefix
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.listed, '')) AS ends_sha256
FROM counted n JOIN below b ON b.prefix = n.prefix LEFT JOIN nodes p ON p.prefix = n.parent LEFT JOIN ends e ON e.prefix = n.prefix
"""

"""Prefix trie of conversations: what prompts share, and what sharing would save.

Conversations are ordered as sequences of 16-byte turn ids and cut into range shards. In a shard
the ids form a padded matrix; numpy sorts its rows, and the OR of the changes in the first d
columns marks where the nodes of depth d start, so segment sums over those starts give every figure of every
depth. Nodes that hold a shard's first or last row may go on in the next shard: those partial
nodes are summed by the checksum of their prefix, and sums over subtrees travel up the chain of
such nodes by doubling their reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import hold_memory, small_or_not, stored

#: Bytes of the id of a turn.
TURN_BYTES = 16
#: Turns that one padded matrix holds; longer conversations go on in a matrix of their own.
MATRIX_TURNS = 16
#: Bytes of ids handed on at once for a node whose members end in several shards.
END_BYTES = 1 << 16
#: Rows handed on at once.
_ROWS_AT_ONCE = 20_000
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conv`` and ``turns``: per conversation its turns in order, as (id, words).

    The id is the MD5 of role and text, so texts stay out of the shuffle. Turns are ordered by
    number, null first; equal numbers by id. Rows without a conversation id belong to none.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    known = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.struct(
            F.col(f"`{turn}`").cast("long").alias("turn"),
            F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("t"),
    ).where("conv is not null")
    listed = known.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv", F.expr("transform(t, x -> struct(x.id as id, x.words as words))").alias("turns"))


def rebuilt_sequences(sequences: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % block.

    h is the CRC-32 of c in decimal, modulo ``heads``; then come c's own turns after its first h.
    Nothing is taken from a leader that is absent or too short.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    own = sequences.select("conv", "turns", h.alias("h"), (F.col("conv") - F.col("conv") % block).alias("leader"))
    leaders = sequences.where(F.col("conv") % block == 0)
    leaders = leaders.select(F.col("conv").alias("leader"), F.slice("turns", 1, heads).alias("first"))
    joined = own.join(leaders, "leader", "left")
    first = F.coalesce(F.expr("slice(first, 1, h)"), F.expr("slice(turns, 1, 0)"))
    rest = F.expr("slice(turns, h + 1, greatest(size(turns), 1))")
    return joined.select("conv", F.concat(first, rest).alias("turns"))


@dataclass
class _Level:
    """Nodes of one depth in a shard, in order."""

    start: np.ndarray
    stop: np.ndarray
    convs: np.ndarray
    members: np.ndarray
    words: np.ndarray
    parent: np.ndarray
    partial: np.ndarray


def _sorted_matrix(ids: list[bytes], convs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Order of the rows, their lengths, and per depth d >= 1 (rows that reach it, where its nodes start).

    Rows are sorted by turn ids, shorter first, then by conversation. Matrices are
    ``MATRIX_TURNS`` wide; rows that go on are sorted again inside their node, next to each other
    as they already are.
    """
    n = len(ids)
    lengths = np.array([len(x) // TURN_BYTES for x in ids], dtype=np.int64)
    order = np.arange(n)
    node = np.zeros(n, dtype=np.int64)
    depths: list[tuple[np.ndarray, np.ndarray]] = []
    at, base = np.arange(n), 0
    while len(at):
        rows = order[at]
        width = int(min(MATRIX_TURNS, lengths[rows].max() - base))
        if width <= 0:
            if base == 0:
                order = order[np.argsort(convs, kind="stable")]
            break
        padded = b"".join(
            ids[r][base * TURN_BYTES : (base + width) * TURN_BYTES].ljust(width * TURN_BYTES, b"\0") for r in rows.tolist()
        )
        matrix = np.frombuffer(padded, dtype=">u8").reshape(len(rows), 2 * width).astype(np.uint64)
        left = np.minimum(lengths[rows] - base, width)
        sort = np.lexsort((convs[rows], left, *matrix.T[::-1], node[at]))
        order[at] = rows[sort]
        matrix, left, label = matrix[sort], left[sort], node[at]
        change = np.ones(len(rows), bool)
        change[1:] = label[1:] != label[:-1]
        for k in range(width):
            step = (matrix[1:, 2 * k] != matrix[:-1, 2 * k]) | (matrix[1:, 2 * k + 1] != matrix[:-1, 2 * k + 1])
            change[1:] |= step
            change[1:] |= (left[1:] > k) != (left[:-1] > k)
            reach = left > k
            # The first row of a node may not be the first that changed: rows that ended lie before.
            depths.append((at[reach], np.flatnonzero(change[reach])))
        longer = left == width
        node[at] = np.cumsum(change)
        at = at[longer & (lengths[order[at]] > base + width)]
        base += width
    return order, lengths[order], depths


def shard_levels(ids: list[bytes], words: list, convs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[_Level]]:
    """Order and lengths of a shard's rows, and its nodes level by level; level 0 is the root."""
    order, lengths, depths = _sorted_matrix(ids, convs)
    n, convs = len(ids), convs[order]
    label = np.zeros(n, dtype=np.int64)
    whole = np.array([0])
    levels = [_Level(whole, whole + n, convs.min(keepdims=True), whole + n, whole * 0, whole * 0 - 1, np.array([True]))]
    for depth, (rows, starts) in enumerate(depths, 1):
        first = rows[starts]
        stop = rows[np.append(starts[1:], len(rows)) - 1] + 1
        counts = np.diff(np.append(starts, len(rows)))
        parent = label[first]
        label[rows] = np.repeat(np.arange(len(starts)), counts)
        last = np.array([words[r][depth - 1] for r in order[first].tolist()], dtype=np.int64)
        levels.append(
            _Level(first, stop, np.minimum.reduceat(convs[rows], starts), counts, last, parent, (first == 0) | (stop == n))
        )
    return order, lengths, levels


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _path_keys(sequence: bytes, depth: int) -> list[bytes]:
    """Checksums of the first 0, 1, ... ``depth`` turns."""
    running = hashlib.md5()
    keys = [running.digest()]
    for d in range(depth):
        running.update(sequence[d * TURN_BYTES : (d + 1) * TURN_BYTES])
        keys.append(running.digest())
    return keys


_NODE = (
    "kind string, shard int, part int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, ends binary"
)
_COLUMNS = [x.split()[0] for x in _NODE.split(", ")]


def shard_rows(shard: int, ids: list[bytes], words: list, convs: np.ndarray) -> Iterator[dict]:
    """Rows of a shard: its whole nodes, its partial nodes, and the ids that end at the latter.

    Figures of a partial node leave out the subtrees of partial children.
    """
    order, lengths, levels = shard_levels(ids, words, convs)
    convs = convs[order]
    paths: dict[tuple[int, int], bytes] = {}
    parents: dict[tuple[int, int], bytes | None] = {}
    for row in (0, len(ids) - 1):
        keys = _path_keys(ids[order[row]], int(lengths[row]))
        label = None
        for depth, key in enumerate(keys):
            level = levels[depth]
            label = 0 if row == 0 else len(level.start) - 1
            paths[depth, label] = key
            parents[depth, label] = keys[depth - 1] if depth else None
    leaves = [np.zeros(len(x.start), dtype=np.int64) for x in levels]
    saved = [np.zeros(len(x.start), dtype=np.int64) for x in levels]
    children = [np.zeros(len(x.start), dtype=np.int64) for x in levels]
    for depth in range(len(levels) - 1, -1, -1):
        level, whole = levels[depth], ~levels[depth].partial
        leaves[depth] += whole & (children[depth] == 0)
        saved[depth] += np.where(whole, (level.members - 1) * level.words, 0)
        if depth:
            up = level.parent[whole]
            np.add.at(children[depth - 1], up, 1)
            np.add.at(leaves[depth - 1], up, leaves[depth][whole])
            np.add.at(saved[depth - 1], up, saved[depth][whole])
    for depth, level in enumerate(levels):
        for i in range(len(level.start)):
            start, stop = int(level.start[i]), int(level.stop[i])
            # Members without a further turn come first in their node.
            span = lengths[start:stop]
            over = int(np.count_nonzero(span == depth))
            partial = bool(level.partial[i])
            above = (depth - 1, int(level.parent[i]))
            row = {
                "kind": "partial" if partial else "node", "shard": shard, "part": 0, "depth": depth,
                "key": paths.get((depth, i)), "parent_key": parents.get((depth, i)) if partial else paths.get(above),
                "conv_id": int(level.convs[i]), "n_convs": int(level.members[i]), "n_children": int(children[depth][i]),
                "n_leaves": int(leaves[depth][i]), "saved_tokens": int(saved[depth][i]), "words": int(level.words[i]),
                "parent_conv_id": int(levels[depth - 1].convs[above[1]]) if depth else None,
            }
            if not partial:
                yield row | {"ends_sha256": _digest(convs[start : start + over]) if over else _NOTHING}
                continue
            yield row
            step = END_BYTES // 20
            for part, k in enumerate(range(start, start + over, step)):
                text = ",".join(map(str, convs[k : min(k + step, start + over)].tolist()))
                yield {"kind": "ends", "shard": shard, "part": part, "key": row["key"], "ends": text.encode()}


def _shard_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hold_memory("trie")
    ids: list[bytes] = []
    words: list[np.ndarray] = []
    convs: list[np.ndarray] = []
    for batch in batches:
        ids += [bytes(x) for x in batch["ids"]]
        words += list(batch["words"])
        convs.append(batch["conv"].to_numpy(dtype=np.int64))
    if not ids:
        return
    held = []
    for row in shard_rows(TaskContext.get().partitionId(), ids, words, np.concatenate(convs)):
        held.append(row)
        if len(held) == _ROWS_AT_ONCE:
            yield _frame(held)
            held = []
    yield _frame(held)


def _frame(rows: list[dict]) -> pd.DataFrame:
    kinds = dict(x.split() for x in _NODE.split(", "))
    return pd.DataFrame(
        {
            c: pd.array([r.get(c) for r in rows], dtype="Int64" if kinds[c] == "long" else "Int32")
            if kinds[c] in ("long", "int")
            else pd.Series([r.get(c) for r in rows], dtype=object)
            for c in _COLUMNS
        }
    )


def _streamed_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per key over its parts, which come in order; memory does not grow with a key."""
    key, running = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for k, part in zip(batch["key"], batch["ends"]):
            k = bytes(k)
            if k != key:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
                running.update(bytes(part))
            else:
                running.update(b"," + bytes(part))
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        done = []
    if running is not None:
        yield pd.DataFrame([(key, running.hexdigest())], columns=["key", "ends_sha256"])


def _recombined(rows: DataFrame) -> DataFrame:
    """Partial nodes of all shards as whole ones, with the sums of their subtrees."""
    partial = rows.where("kind = 'partial'")
    total = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = partial.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("depth").alias("depth"),
        F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in total],
    )
    merged = stored(merged, "trie-merged")
    below = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    nodes = merged.join(below, "key", "left").select(
        "key", "parent_key", "depth", "conv_id", "n_convs", children.alias("n_children"),
        (F.col("n_leaves") + (children == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        F.col("parent_key").alias("up"),
    )
    # A node's sums cover what lies fewer than ``reach`` levels below; ``up`` is ``reach`` levels above.
    nodes, reach = stored(nodes, "trie-reach"), 1
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        sent = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")
        )
        higher = nodes.select(F.col("key").alias("up"), F.col("up").alias("higher"))
        joined = nodes.join(sent, "key", "left").join(higher, "up", "left")
        nodes = stored(
            joined.select(
                "key", "parent_key", "depth", "conv_id", "n_convs", "n_children",
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
                F.col("higher").alias("up"),
            ),
            "trie-reach",
        )
        reach *= 2
    ends = rows.where("kind = 'ends'").select("key", "shard", "part", "ends")
    ends = ends.repartition("key").sortWithinPartitions("key", "shard", "part")
    digests = ends.mapInPandas(_streamed_digests, "key binary, ends_sha256 string")
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.drop("up").join(digests, "key", "left").join(above, "parent_key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
    )


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences, the empty one included.

    ``sequences`` has ``conv`` (long, each once) and ``turns`` (array of (id, words), ids of 16
    bytes), as :func:`turn_sequences` gives. Columns: ``conv_id`` smallest member, ``depth``,
    ``parent_conv_id`` (root: null), ``n_convs`` members, ``n_children``, ``n_leaves`` childless
    nodes of the subtree, ``saved_tokens`` sum over the subtree of (members - 1) times the words
    of a node's last turn, ``ends_sha256`` of the ids of the members that end here, ascending and
    joined by commas.

    Sequences move once, as ids, in even range blocks with the conversation as last key, so a
    sequence that a third of all conversations share is cut over many shards. Per shard at most
    two partial nodes a depth go on to the recombination, which sums them over the cluster; ids
    that end at such a node are hashed as a stream. A conversation is one row: memory of a task
    grows with its own turns, matrices are 16 turns wide however long the longest is.

    A null list of turns counts as empty. No sequences give an empty table. Ties cannot occur:
    nodes are told apart by their ids, members by their number. Extra columns are not looked at.
    """
    turns = F.coalesce("turns", F.expr("slice(turns, 1, 0)"))
    flat = sequences.select(
        F.col("conv").cast("long").alias("conv"),
        F.coalesce(F.expr("unhex(array_join(transform(turns, x -> hex(x.id)), ''))"), F.lit(b"")).alias("ids"),
        F.coalesce(F.transform(turns, lambda x: x["words"].cast("int")), F.array().cast("array<int>")).alias("words"),
    )
    shards = flat.repartitionByRange("ids", "conv")
    rows = stored(shards.mapInPandas(_shard_frames, _NODE), "trie-shards")
    merged = stored(_recombined(rows), "trie-merged")

    wanted = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    # Each shard has its own copy of the partial nodes it touches, so no parent gathers all its children.
    local = rows.where("kind = 'partial'").select("shard", "key")
    local = local.join(merged.select("key", F.col("conv_id").alias("whole_parent")), "key")
    local = small_or_not(stored(local.select("shard", F.col("key").alias("parent_key"), "whole_parent"), "trie-parents"))
    nodes = rows.where("kind = 'node'").join(local, ["shard", "parent_key"], "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("whole_parent", "parent_conv_id"))
    return nodes.select(*wanted).union(merged.select(*wanted))


def conversation_trie(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The trie of rebuilt conversations (:func:`rebuilt_sequences`) of a table of turns.

    Null roles and texts count as empty, null turn numbers come first, repeated rows are turns of their
    own, rows without a conversation id are left out; an empty table gives an empty table.
    Other columns may have any names.
    """
    return prefix_trie(rebuilt_sequences(turn_sequences(conversations, conv)))

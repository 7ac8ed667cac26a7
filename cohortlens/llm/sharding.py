"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns a number of tokens on a ring of 48-bit positions. A key belongs to the first
token at or after its own position; if that token's shard is full, the key goes on clockwise to
the next shard with room. Keys arrive in ring order, so all keys between two tokens (an arc) see
the same shards in the same order, and only their number matters for who gets how many. The
walk therefore runs over one count per arc, which does not grow with the data; rows look up the
piece of their arc that they fall in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import small_or_not, stored

#: Hexadecimal digits of an MD5 that make a position.
_DIGITS = 12
#: Bits of a position that name its cell in the token index.
_CELL_BITS = 12
_ROW_IN_PARTITION = (1 << 33) - 1


def ring_position(text: Column) -> Column:
    """Position of a text on the ring, 0 to 2^48 - 1."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("long")


def ring_tokens(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """``arc`` (0 up, clockwise), ``token`` and ``shard`` of every virtual node.

    The name of a token holds only its shard and number, so other shards do not move it. One
    window over all tokens: shards times virtual nodes, whatever the data.
    """
    nodes = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node")
    )
    placed = nodes.select("shard", ring_position(F.concat_ws("/", F.lit("shard"), "shard", "node")).alias("token"))
    order = Window.orderBy("token", "shard")
    return placed.select((F.row_number().over(order) - 1).alias("arc"), "token", "shard")


def _token_cells(tokens: DataFrame, arcs: int) -> DataFrame:
    """Per cell of the ring: tokens before it, and the tokens inside in order."""
    shift = 4 * _DIGITS - _CELL_BITS
    cells = tokens.sparkSession.range(1 << _CELL_BITS).select(F.col("id").alias("cell"))
    inside = tokens.groupBy(F.shiftright("token", shift).alias("cell")).agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    joined = cells.join(inside, "cell", "left")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce("tokens", F.array().cast("array<bigint>"))
    return joined.select(
        "cell", held.alias("tokens"), F.coalesce(F.sum(F.size(held)).over(before), F.lit(0)).alias("before")
    )


def _walk(arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """Pieces of arcs: ``arc``, ``first`` and ``rows`` in the arc, ``shard``, ``slot`` of the first row.

    ``arcs`` has one row per token (``arc``, ``shard``, ``n``). One fold over that bounded list:
    each arc fills the shards clockwise from its own as far as they have room.
    """
    rooms = "total div {s} + if(i < total % {s}, 1, 0)" if slack == 0 else "cast(ceil(total * {f} / {s}) as bigint)"
    rooms = rooms.format(s=shards, f=1 + slack)
    listed = arcs.agg(F.sort_array(F.collect_list(F.struct("arc", "n", "shard"))).alias("arcs"), F.sum("n").alias("total"))
    listed = listed.select(
        "arcs",
        F.expr("transform(arcs, x -> x.shard)").alias("owners"),
        F.expr(f"transform(sequence(0, {shards - 1}), i -> {rooms})").alias("room"),
    )
    listed = stored(listed, "ring")
    piece = "struct<arc:int,first:bigint,rows:bigint,shard:int,slot:bigint>"
    state = f"struct<free:array<bigint>,pieces:array<{piece}>>"
    inner = f"struct<free:array<bigint>,pieces:array<{piece}>,need:bigint>"
    take = "least(st.need, st.free[s])"
    fold = f"""
    aggregate(
      filter(arcs, x -> x.n > 0),
      cast(struct(room, array()) as {state}),
      (acc, x) -> aggregate(
        array_distinct(concat(slice(owners, x.arc + 1, size(owners)), slice(owners, 1, x.arc))),
        cast(struct(acc.free, acc.pieces, x.n) as {inner}),
        (st, s) -> if(st.need = 0 or st.free[s] = 0, st, cast(struct(
          transform(st.free, (f, i) -> if(i = s, f - {take}, f)),
          concat(st.pieces, cast(array(struct(x.arc, x.n - st.need, {take}, s, room[s] - st.free[s])) as array<{piece}>)),
          st.need - {take}) as {inner})),
        st -> cast(struct(st.free, st.pieces) as {state})),
      acc -> acc.pieces)
    """
    return listed.select(F.explode(F.expr(fold)).alias("p")).select("p.*")


def ring_shards(
    rows: DataFrame,
    key: str,
    *,
    shards: int = 40,
    virtual_nodes: int = 64,
    slack: float = 0.0,
    ties: Sequence[str] = (),
    name: str = "placed",
) -> DataFrame:
    """Add a struct column ``name`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    A shard takes at most ``(1 + slack) * rows / shards`` rows, rounded up; without slack the
    first ``rows % shards`` shards take one more than the others, so counts are at most one
    apart. More slack or more virtual nodes let fewer keys overflow, so fewer move when the
    number of shards changes.

    Rows move once, with the columns they have: project before. They are cut into even range
    blocks in ring order, numbered inside their block, and joined to the pieces of arcs, of which
    there are at most (virtual nodes + 1) * shards + blocks. A key that holds a third of all
    rows is spread over blocks like any other and overflows to the next shards.

    Nulls: a null key stands where the empty text stands. Ties: rows at one position are ordered
    by key, then by the columns ``ties`` (nulls first), then by their place in the input, so equal rows
    are interchangeable. Repeated rows each get their own slot. Texts may be of any length; only
    their MD5 counts. An empty table gives an empty table. Other columns may have any name; one
    called ``name`` is replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop(name)
    tokens = stored(ring_tokens(spark, shards, virtual_nodes), "tokens")
    count = shards * virtual_nodes
    text = F.col(f"row.`{key}`").cast("string")
    shift = 4 * _DIGITS - _CELL_BITS
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")) if rows.columns else rows
    placed = held.select("row", ring_position(F.coalesce(text, F.lit(""))).alias("position"))
    placed = placed.withColumn("cell", F.shiftright("position", shift)).join(F.broadcast(_token_cells(tokens, count)), "cell")
    arc = F.col("before") + F.size(F.expr("filter(tokens, t -> t < position)"))
    placed = placed.select("row", "position", (arc % count).cast("int").alias("arc"))
    order = ["arc", "position", text, *[F.col(f"row.`{t}`") for t in ties], F.monotonically_increasing_id()]
    blocks = placed.repartitionByRange(*order).sortWithinPartitions("arc", "position", text, *[F.col(f"row.`{t}`") for t in ties])
    blocks = blocks.select(
        "row", "arc", F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION)).alias("at"),
    )
    blocks = stored(blocks, "ring-rows")

    parts = stored(blocks.groupBy("arc", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")), "ring-parts")
    totals = parts.groupBy("arc").agg(F.sum("n").alias("n"))
    arcs = tokens.join(totals, "arc", "left").select(F.col("arc").cast("int").alias("arc"), "shard", F.coalesce("n", F.lit(0)).alias("n"))
    earlier = Window.partitionBy("arc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    pieces = _walk(arcs, shards, slack)
    cut = parts.join(F.broadcast(pieces), "arc").where("first < start + n and start < first + rows")
    cut = cut.select(
        "arc", "block", "shard",
        (F.col("at") + F.greatest(F.col("first") - F.col("start"), F.lit(0))).alias("from"),
        (F.col("at") + F.least(F.col("first") + F.col("rows") - F.col("start"), F.col("n"))).alias("to"),
        (F.col("slot") + F.col("start") - F.col("first") - F.col("at")).alias("shift"),
    )
    cut = small_or_not(stored(cut, "ring-pieces"))
    inside = (blocks["arc"] == cut["arc"]) & (blocks["block"] == cut["block"]) & blocks["at"].between(cut["from"], cut["to"] - 1)
    found = blocks.join(cut, inside)
    return found.select("row.*", F.struct("shard", (F.col("at") + F.col("shift")).alias("slot")).alias(name))

"""Near-duplicate vectors by product quantisation over coarse inverted lists, reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import small_or_not, stored
from cohortlens.llm.links import components


@dataclass(frozen=True)
class IndexSettings:
    """``sample`` bounds the distinct vectors that the quantisers are fitted on.

    ``lists`` is the number of coarse lists for a million vectors; it grows with the square root
    of their number, within ``least_lists`` and ``most_lists``. ``codewords`` (at most 256) are
    learnt for each of ``subspaces``. ``block`` is the most vectors of a list in one task.
    """

    sample: int = 20_000
    lists: int = 1024
    least_lists: int = 16
    most_lists: int = 4096
    subspaces: int = 8
    codewords: int = 64
    rounds: int = 8
    block: int = 2048


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _k_means(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced distinct points; empty clusters keep their centre."""
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_squared(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
        for j, count in enumerate(np.bincount(nearest, minlength=len(centres))):
            if count:
                centres[j] = points[nearest == j].mean(0)
    return centres


@dataclass
class ProductIndex:
    """Coarse centres, and codewords of each subspace for what is left after the centre."""

    centres: np.ndarray
    codebooks: list[np.ndarray]
    bounds: np.ndarray

    @classmethod
    def fit(cls, units: np.ndarray, lists: int, settings: IndexSettings) -> ProductIndex:
        centres = _k_means(units, lists, settings.rounds)
        rest = units - centres[_squared(units, centres).argmin(1)]
        bounds = np.linspace(0, units.shape[1], min(settings.subspaces, units.shape[1]) + 1).astype(int)
        books = [_k_means(rest[:, a:b], settings.codewords, settings.rounds) for a, b in zip(bounds, bounds[1:])]
        return cls(centres, books, bounds)

    def codes(self, units: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = units - self.centres[lists]
        return np.stack([_squared(rest[:, a:b], book).argmin(1).astype(np.uint8) for a, b, book in zip(self.bounds, self.bounds[1:], self.codebooks)], axis=1)

    def rebuilt(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], axis=1)

    def probes(self, units: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within ``radius``: one row per vector.

        A vector of list c lies on c's side of the plane between c and any other centre. So if the
        plane between the query's own centre and c is farther than the radius, list c is out.
        """
        far = _squared(units, self.centres)
        own = far.argmin(1)
        between = np.sqrt(_squared(self.centres, self.centres))[own]
        plane = (far - far[np.arange(len(units)), own][:, None]) / np.maximum(2 * between, 1e-12)
        return plane <= radius + 1e-9

    def tables(self, queries: np.ndarray, own_list: int) -> list[np.ndarray]:
        """Squared distances from each query's rest to every codeword, per subspace."""
        rest = queries - self.centres[own_list]
        return [_squared(rest[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.codebooks)]


class _Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row's components as bytes, in single precision where that is exact, else in double."""
    with np.errstate(over="ignore", under="ignore"):
        single = rows.astype("<f4")
    exact = (single.astype(np.float64) == rows).all(axis=1)
    return [(s if e else d).tobytes() for s, d, e in zip(single, rows.astype("<f8"), exact.tolist())]


def _unpacked(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows packed by :func:`_packed`, in double precision."""
    return np.array([np.frombuffer(v, "<f4" if len(v) == 4 * width else "<f8") for v in vectors], np.float64)


def _units(vectors: pd.Series | np.ndarray) -> np.ndarray:
    rows = vectors if isinstance(vectors, np.ndarray) else np.array([np.asarray(v, np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _search(index: ProductIndex, queries: pd.DataFrame, members: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the queries that probe a block of one list and the members of the block.

    Distances from code tables, less what a member's code is off by, never exceed the true ones;
    members within the radius by that bound are compared exactly. Queries of the list itself come
    in both roles; of two other lists only the lower one asks, so there a link counts for both
    its ends. Returns the number of links found for each end, and links enough to connect what is
    connected.
    """
    width = int(index.bounds[-1])
    q, x = _units(_unpacked(queries["asked_vector"], width)), _units(_unpacked(members["vector"], width))
    own = int(members["list"].iloc[0])
    codes = np.stack([np.frombuffer(c, np.uint8) for c in members["code"]])
    off = members["off"].to_numpy()
    radius = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    weight, q_weight = members["times"].to_numpy(), queries["asked_times"].to_numpy()
    elsewhere = queries["asked_own"].to_numpy() != own
    for_members = np.zeros(len(x), np.int64)
    q_id, x_id = queries["asked_node"].to_numpy(), members["node"].to_numpy()
    place = {n: i for i, n in enumerate(dict.fromkeys([*x_id.tolist(), *q_id.tolist()]))}
    forest, rows = _Forest(len(place)), []
    for s in range(0, len(q), 256):
        tables = index.tables(q[s : s + 256], own)
        estimate = sum(table[:, codes[:, m]] for m, table in enumerate(tables))
        near = estimate <= (off + radius)[None, :] ** 2
        near &= q_id[s : s + 256, None] != x_id[None, :]
        i, j = np.nonzero(near)
        linked = np.einsum("ij,ij->i", q[s + i], x[j]) >= least
        i, j = i[linked], j[linked]
        links = np.bincount(i, weights=weight[j], minlength=1).astype(np.int64)
        rows += [(q_id[s + k], None, int(links[k])) for k in np.flatnonzero(links)]
        other = elsewhere[s + i]
        for_members += np.bincount(j[other], weights=q_weight[s + i[other]], minlength=len(x)).astype(np.int64)
        for a, b in zip(q_id[s + i].tolist(), x_id[j].tolist()):
            if forest.join(place[a], place[b]):
                rows.append((a, b, 0))
    rows += [(x_id[k], None, int(for_members[k])) for k in np.flatnonzero(for_members)]
    return pd.DataFrame(rows, columns=["a", "b", "links"]).astype({"a": "int64", "b": "Int64", "links": "int64"})


def _usable(vector: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def cosine_links(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` for each row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors have one length, and their
    cosine in double precision is at least ``least`` (over 0). Vectors that are null, empty, zero,
    or hold a null or non-finite component link with nothing. Rows with equal label and vector are
    one node with a number of copies; copies link with each other and are never paired up. Nodes
    are indexed all; each is a query against all lists that its radius reaches, so no link is
    lost. A long list is cut into blocks of members, and the queries that probe it into
    parts by their own number, so no task grows with a list or with those who probe it. Repeated rows and ids count as rows of their own; a
    component's id is its smallest id; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").alias("label"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & _usable("vector"))
    # A null id would vanish among smallest ids only; rows keep their own key for the joins.
    keyed = rows.withColumn("key", F.when(F.col("usable"), F.struct("label", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))))
    nodes = keyed.where("usable").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    width = nodes.select(F.size("key.vector").alias("width")).distinct()
    parts = []
    for w in [r["width"] for r in width.limit(1025).collect()]:
        parts.append(_links_of_width(nodes.where(F.size("key.vector") == w), n, least, settings))
        if len(parts) > 1024:
            raise ValueError("vectors of more than 1024 different lengths")
    empty = spark.createDataFrame([], "a long, b long, links long")
    found = empty
    for part in parts:
        found = found.unionByName(part)
    found = stored(found, "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL"), "a", "b")
    of_node = nodes.join(counts, F.col("node") == F.col("a"), "left").join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
    of_node = of_node.select("key", F.coalesce("root", "node").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    of_node = stored(of_node, "groups")
    smallest = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_node.join(smallest, "root").select("key", "n_links", "component_id")
    single = keyed.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return keyed.where("usable").join(named, "key").select("id", "n_links", "component_id").unionByName(single)


def _links_of_width(nodes: DataFrame, n: int, least: float, settings: IndexSettings) -> DataFrame:
    """Links among nodes whose vectors have one length: rows (a, null, links) and (a, b, 0)."""
    spark = nodes.sparkSession
    sample = nodes.select("key.vector").orderBy(F.xxhash64("key.vector")).limit(settings.sample).toPandas()["vector"]
    lists = int(np.clip(settings.lists * np.sqrt(n / 1e6), settings.least_lists, settings.most_lists))
    shared = spark.sparkContext.broadcast(ProductIndex.fit(_units(sample), lists, settings))
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            for s in range(0, len(batch), 2048):
                part = batch.iloc[s : s + 2048]
                vectors = np.array([np.asarray(v, np.float64) for v in part["vector"]])
                units = _units(vectors)
                own = _squared(units, index.centres).argmin(1)
                codes = index.codes(units, own)
                off = np.sqrt(((units - index.rebuilt(codes, own)) ** 2).sum(1))
                probes = [np.flatnonzero(p[k:]).tolist() for p, k in zip(index.probes(units, radius), own)]
                probes = [[k + i for i in row] for row, k in zip(probes, own.tolist())]
                yield pd.DataFrame({
                    "node": part["node"].to_numpy(), "label": part["label"].to_numpy(), "vector": _packed(vectors),
                    "times": part["times"].to_numpy(), "list": own, "code": [c.tobytes() for c in codes], "off": off, "probes": probes,
                })

    narrow = nodes.select("node", F.col("key.label").cast("string").alias("label"), "key.vector", "times")
    indexed = stored(narrow.mapInPandas(index_rows, "node long, label string, vector binary, times long, list int, code binary, off double, probes array<int>"), "index")
    cuts = F.ceil(F.count(F.lit(1)) / settings.block).cast("int")
    sizes = indexed.groupBy("label", "list").agg(cuts.alias("blocks"))
    askers = indexed.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(cuts.alias("parts"))
    # Every node asks in its own list, so a list with members has parts.
    sizes = small_or_not(stored(sizes.join(askers, ["label", "list"]), "sizes"))
    spread = lambda pieces: F.pmod(F.xxhash64("node"), F.col(pieces)).cast("int")
    members = indexed.join(sizes, ["label", "list"]).withColumn("block", spread("blocks"))
    asked = indexed.select("node", "label", "vector", "times", F.col("list").alias("own"), F.explode("probes").alias("list"))
    asked = asked.join(sizes, ["label", "list"]).withColumn("part", spread("parts"))
    # Every block of members meets every part of the queries in a task of its own.
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["label", "list", "block", "part"]

    def search(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or blocks.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "links": pd.Series(dtype="int64")})
        return _search(shared.value, queries, blocks, least)

    named = asked.select(*[F.col(c).alias(f"asked_{c}") for c in (*group, "node", "vector", "times", "own")])
    left = named.groupBy(*[f"asked_{c}" for c in group])
    right = members.select(*group, "node", "vector", "times", "code", "off").groupBy(*group)
    return left.cogroup(right).applyInPandas(search, "a long, b long, links long")

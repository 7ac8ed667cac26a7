"""Neighbour search against brute force, and neighbour summaries with known answers."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import nearest as nearest_module
from cohortlens.operators.nearest import nearest, neighbor_columns
from cohortlens.operators.neighbor_features import (
    neighbor_columns_wide,
    neighbor_features,
    neighbor_features_upto,
)


def brute_force(pdf, k):
    rows = []
    for w, g in pdf.groupby("w"):
        ids, x, y = g["id"].to_numpy(), g["x"].to_numpy(), g["y"].to_numpy()
        for i in range(len(g)):
            dx, dy = x[i] - x, y[i] - y
            d = np.sqrt(dx * dx + dy * dy)
            others = ids != ids[i]
            for rank, j in enumerate(np.lexsort((ids[others], d[others]))[:k]):
                rows.append((w, ids[i], rank + 1, ids[others][j], d[others][j]))
    return pd.DataFrame(rows, columns=["w", "id", "rank", "nid", "dist"])


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.3, rng.normal(5, 1e-4, n), rng.random(n) * 10)
    y = np.where(rng.random(n) < 0.3, rng.normal(5, 1e-6, n), rng.random(n) * 10)
    same_place = rng.random(n) < 0.3  # a third of all points share one place
    x[same_place], y[same_place] = 3.0, 3.0
    return pd.DataFrame({"w": rng.choice([0, 0, 0, 1, 2, 3], n), "id": np.arange(n), "x": x, "y": y})


@pytest.mark.parametrize("n, k, block_rows", [(4, 3, 10**6), (700, 1, 10**6), (700, 10, 10**6), (700, 5, 90)])
def test_equals_brute_force(spark, monkeypatch, n, k, block_rows):
    monkeypatch.setattr(nearest_module, "BLOCK_ROWS", block_rows)
    pdf = clustered(n, n + k)
    got = nearest(spark.createDataFrame(pdf), "id", "x", "y", ["w"], k).toPandas()
    got = got.sort_values(["w", "id", "rank"]).reset_index(drop=True)
    want = brute_force(pdf, k).sort_values(["w", "id", "rank"]).reset_index(drop=True)
    assert len(got) == len(want)
    np.testing.assert_array_equal(
        got[["w", "id", "rank", "nid"]].astype("int64").to_numpy(), want[["w", "id", "rank", "nid"]].to_numpy()
    )
    np.testing.assert_allclose(got["dist"].astype(float), want["dist"].astype(float))


def test_one_line_of_points(spark):
    pdf = pd.DataFrame({"w": 1, "id": np.arange(300), "x": np.arange(300) ** 2.0, "y": 0.0})
    got = nearest(spark.createDataFrame(pdf), "id", "x", "y", ["w"], 4).toPandas().sort_values(["id", "rank"])
    want = brute_force(pdf, 4).sort_values(["id", "rank"])
    np.testing.assert_array_equal(got["nid"].to_numpy(), want["nid"].to_numpy())


def test_a_stray_point_does_not_merge_the_others(spark):
    pdf = clustered(500, 11)
    pdf.loc[0, ["x", "y"]] = [-1e9, 1e9]
    pdf.loc[1, "x"] = np.nan
    pdf.loc[2, "y"] = np.inf
    points = spark.createDataFrame(pdf)
    got = nearest(points, "id", "x", "y", ["w"], 3).toPandas().sort_values(["w", "id", "rank"])
    want = brute_force(pdf.drop([1, 2]), 3).sort_values(["w", "id", "rank"])
    np.testing.assert_array_equal(got["nid"].to_numpy(), want["nid"].to_numpy())


def exact_distance(ax, ay, bx, by):
    near = np.sqrt((ax - bx) ** 2 + (ay - by) ** 2)
    far = 2.0 * np.hypot(ax * 0.5 - bx * 0.5, ay * 0.5 - by * 0.5)
    return np.where((near > 1e-150) & (near < 1e150), near, far)


def expected_ids(pdf, k):
    rows = []
    for w, g in pdf.groupby("w"):
        ids, x, y = g["id"].to_numpy(), g["x"].to_numpy(), g["y"].to_numpy()
        for i in range(len(g)):
            with np.errstate(over="ignore", invalid="ignore"):
                d = exact_distance(x[i], y[i], x, y)
            others = ids != ids[i]
            rows += [(w, ids[i], r + 1, ids[others][j]) for r, j in enumerate(np.lexsort((ids[others], d[others]))[:k])]
    return sorted(rows)


@pytest.mark.parametrize("outliers", [[1e16], [1e200], [1e308, -1e308], [1e16, 1e200, 1e308, -1e308, 1e-300]])
def test_far_outliers_cost_no_rows(spark, monkeypatch, outliers):
    monkeypatch.setattr(nearest_module, "CROWDED_PLACES", 50)
    pdf = clustered(600, 21)
    for i, v in enumerate(outliers):
        pdf.loc[i * 7, "x"] = v
        pdf.loc[i * 7 + 3, ["x", "y"]] = [v, -v]
    got = nearest(spark.createDataFrame(pdf), "id", "x", "y", ["w"], 4).collect()
    assert sorted((r["w"], r["id"], r["rank"], r["nid"]) for r in got) == expected_ids(pdf, 4)


def test_points_far_closer_than_the_grid(spark):
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame({"w": 0, "id": np.arange(n), "x": rng.random(n) * 2.0**-50, "y": rng.random(n) * 2.0**-50})
    pdf.loc[0, ["x", "y"]] = [1.0, 1.0]
    got = nearest(spark.createDataFrame(pdf), "id", "x", "y", ["w"], 3).collect()
    assert sorted((r["w"], r["id"], r["rank"], r["nid"]) for r in got) == expected_ids(pdf, 3)


def test_some_points_search_among_all(spark):
    pdf = clustered(400, 3)
    df = spark.createDataFrame(pdf)
    asked = df.filter("id % 5 = 0").select("w", "id")
    got = nearest(df, "id", "x", "y", ["w"], 6, asked).toPandas().sort_values(["w", "id", "rank"])
    want = brute_force(pdf, 6).query("id % 5 == 0").sort_values(["w", "id", "rank"])
    np.testing.assert_array_equal(got["nid"].to_numpy(), want["nid"].to_numpy())


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(
        [(1, "a", 0.0, 0.0), (1, "b", 0.0, 0.0), (1, "c", 3.0, 4.0), (1, "d", 6.0, 8.0), (2, "e", 0.0, 0.0)],
        "state int, id string, x double, y double",
    )


def test_known_neighbours(known):
    got = {(r["id"], r["rank"]): (r["nid"], r["dist"]) for r in nearest(known, "id", "x", "y", ["state"], 2).collect()}
    assert got == {
        ("a", 1): ("b", 0.0), ("a", 2): ("c", 5.0),
        ("b", 1): ("a", 0.0), ("b", 2): ("c", 5.0),
        ("c", 1): ("a", 5.0), ("c", 2): ("b", 5.0),
        ("d", 1): ("c", 5.0), ("d", 2): ("a", 10.0),
    }


def test_wide_ids(known):
    near = nearest(known, "id", "x", "y", ["state"], 2)
    got = {r["id"]: (r["neighbor0"], r["neighbor1"]) for r in neighbor_columns(near, ["id"], 2).collect()}
    assert got["d"] == ("c", "a")


def test_properties(spark):
    df = spark.createDataFrame(clustered(300, 9))
    got = nearest(df, "id", "x", "y", ["w"], 5).toPandas().sort_values(["w", "id", "rank"])
    for _, g in got.groupby(["w", "id"]):
        assert list(g["rank"]) == list(range(1, len(g) + 1))
        assert (np.diff(g["dist"]) >= 0).all()
        assert (g["nid"] != g["id"]).all()


def summary(spark, values, strict):
    panel = spark.createDataFrame(
        [(f"n{i}", 2010, f, p) for i, (f, p) in enumerate(values)], "id string, year int, f double, pop bigint"
    )
    near = spark.createDataFrame(
        [("q", 2010, i + 1, f"n{i}") for i in range(len(values))], "id string, year int, rank int, nid string"
    )
    out = neighbor_features(near, panel, id="id", weight="pop", mean_cols=["f"], sum_cols=["pop"], strict=strict)
    return out.first()


def test_weighted_means(spark):
    assert summary(spark, [(0.2, 100), (0.4, 300)], True)["n_f"] == pytest.approx(0.35)
    assert summary(spark, [(0.2, 100), (None, 300)], True)["n_f"] is None
    assert summary(spark, [(0.2, 100), (None, 300)], False)["n_f"] == pytest.approx(0.2)
    assert summary(spark, [(0.2, 0), (0.4, 0)], True)["n_f"] is None
    assert summary(spark, [(0.2, 100), (0.4, 300)], True)["n_pop"] == 400


def test_upto_and_wide_agree_with_summary(spark):
    pdf = clustered(200, 5)
    rng = np.random.default_rng(0)
    pdf = pdf.assign(year=2010, f=rng.random(len(pdf)), pop=rng.integers(1, 50, len(pdf)))
    panel = spark.createDataFrame(pdf)
    near = nearest(panel, "id", "x", "y", ["w", "year"], 4).cache()
    full = neighbor_features(near, panel, id="id", weight="pop", mean_cols=["f"], sum_cols=["pop"])
    upto = neighbor_features_upto(near, panel, id="id", weight="pop", mean_cols=["f"], sum_cols=["pop"])
    a = full.toPandas().set_index("id").sort_index()
    b = upto.filter("k = 4").toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(a.loc[b.index, "n_f"], b["n_f"])
    lows, highs = pdf["f"].min(), pdf["f"].max()
    assert a["n_f"].between(lows, highs).all()
    wide = neighbor_columns_wide(near, panel, id="id", year="year", columns=["f", "pop"], k=4).toPandas().set_index("id")
    first = upto.filter("k = 1").toPandas().set_index("id")
    np.testing.assert_allclose(wide.loc[first.index, "0_f"], first["n_f"])

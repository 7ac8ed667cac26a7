"""Forests drawn by key, stored sketches and files with different headers."""

import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import forest, metrics, sketches
from cohortlens.operators.boosting import bin_edges, binned, row_draw
from cohortlens.operators.forest import ForestSettings
from cohortlens.sources import tables as io

NAMES = ["a", "b", "c", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 600
    y = (rng.random(n) < 0.4).astype(int)
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "a": rng.normal(1.5 * y, 1.5).round(2), "b": rng.normal(y, 1).round(1), "c": rng.normal(size=n), "same": 1.0, "label": y,
    })).cache()


def plain_forest(bins, y, draw, s):
    """Share of 1 per row and tree, by nested loops."""
    shares = []
    for t in range(s.trees):
        place = [int(d) * pow(48271, s.seed + t + 1, 2**31 - 1) % (2**31 - 1) / (2**31 - 1) for d in draw]
        w = [sum(p >= x for x in forest.TIMES) for p in place]

        def score(rs):
            total = sum(w[i] for i in rs)
            return sum(w[i] * y[i] for i in rs) ** 2 / total if total else 0.0

        def grow(rs, node, level):
            drawn = [i for i in rs if w[i]]
            mean = sum(w[i] * y[i] for i in drawn) / sum(w[i] for i in drawn)
            best = None
            if level < s.depth:
                allowed = forest._allowed(s, t, [node], len(bins[0]))[0]
                for f in np.flatnonzero(allowed):
                    for cut in sorted({bins[i][f] for i in drawn})[:-1]:
                        left, right = [i for i in drawn if bins[i][f] <= cut], [i for i in drawn if bins[i][f] > cut]
                        gain = 0.5 * (score(left) + score(right) - score(drawn))
                        heavy = min(sum(w[i] for i in left), sum(w[i] for i in right)) >= s.least_weight
                        if heavy and gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, cut
            if best is None:
                return {i: mean for i in rs}
            _, f, cut = best
            return grow([i for i in rs if bins[i][f] <= cut], 2 * node + 1, level + 1) | grow([i for i in rs if bins[i][f] > cut], 2 * node + 2, level + 1)

        shares.append(grow(list(range(len(y))), 0, 0))
    return [np.mean([s[i] for s in shares]) for i in range(len(y))]


def test_forest_equals_plain_loops_whatever_the_partitions(rows):
    settings = ForestSettings(trees=4, depth=3, least_weight=3.0, features_a_node=2)
    edges = bin_edges(rows, NAMES, 8)
    held = binned(rows, NAMES, edges, ["id", F.col("label").alias("y"), row_draw(["id"], settings.seed).alias("draw")]).orderBy("id").toPandas()
    want = plain_forest(held["bins"].tolist(), held["y"].tolist(), held["draw"].tolist(), settings)
    model = forest.fit_forest(rows, NAMES, "label", ["id"], settings, bins=8)
    got = forest.score_forest(model, rows, ["id"]).orderBy("id").toPandas()
    np.testing.assert_allclose(got["score"], want, atol=1e-9)
    assert (got["prediction"] == (got["score"] > 0.5)).all()
    other = forest.fit_forest(rows.repartition(5, "c"), NAMES, "label", ["id"], settings, bins=8)
    for s, t in zip(model.trees, other.trees):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all()
        np.testing.assert_allclose(s.weight, t.weight, atol=1e-12)


def test_forest_learns_and_bags_differ(rows):
    train, test = rows.where("id < 450"), rows.where("id >= 450")
    model = forest.fit_forest(train, NAMES, "label", ["id"], ForestSettings(trees=10, depth=4))
    assert metrics.area_under_roc(forest.score_forest(model, test, ["label"])).first()["auc"] > 0.75
    assert len({tuple(t.feature) + tuple(t.cut) for t in model.trees}) > 5
    weights = rows.select(row_draw(["id"], 42).alias("draw")).select(F.explode(forest._bag_weights(ForestSettings(trees=30))).alias("w"))
    mean, variance = weights.agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(1, abs=0.05) and variance == pytest.approx(1, abs=0.1)


def test_forest_of_no_rows(rows):
    model = forest.fit_forest(rows.limit(0), NAMES, "label", ["id"], ForestSettings(trees=2, depth=2))
    assert {r["score"] for r in forest.score_forest(model, rows, ["id"]).collect()} == {0.0}
    assert forest.score_forest(model, rows.limit(0), ["id"]).collect() == []


# --- sketches --------------------------------------------------------------------------------------


def test_stored_sketches_answer_for_parts_and_unions(spark):
    rng = np.random.default_rng(12)
    n = 120_000
    pdf = pd.DataFrame({
        "state": rng.choice(["hot", "warm", "cold"], n, p=[0.9, 0.0999, 0.0001]), "year": rng.integers(2010, 2015, n),
        "v": rng.lognormal(3, 1, n), "key": rng.integers(0, 30_000, n),
    })
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("key") % 50 != 0, F.col("v")))
    table = sketches.sketch_table(df, ["state", "year"], "v", "key")
    known = pdf[pdf["key"] % 50 != 0]
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    for by in (["state", "year"], ["state"], []):
        held = sketches.merged(table, by)
        groups = {(): known} if not by else dict(list(known.groupby(by)))
        for r in sketches.percentiles(held, by, shares).collect():
            values = np.sort(groups[tuple(r[c] for c in by)]["v"].to_numpy())
            for name, q in shares.items():
                low, high = np.searchsorted(values, r[name], "left"), np.searchsorted(values, r[name], "right")
                off = max(0, low - q * len(values), q * len(values) - high) / len(values)
                assert off <= 2 * 1.7 / sketches.SIZE or len(values) < 50, (by, name, off)
        everyone = {(): pdf} if not by else dict(list(pdf.groupby(by)))
        for r in sketches.distinct_keys(held, by).collect():
            true = everyone[tuple(r[c] for c in by)]["key"].nunique()
            assert abs(r["distinct_keys"] - true) <= 0.04 * true
    assert sketches.merged(table).first()["rows"] == n
    plan = sketches.percentiles(sketches.merged(table, ["state"]), ["state"], shares)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "sketches" in plan  # the sketch table, not the rows


def test_sketches_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1.0, 5), ("b", 3.0, 5), (None, 2.0, 6)], "g string, v double, k int")
    table = sketches.sketch_table(df, ["g"], "v", "k")
    assert {tuple(r) for r in sketches.percentiles(table, ["g"], {"p": 0.5}).collect()} == {("a", None), ("b", 1.0), (None, 2.0)}
    assert {tuple(r) for r in sketches.distinct_keys(table, ["g"]).collect()} == {("a", 0), ("b", 1), (None, 1)}
    reference = sketches.sketch_table(df.where("k = 5").withColumn("one", F.lit(1)), ["one"], "v", "k")
    assert {tuple(r) for r in sketches.common_keys(table, "g", reference).collect()} == {("a", 0, 0), ("b", 1, 1), (None, 1, 0)}
    assert sketches.merged(sketches.sketch_table(df.limit(0), ["g"], "v", "k"), ["g"]).collect() == []


# --- files with different headers ------------------------------------------------------------------


def test_files_are_read_once_per_header(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for i in range(6):
        (tmp_path / f"a{i}.csv").write_text(f"x,y,\"z, more\"\n{i},2,t\n")
        (tmp_path / "deep" / f"b{i}.csv").write_text(f"\"z, more\",extra,y,x\nu,9,3,{10 + i}\n")
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("y,x,\"z, more\"\n5,50,v\n")
    got = io.read_csv_files(spark, [str(tmp_path)], "x int, y int, `z, more` string")
    want = [(i, 2, "t") for i in range(6)] + [(10 + i, 3, "u") for i in range(6)] + [(50, 5, "v")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3
    assert len(io.csv_headers(spark, [str(tmp_path)])) == 3
    with pytest.raises(ValueError, match="absent"):
        io.read_csv_files(spark, [str(tmp_path)], "x int, absent int")
    (tmp_path / "none").mkdir()
    assert io.read_csv_files(spark, [str(tmp_path / "none")], "x int").collect() == []

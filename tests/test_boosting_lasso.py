"""Boosted trees, lasso path and cross-validation in one table, against plain versions."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortlens.operators import boosting, lasso_path, metrics, models, tuning
from cohortlens.operators.boosting import BoostSettings
from cohortlens.operators.dataset import fold_column

NAMES = ["a", "b", "c", "same"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 700
    y = (rng.random(n) < 0.4).astype(int)
    return pd.DataFrame({
        "id": np.arange(n), "a": rng.normal(1.5 * y, 1.5).round(2), "b": rng.normal(y, 1).round(1), "c": rng.normal(size=n), "same": 1.0, "label": y,
    })


@pytest.fixture(scope="module")
def rows(spark, frame):
    return fold_column(spark.createDataFrame(frame), ["id"], 4).cache()


# --- boosting --------------------------------------------------------------------------------------


def plain_boosting(bins, y, draw, s):
    """Nested loops over nodes, features and cuts; margins after every round."""
    margin, after = [0.0] * len(y), []
    for number in range(s.rounds):
        g = [1 / (1 + np.exp(-m)) - t for m, t in zip(margin, y)]
        h = [1 / (1 + np.exp(-m)) * (1 - 1 / (1 + np.exp(-m))) for m in margin]
        inside = {i for i in range(len(y)) if int(draw[i]) * pow(48271, s.seed + number + 1, 2**31 - 1) % (2**31 - 1) < int(s.row_share * (2**31 - 1))}
        columns = boosting._columns_of_round(s, len(bins[0]), number)
        score = lambda rs: sum(g[i] for i in rs) ** 2 / (sum(h[i] for i in rs) + s.penalty)

        def grow(all_rows, level):
            drawn = [i for i in all_rows if i in inside]
            weight = -s.rate * sum(g[i] for i in drawn) / (sum(h[i] for i in drawn) + s.penalty)
            best = None
            for f in columns if level < s.depth else ():
                for cut in sorted({bins[i][f] for i in drawn})[:-1]:
                    left = [i for i in drawn if bins[i][f] <= cut]
                    right = [i for i in drawn if bins[i][f] > cut]
                    gain = 0.5 * (score(left) + score(right) - score(drawn)) - s.least_gain
                    heavy = min(sum(h[i] for i in left), sum(h[i] for i in right)) >= s.least_weight
                    if heavy and gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut
            if best is None:
                return {i: weight for i in all_rows}
            _, f, cut = best
            return grow([i for i in all_rows if bins[i][f] <= cut], level + 1) | grow([i for i in all_rows if bins[i][f] > cut], level + 1)

        step = grow(list(range(len(y))), 0)
        margin = [m + step[i] for i, m in enumerate(margin)]
        after.append(margin)
    return np.array(after).T


SETTINGS = [
    BoostSettings(rate=0.3, rounds=4, depth=3, row_share=0.7, column_share=0.6, least_weight=2.0, least_gain=0.1),
    BoostSettings(rate=0.5, rounds=3, depth=2, penalty=0.0, least_weight=0.5),
]


@pytest.mark.parametrize("settings", SETTINGS)
def test_both_fits_equal_plain_loops(rows, frame, settings):
    edges = boosting.bin_edges(rows, NAMES, 8)
    held = boosting.binned(rows, NAMES, edges, ["id", F.col("label").alias("y"), boosting.row_draw(["id"], settings.seed).alias("draw")]).orderBy("id").toPandas()
    values = frame[NAMES].to_numpy()
    assert held["bins"].tolist() == [[sum(e <= v for e in es) for v, es in zip(r, edges)] for r in values]
    plain = plain_boosting(held["bins"].tolist(), held["y"].tolist(), held["draw"].tolist(), settings)
    model = boosting.fit_boosted(rows, NAMES, "label", ["id"], settings, bins=8)
    assert {len(t.feature) for t in model.trees} == {2 ** (settings.depth + 1) - 1}
    rounds = list(range(1, settings.rounds + 1))
    scored = boosting.score_boosted(model, rows, ["id"], rounds).orderBy("id", "rounds").toPandas()
    np.testing.assert_allclose(scored["score"].to_numpy().reshape(-1, len(rounds)), 1 / (1 + np.exp(-plain)), atol=1e-9)
    sampled = boosting.fit_on_sample(rows, NAMES, "label", ["id"], settings, bins=8)
    for one, other in zip(model.trees, sampled.trees):
        assert (one.feature == other.feature).all() and (one.cut == other.cut).all()
        np.testing.assert_allclose(one.weight, other.weight, atol=1e-9)


def test_a_prefix_is_the_model_with_fewer_rounds(rows):
    settings = BoostSettings(rounds=12, row_share=0.8, column_share=0.5, least_gain=0.2)
    long = boosting.fit_on_sample(rows, NAMES, "label", ["id"], settings)
    got = boosting.score_boosted(long, rows, ["id"], [3, 7, 12]).where("rounds = 7").orderBy("id").toPandas()["score"]
    short = boosting.fit_on_sample(rows, NAMES, "label", ["id"], replace(settings, rounds=7))
    want = boosting.score_boosted(short, rows, ["id"]).orderBy("id").toPandas()["score"]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_boosting_does_not_depend_on_partitions_and_learns(rows):
    settings = BoostSettings(rounds=6, rate=0.3)
    one = boosting.fit_boosted(rows.where("id < 500"), NAMES, "label", ["id"], settings)
    other = boosting.fit_boosted(rows.where("id < 500").repartition(5, "b"), NAMES, "label", ["id"], settings)
    for s, t in zip(one.trees, other.trees):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all()
    scored = boosting.score_boosted(one, rows.where("id >= 500"), ["label"])
    assert metrics.area_under_roc(scored).first()["auc"] > 0.75
    assert {t.feature.max() for t in one.trees} <= {0, 1, 2}  # never the column with one value


def test_staged_tuning_tries_every_setting(rows):
    stages = [{"rate": [0.05, 0.3, 0.6]}, {"rounds": [5, 10, 20]}, {"depth": [1, 2], "least_weight": [1.0, 5.0]}]
    chosen, history = boosting.staged_boosting(rows, NAMES, "label", ["id"], stages=stages, refine={"row_share": [-0.02, 0.0, 0.02]}, start=BoostSettings(rounds=8, row_share=0.9))
    assert [h["tried"] for h in history] == [3, 3, 4, 3] and [h["stage"] for h in history] == [1, 2, 3, 4]
    assert chosen.row_share in (0.88, 0.9, 0.92) and chosen.rounds in (5, 10, 20)
    # Each stage can only gain: its grid holds what was chosen before, but for the first two.
    assert history[3]["auc"] >= history[2]["auc"]


def test_published_grids_have_their_sizes():
    sizes = [int(np.prod([len(v) for v in g.values()])) for g in (*boosting.PUBLISHED_STAGES, boosting.PUBLISHED_REFINE)]
    assert sizes == [60, 20, 21, 17, 25, 25]


# --- one table of held-out scores ------------------------------------------------------------------


def test_area_by_group_equals_the_evaluator(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", "z"], 4000, p=[0.6, 0.39, 0.01]), "h": rng.integers(0, 2, 4000), "label": rng.integers(0, 2, 4000)})
    pdf["score"] = (rng.normal(size=4000) + 0.5 * pdf["label"]).round(1) + 0.0  # the evaluator takes -0.0 for another score
    df = spark.createDataFrame(pdf)
    got = {(r["g"], r["h"]): r["auc"] for r in metrics.area_under_roc_by(df.repartition(7), ["g", "h"]).collect()}
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    for (g, h), auc in got.items():
        assert auc == pytest.approx(evaluator.evaluate(df.where((F.col("g") == g) & (F.col("h") == h))), abs=1e-12)
    assert len(got) == 6
    odd = spark.createDataFrame([(None, 1, 0.5), (None, 0, 0.5), ("one class", 1, 0.1)], "g string, label int, score double")
    assert {r["g"]: r["auc"] for r in metrics.area_under_roc_by(odd, ["g"]).collect()} == {None: 0.5, "one class": None}
    assert metrics.area_under_roc_by(odd.limit(0), ["g"]).collect() == []


def test_cross_validation_equals_the_evaluator_per_model(rows):
    cases = {str(r): models.with_features(models.logistic_regression(reg=r), ["a", "b"]) for r in (0.0, 1.0)}
    scores = tuning.cross_validated_scores(rows, cases)
    assert scores.count() == 2 * rows.count()
    got = {r["case"]: r["auc"] for r in tuning.mean_auc(scores).collect()}
    for name, estimator in cases.items():
        assert got[name] == pytest.approx(tuning.cross_validated_auc(rows, estimator, folds=4, fold_col="fold"), abs=1e-9)


# --- lasso -----------------------------------------------------------------------------------------


def test_moments_and_path(rows, frame):
    m = lasso_path.moments(rows, NAMES)
    x = frame[NAMES].to_numpy()
    z = np.where(x.std(axis=0) > 0, (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1), 0)
    y = frame["label"].to_numpy() - frame["label"].mean()
    np.testing.assert_allclose(m.correlation, z.T @ z / len(z), atol=1e-12)
    np.testing.assert_allclose(m.covariance, z.T @ y / len(z), atol=1e-12)
    path = lasso_path.lasso_path(m, [0.2, 0.05, 0.001, 10.0])
    assert not path[10.0].any()
    for alpha, w in path.items():
        gradient = z.T @ (y - z @ w) / len(z)
        assert (np.abs(gradient) <= alpha + 1e-9).all()
        np.testing.assert_allclose(gradient[w != 0], alpha * np.sign(w[w != 0]), atol=1e-9)
    assert lasso_path.optimality(rows, m, path).where("not optimal").count() == 0
    wrong = {0.05: path[0.05] + np.array([0.01, 0, 0, 0])}
    assert lasso_path.optimality(rows, m, wrong).where("not optimal").count() > 0
    table = lasso_path.path_table(rows, m, path)
    assert table.count() == 16 and table.where("feature = 'same' and kept").count() == 0


def test_path_of_no_rows(rows):
    m = lasso_path.moments(rows.limit(0), NAMES)
    assert not lasso_path.lasso_path(m, [0.1])[0.1].any()


# --- work of the tuning ------------------------------------------------------------------------------


def test_the_last_level_asks_for_one_feature_and_no_task_gets_two_cases(spark, rows, monkeypatch):
    asked, grow = [], boosting.grow_tree

    def counting(histogram, columns, settings):
        return grow(lambda nodes, tree, cs: asked.append(len(cs)) or histogram(nodes, tree, cs), columns, settings)

    monkeypatch.setattr(boosting, "grow_tree", counting)
    rng = np.random.default_rng(3)
    sample = boosting.Sample(rng.integers(0, 8, (400, 4)), rng.integers(0, 2, 400).astype(float), np.arange(400) % 5, rng.integers(0, 2**31 - 2, 400), 8)
    boosting.fit_sample(sample.bins, sample.label, sample.draw, BoostSettings(rounds=1, depth=2), 8)
    assert asked == [4, 4, 1]
    monkeypatch.undo()
    tasks, stored = [], boosting.materialise
    monkeypatch.setattr(boosting, "materialise", lambda df, label: tasks.append(df.groupBy(F.spark_partition_id()).agg(F.countDistinct("setting", "fold").alias("n"))) or stored(df, label))
    boosting.cross_validated_scores(spark, sample, [BoostSettings(rounds=1, rate=r) for r in (0.1, 0.2, 0.3)])
    assert [r["n"] for r in tasks[0].collect()] == [1] * 15


def test_a_fit_over_all_rows_counts_one_feature_at_the_last_level(rows, monkeypatch):
    asked, grow = [], boosting.grow_tree

    def counting(histogram, columns, settings):
        return grow(lambda nodes, tree, cs: asked.append(len(cs)) or histogram(nodes, tree, cs), columns, settings)

    whole = boosting.fit_boosted(rows, NAMES, "label", ["id"], BoostSettings(rounds=2, depth=2))
    monkeypatch.setattr(boosting, "grow_tree", counting)
    again = boosting.fit_boosted(rows, NAMES, "label", ["id"], BoostSettings(rounds=2, depth=2))
    assert asked == [4, 4, 1] * 2
    for a, b in zip(whole.trees, again.trees, strict=True):
        assert (a.feature == b.feature).all() and np.allclose(a.weight, b.weight)


def test_a_level_is_counted_within_tasks(rows, monkeypatch):
    settings, bins = BoostSettings(rounds=1, depth=1, row_share=0.7), 8
    edges = boosting.bin_edges(rows, NAMES, bins)
    label = F.when(F.col("id") % 10 != 0, F.col("label").cast("double"))  # a row without a label adds to the hessians only
    held = boosting.binned(rows, NAMES, edges, [label.alias("y"), boosting.row_draw(["id"], 42).alias("draw"), F.lit(0.25).alias("margin")])
    held = held.repartition(3).cache()
    first = boosting.Tree(np.array([0, -1, -1]), np.array([3, 0, 0]), np.array([0.0, 0.5, -0.5]))
    grown = boosting.Tree(np.array([1, -1, -1]), np.array([2, 0, 0]), np.zeros(3))
    columns, nodes = np.array([0, 2]), [2, 1]
    got = boosting.level_sums(held, nodes, [first, grown], columns, settings, 0, bins)
    assert got.count() <= 3 * len(columns) * len(nodes) * bins
    want = np.zeros((len(columns), len(nodes), bins, 2))
    for r in held.collect():
        if r["draw"] * boosting._multiplier(settings, 0) % boosting._PRIME < boosting._rows_limit(settings):
            p = 1 / (1 + np.exp(-0.25 - (0.5 if r["bins"][0] <= 3 else -0.5)))
            for f, c in enumerate(columns):
                want[f, nodes.index(1 if r["bins"][1] <= 2 else 2), r["bins"][c]] += 0 if r["y"] is None else p - r["y"], p * (1 - p)
    sums = np.zeros((want.size // 2, 2))
    for r in got.collect():
        sums[r["cell"]] += r["g"], r["h"]
    np.testing.assert_allclose(sums, want.reshape(-1, 2), atol=1e-9)
    monkeypatch.setattr(boosting.F, "posexplode", None)  # rows are not repeated per feature
    assert len(boosting.fit_boosted(rows, NAMES, "label", ["id"], BoostSettings(rounds=1, depth=1)).trees) == 1


def test_a_sweep_passes_over_few_partitions(spark, monkeypatch):
    stored = tuning.materialise(spark.range(1000).withColumn("x", F.rand(1)).repartition(16), "many")
    assert stored.rdd.getNumPartitions() > 2
    few = tuning._gathered(stored, spark.sparkContext.defaultParallelism)
    assert few.rdd.getNumPartitions() == 1 and few.count() == 1000
    monkeypatch.setattr(tuning, "CELLS_A_PARTITION", 1000)
    assert tuning._gathered(stored, spark.sparkContext.defaultParallelism).rdd.getNumPartitions() == 2


def test_nodes_too_light_to_split_are_left_out_without_a_difference(frame):
    rng = np.random.default_rng(4)
    bins, label, draw = rng.integers(0, 12, (300, 5)), rng.integers(0, 2, 300).astype(float), rng.integers(0, 2**31 - 2, 300)
    for s in (BoostSettings(rounds=3, depth=5, least_weight=3.0), BoostSettings(rounds=3, depth=5, least_weight=0.0, row_share=0.6)):
        margin = np.zeros(300)
        for number, tree in enumerate(boosting.fit_sample(bins, label, draw, s, 12)):
            p = 1 / (1 + np.exp(-margin))
            drawn = draw * boosting._multiplier(s, number) % boosting._PRIME < boosting._rows_limit(s)

            def histogram(nodes, grown, columns):
                sums, at = np.zeros((len(nodes), len(columns), 12, 2)), boosting.tree_nodes(grown, bins)
                for i in np.flatnonzero(drawn & np.isin(at, nodes)):
                    for f, c in enumerate(columns):
                        sums[nodes.index(at[i]), f, bins[i, c]] += p[i] - label[i], p[i] * (1 - p[i])
                return sums

            whole = boosting.grow_tree(histogram, np.arange(5), s)
            assert (whole.feature == tree.feature).all() and (whole.cut == tree.cut).all() and (whole.weight == tree.weight).all()
            margin += tree.weight[boosting.tree_nodes(tree, bins)]


# --- tuning on all rows ------------------------------------------------------------------------------


def test_staged_tuning_and_the_winner_see_every_row(spark, monkeypatch):
    n, start = 20_600, BoostSettings(rounds=1, depth=1)
    many = spark.range(n).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") * 7 % 31).cast("double").alias("b"), ((F.col("id") % 97 + F.col("id") % 5) > 50).cast("int").alias("label"))
    many, counted, mean = fold_column(many, ["id"], 2).cache(), [], boosting.mean_auc
    monkeypatch.setattr(boosting, "mean_auc", lambda scores: counted.extend(scores.groupBy("setting", "rounds").count().collect()) or mean(scores))
    chosen, history = boosting.staged_boosting(many, ["a", "b"], "label", ["id"], stages=[{"rate": [0.1, 0.5]}], refine=None, start=start)
    assert [r["count"] for r in counted] == [n] * 2 and [h["tried"] for h in history] == [2]
    winner, spread = boosting.fit_in_task(many, ["a", "b"], "label", ["id"], chosen), boosting.fit_boosted(many, ["a", "b"], "label", ["id"], chosen)
    for one, other in zip(winner.trees, spread.trees, strict=True):
        assert (one.feature == other.feature).all() and (one.cut == other.cut).all()
        np.testing.assert_allclose(one.weight, other.weight, atol=1e-9)


def test_rows_too_many_for_a_task_are_tuned_alike(rows, monkeypatch):
    rows, stages = rows.where("fold < 2").cache(), [{"rounds": [1, 2]}]
    tune = lambda: boosting.staged_boosting(rows, NAMES, "label", ["id"], stages=stages, refine=None, start=BoostSettings(rounds=1, depth=1, row_share=0.8))
    chosen, history = tune()
    whole = boosting.fit_in_task(rows, NAMES, "label", ["id"], chosen)
    monkeypatch.setattr(boosting, "TASK_CELLS", 0)
    monkeypatch.setattr(boosting, "fit_sample", None)
    spread, again = tune()
    assert spread == chosen and [{**h, "auc": 0} for h in again] == [{**h, "auc": 0} for h in history]
    assert [h["auc"] for h in again] == pytest.approx([h["auc"] for h in history], abs=1e-9)
    for one, other in zip(whole.trees, boosting.fit_in_task(rows, NAMES, "label", ["id"], chosen).trees, strict=True):
        np.testing.assert_allclose(one.weight, other.weight, atol=1e-9)


def test_arrays_hold_every_row_in_order_whatever_the_blocks(spark, rows, monkeypatch):
    held = boosting.binned(rows, NAMES, boosting.bin_edges(rows, NAMES, 8), [F.col("label").cast("double").alias("y"), "fold", boosting.row_draw(["id"], 42).alias("draw")])
    one = boosting.all_rows(held)
    assert one.bins.dtype == np.uint8 and len(one.bins) == 700 and (np.diff(one.draw) >= 0).all()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        several = boosting.all_rows(held.repartition(5))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for n in ("bins", "label", "fold", "draw"):
        assert (getattr(one, n) == getattr(several, n)).all()
    with pytest.raises(ValueError, match="no rows"):
        boosting.all_rows(held.limit(0))
    with pytest.raises(ValueError, match="lacks a feature"):
        boosting.all_rows(held.withColumn("bins", F.when(F.col("draw") > 10**9, F.col("bins"))))

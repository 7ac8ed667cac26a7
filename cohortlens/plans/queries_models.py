"""Queries on scaling, models, tuning and metrics."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import boosting, dataset, forest, lasso_path, metrics, models, network, profile, tuning
from cohortlens.operators.scale import materialise, new_table_path
from cohortlens.plans.derived_tables import (
    DOCUMENT_FEATURES,
    document_features,
    scored_documents,
    study_tables,
)
from cohortlens.plans.oracles import hash_unit, sql
from cohortlens.plans.queries_panel import MODEL_SETTINGS, study_matrix
from cohortlens.plans.registry import query
from cohortlens.plans.study import LABEL, MODEL_FEATURES, NEIGHBOR_MEANS, NEIGHBOR_TOTALS, OWN_FEATURES, neighbor_sweep_tables

_TRAIN = f"select * from docs where {hash_unit('doc_id')} < 0.8"
_TEST = f"select * from docs where {hash_unit('doc_id')} >= 0.8"


def _documents(spark, sf_dir):
    """Train and test documents with the quality label."""
    docs = materialise(document_features(spark, sf_dir).withColumnRenamed("quality", "label"), "docs")
    return dataset.hash_split(docs, ["doc_id"])


def _study(spark, sf_dir):
    """Balanced training rows and test rows of the study."""
    matrix = materialise(study_matrix(spark, sf_dir, MODEL_SETTINGS), "matrix")
    train, test = dataset.hash_split(matrix, ["GEO_ID", "year"])
    return dataset.undersample(train, LABEL, ["GEO_ID", "year"]), test


@query(
    "M01",
    sql("select doc_id, n_chars, n_words, distinct_share, n_punct from docs", "docs"),
)
def assembled_vectors(spark, sf_dir):
    """Feature vectors, unpacked again."""
    docs = document_features(spark, sf_dir)
    packed = dataset.assembler(DOCUMENT_FEATURES).transform(docs)
    return dataset.unpack_vector(packed, "features", DOCUMENT_FEATURES, ["doc_id"])


def _scaled(spark, sf_dir, kind):
    train, test = _documents(spark, sf_dir)
    model = dataset.fit_scaling(train, DOCUMENT_FEATURES, kind)
    rows = dataset.unpack_vector(model.transform(test), "scaled", DOCUMENT_FEATURES, ["doc_id"])
    return rows.withColumns({c: F.round(c, 6) for c in DOCUMENT_FEATURES})


@query(
    "M02",
    sql("select doc_id, " + ", ".join(f"round(({c} - min_{c}) / (max_{c} - min_{c}), 6) as {c}" for c in DOCUMENT_FEATURES)
        + " from test, stats", "docs", test=_TEST, train=_TRAIN,
        stats="select " + ", ".join(f"min({c}) as min_{c}, max({c}) as max_{c}" for c in DOCUMENT_FEATURES) + " from train"),
)
def min_max_scaled(spark, sf_dir):
    """Test documents scaled to the range of the training documents."""
    return _scaled(spark, sf_dir, "minmax")


@query(
    "M03",
    sql("select doc_id, " + ", ".join(f"round(({c} - avg_{c}) / std_{c}, 6) as {c}" for c in DOCUMENT_FEATURES)
        + " from test, stats", "docs", test=_TEST, train=_TRAIN,
        stats="select " + ", ".join(f"avg({c}) as avg_{c}, stddev_samp({c}) as std_{c}" for c in DOCUMENT_FEATURES) + " from train"),
)
def standard_scaled(spark, sf_dir):
    """Test documents standardised by the training documents."""
    return _scaled(spark, sf_dir, "standard")


_GNB_STATS = (
    "select label, count(*) as n, "
    + ", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in DOCUMENT_FEATURES)
    + " from (select *, quality as label from train) group by label"
)
_GNB_EPS = "select 1e-9 * greatest(" + ", ".join(f"var_pop({c})" for c in DOCUMENT_FEATURES) + ") as eps from train"
_GNB_LL = " + ".join(
    f"-0.5 * ln(2 * pi() * (v_{c} + eps)) - ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + eps))"
    for c in DOCUMENT_FEATURES
)


@query(
    "M04 M11",
    sql(f"""select doc_id, label, cast(arg_max(class, ll) as integer) as prediction from (
              select t.doc_id, t.quality as label, s.label as class, ln(s.n) + {_GNB_LL} as ll
              from test t, stats s, eps) group by doc_id, label""",
        "docs", test=_TEST, train=_TRAIN, stats=_GNB_STATS, eps=_GNB_EPS),
)
def naive_bayes_predictions(spark, sf_dir):
    """Gaussian naive Bayes on documents; the prediction has a closed form."""
    train, test = _documents(spark, sf_dir)
    model = models.fit(train, models.with_features(models.gaussian_naive_bayes(), DOCUMENT_FEATURES, None))
    return models.score(model, test, ["doc_id", "label"]).drop("score")


def _study_scores(spark, sf_dir, estimator, scaling):
    train, test = _study(spark, sf_dir)
    model = models.fit(train, models.with_features(estimator, MODEL_FEATURES, scaling))
    return models.score(model, test, ["GEO_ID", "year", LABEL])


@query("M05 M02 M11 U05")
def logistic_study(spark, sf_dir):
    """Logistic regression on the balanced study, scores of the test tracts."""
    return _study_scores(spark, sf_dir, models.logistic_regression(LABEL), "minmax")


@query("M06 M11")
def forest_study(spark, sf_dir):
    """Random forest on the balanced study."""
    return _study_scores(spark, sf_dir, models.random_forest(LABEL), None)


@query("M07 M11")
def boosted_trees_study(spark, sf_dir):
    """Gradient-boosted trees on the balanced study."""
    return _study_scores(spark, sf_dir, models.boosted_trees(LABEL, rounds=10), None)


@query("M09 M10 M11 X09")
def network_study(spark, sf_dir):
    """Feed-forward network with one hidden layer of 32 units."""
    layers = models.network_layers(len(MODEL_FEATURES), base=32, depth=1)
    return _study_scores(spark, sf_dir, models.perceptron(layers, LABEL), "standard")


@query("M08")
def lasso_features(spark, sf_dir):
    """Features that survive an L1 penalty on the study."""
    train, _ = _study(spark, sf_dir)
    model = models.fit(train, models.with_features(models.lasso(0.01, LABEL), MODEL_FEATURES))
    coefficients = model.stages[-1].coefficients.toArray()
    rows = [{"feature": f, "coefficient": float(c), "kept": bool(c != 0.0)} for f, c in zip(MODEL_FEATURES, coefficients)]
    return tuning.tabulate(spark, rows, "feature string, coefficient double, kept boolean")


def _study_models():
    """The models that the study compares, with their scaling."""
    layers = models.network_layers(len(MODEL_FEATURES), base=32, depth=1)
    return {
        "naive_bayes": (models.gaussian_naive_bayes(LABEL), None),
        "logistic_regression": (models.logistic_regression(LABEL, reg=0.01), "minmax"),
        "random_forest": (models.random_forest(LABEL, trees=50), None),
        "boosted_trees": (models.boosted_trees(LABEL, rounds=20), None),
        "network": (models.perceptron(layers, LABEL, solver="l-bfgs", rounds=100), "standard"),
    }


@query("M04 M05 M06 M07 M09 U05 E01 E02 E03 E05 E06 E07")
def study_model_figures(spark, sf_dir):
    """Held-out figures of every model of the study: counts, precision, recall, F1 and AUC."""
    train, test = _study(spark, sf_dir)
    train, rows = materialise(train, "train"), []
    for name, (estimator, scaling) in _study_models().items():
        model = models.fit(train, models.with_features(estimator, MODEL_FEATURES, scaling))
        scored = materialise(models.score(model, test, [LABEL]), "scored")
        m = metrics.class_metrics(scored, LABEL).select(
            F.lit(name).alias("model"), "tp", "fp", "fn", "tn", "precision_1", "recall_1", "f1_1", "accuracy"
        )
        auc = materialise(metrics.area_under_roc(scored, LABEL), "auc")
        rows.append(m.withColumn("auc", auc.select("auc").scalar()))
    return functools.reduce(DataFrame.unionByName, rows)


def _forest_on_test(spark, sf_dir):
    """Test tracts of the study with the forest's prediction and their features."""
    train, test = _study(spark, sf_dir)
    model = models.fit(train, models.with_features(models.random_forest(LABEL), MODEL_FEATURES, None))
    keep = list(dict.fromkeys(["GEO_ID", "state", "year", *MODEL_FEATURES, LABEL]))
    return materialise(models.score(model, test, [c for c in keep if c in test.columns]), "scored")


@query("E08 F07 M06")
def study_slices(spark, sf_dir):
    """The forest's figures on all test tracts and where the neighbourhood passes each predicate.

    A diagnostic of the model; it must not steer how resources are allocated.
    """
    scored = _forest_on_test(spark, sf_dir)
    middle = scored.agg(*[F.median(c).alias(c) for c in ("race_white", "n_ed_total", "n_land_area")]).first()
    white, educated = F.col("race_white") > middle["race_white"], F.col("n_ed_total") > middle["n_ed_total"]
    compact = F.col("n_land_area") < middle["n_land_area"]
    return metrics.slice_metrics(scored, {
        "all": F.lit(True), "white_or_educated": white | educated, "compact": compact, "both": (white | educated) & compact,
    }, LABEL)


@query("E09 X08 M06")
def study_residuals(spark, sf_dir):
    """Feature means and deviations per residual class of the forest."""
    return metrics.residual_profile(_forest_on_test(spark, sf_dir), MODEL_FEATURES, LABEL)


@query("E10 J10 M06")
def study_outcomes(spark, sf_dir):
    """Outcome class of each test tract by the forest, the data behind a map."""
    return metrics.outcome(_forest_on_test(spark, sf_dir).select("GEO_ID", LABEL, "prediction"), LABEL)


@query("M05", "select unnest(['n_chars', 'n_words', 'distinct_share', 'n_punct', 'intercept']) as feature, true as solved")
def logistic_score_equations(spark, sf_dir):
    """An unpenalised logistic regression solves sum((p - y) x) = 0 for every feature."""
    train, _ = _documents(spark, sf_dir)
    packed = dataset.fit_scaling(train, DOCUMENT_FEATURES).transform(train)
    packed = packed.select("label", F.col("scaled").alias("features"))
    model = models.fit(packed, models.logistic_regression().setMaxIter(500).setTol(1e-10))
    names = [*DOCUMENT_FEATURES, "intercept"]
    gap = vector_to_array("probability")[1] - F.col("label")
    values = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    scored = model.transform(packed).select(gap.alias("gap"), values.alias("x"))
    means = scored.agg(*[F.abs(F.avg(F.col("gap") * F.col("x")[i])).alias(n) for i, n in enumerate(names)])
    return means.unpivot([], names, "feature", "mean").select("feature", (F.col("mean") < 1e-3).alias("solved"))


@query("M08", "select unnest(['n_chars', 'n_words', 'distinct_share', 'n_punct']) as feature, true as optimal")
def lasso_conditions(spark, sf_dir):
    """An L1 penalty is optimal: residual correlation at the penalty if kept, within it if not."""
    train, _ = _documents(spark, sf_dir)
    alpha = 0.01
    packed = dataset.fit_scaling(train, DOCUMENT_FEATURES).transform(train).select("label", F.col("scaled").alias("features"))
    model = models.fit(packed, models.lasso(alpha).setMaxIter(500).setTol(1e-12))
    scored = model.transform(packed).select((F.col("label") - F.col("prediction")).alias("rest"), vector_to_array("features").alias("x"))
    means = scored.agg(*[F.avg(F.col("rest") * F.col("x")[i]).alias(n) for i, n in enumerate(DOCUMENT_FEATURES)])
    kept = {n: float(c) for n, c in zip(DOCUMENT_FEATURES, model.coefficients.toArray())}
    weight = F.create_map(*[F.lit(v) for pair in kept.items() for v in pair])
    rows = means.unpivot([], list(DOCUMENT_FEATURES), "feature", "mean").withColumn("weight", weight[F.col("feature")])
    held = F.abs(F.col("mean") - alpha * F.signum("weight")) < 1e-4
    return rows.select("feature", F.when(F.col("weight") != 0, held).otherwise(F.abs("mean") <= alpha + 1e-4).alias("optimal"))


@query("S09 M11", sql("select doc_id, true as equal from test", "docs", test=_TEST))
def saved_model_equality(spark, sf_dir):
    """A model gives the same scores before it is saved and after it is loaded."""
    train, test = _documents(spark, sf_dir)
    model = models.fit(train, models.with_features(models.random_forest(trees=5), DOCUMENT_FEATURES, None))
    path = new_table_path(spark, "model")
    models.save_model(model, path)
    before, after = (models.score(m, test, ["doc_id"]) for m in (model, models.load_model(path)))
    both = before.join(after.withColumnsRenamed({"score": "score2", "prediction": "prediction2"}), "doc_id")
    return both.select("doc_id", ((F.col("score") == F.col("score2")) & (F.col("prediction") == F.col("prediction2"))).alias("equal"))


@query(
    "M06 M11 U04",
    sql("select doc_id, quality as label, true as in_range from test", "docs", test=_TEST),
)
def forest_score_ranges(spark, sf_dir):
    """Every test document gets a score in 0 to 1 and the class on its side of one half."""
    train, test = _documents(spark, sf_dir)
    model = models.fit(train, models.with_features(models.random_forest(trees=5), DOCUMENT_FEATURES, None))
    scored = models.score(model, test, ["doc_id", "label"])
    side = (F.col("score") > 0.5) == (F.col("prediction") == 1)
    return scored.select("doc_id", "label", (F.col("score").between(0, 1) & (side | (F.col("score") == 0.5))).alias("in_range"))


@query(
    "M12 M14",
    "select unnest(cast([0.0, 0.01, 0.1] as double[])) as regParam, true as in_range, 1 as winners",
)
def grid_search_winner(spark, sf_dir):
    """A grid lists each setting once, scores in 0 to 1; the best setting has the highest score."""
    train, _ = _documents(spark, sf_dir)
    folded = dataset.fold_column(train, ["doc_id"], 5)
    found = tuning.grid_search(
        folded, models.with_features(models.logistic_regression(), DOCUMENT_FEATURES),
        {"regParam": [0.0, 0.01, 0.1]}, fold_col="fold",
    )
    scores = tuning.grid_scores(found)
    best = tuning.best_setting(found)
    winners = sum(s["auc"] == max(x["auc"] for x in scores) for s in scores if s["regParam"] == best["regParam"])
    rows = [{"regParam": s["regParam"], "in_range": 0 <= s["auc"] <= 1, "winners": winners} for s in scores]
    return tuning.tabulate(spark, rows, "regParam double, in_range boolean, winners int")


@query("S09 M11")
def saved_model_scores(spark, sf_dir):
    """A fitted model saved, loaded again and applied."""
    train, test = _documents(spark, sf_dir)
    model = models.fit(train, models.with_features(models.logistic_regression(), DOCUMENT_FEATURES))
    path = new_table_path(spark, "model")
    models.save_model(model, path)
    return models.score(models.load_model(path), test, ["doc_id", "label"])


@query("M12 M14")
def grid_search_scores(spark, sf_dir):
    """Five-fold grid over the penalty of a logistic regression, folds by key hash."""
    train, _ = _documents(spark, sf_dir)
    folded = dataset.fold_column(train, ["doc_id"], 5)
    found = tuning.grid_search(
        folded, models.with_features(models.logistic_regression(), DOCUMENT_FEATURES),
        {"regParam": [0.0, 0.01, 0.1]}, fold_col="fold",
    )
    return tuning.tabulate(spark, tuning.grid_scores(found), "regParam double, auc double")


def _study_folds(spark, sf_dir, folds=5):
    """Balanced training rows of the study with folds, and test rows."""
    train, test = _study(spark, sf_dir)
    return materialise(dataset.fold_column(train, ["GEO_ID", "year"], folds), "train"), test


def _figures(scored, label=LABEL):
    """Precision, recall, F1 of the positive class and area under ROC of scored rows, one row."""
    scored = materialise(scored, "scored")
    auc = materialise(metrics.area_under_roc(scored, label), "auc").select("auc").scalar()
    return metrics.class_metrics(scored, label).select("tp", "fp", "fn", "tn", "precision_1", "recall_1", "f1_1", auc.alias("auc"))


@query("M13 M07 M14")
def staged_tuning(spark, sf_dir):
    """Stage-wise tuning of second-order boosted trees on the study, at the published grids and five folds.

    60 rates, 20 numbers of rounds from one fit a fold, 7 x 3 depths and leaf weights, 17 least
    gains, 5 x 5 row and column shares, and 5 x 5 refined ones, every fit on all training rows outside its
    fold. Each row names what its stage chose; the last one has the area under ROC on the test rows of the
    winner, fitted to all training rows.
    """
    train, test = _study_folds(spark, sf_dir)
    chosen, history = boosting.staged_boosting(train, MODEL_FEATURES, LABEL, ["GEO_ID", "year"])
    winner = boosting.fit_in_task(train, MODEL_FEATURES, LABEL, ["GEO_ID", "year"], chosen)
    figures = metrics.area_under_roc(boosting.score_boosted(winner, test, [LABEL]), LABEL).first()["auc"]
    rows = [
        {"stage": h["stage"], "tried": h["tried"], "auc": h["auc"],
         "chosen": ", ".join(f"{n}={v}" for n, v in h.items() if n not in ("stage", "tried", "auc"))}
        for h in history
    ]
    rows.append({"stage": len(history) + 1, "tried": 1, "chosen": "winner on test rows", "auc": figures})
    return tuning.tabulate(spark, rows, "stage int, tried int, chosen string, auc double")


@query("M07 M11 E01 E02 E03 E06")
def boosted_trees_compared(spark, sf_dir):
    """Second-order boosting over all rows beside MLlib's gradient boosting: test figures after 5 and 10 rounds."""
    train, test = _study(spark, sf_dir)
    train, keys = materialise(train, "train"), ["GEO_ID", "year"]
    model = boosting.fit_boosted(train, MODEL_FEATURES, LABEL, keys, boosting.BoostSettings(rounds=10))
    scored = materialise(boosting.score_boosted(model, test, [LABEL], [5, 10]), "boosted")
    own = [
        _figures(scored.where(F.col("rounds") == r)).select(F.lit("second order").alias("model"), F.lit(r).alias("rounds"), "*")
        for r in (5, 10)
    ]
    fitted = models.fit(train, models.with_features(models.boosted_trees(LABEL, rounds=10), MODEL_FEATURES, None))
    other = _figures(models.score(fitted, test, [LABEL])).select(F.lit("first order").alias("model"), F.lit(10).alias("rounds"), "*")
    return functools.reduce(DataFrame.unionByName, [*own, other])


#: Cuts of the document features for the boosted stumps, and their settings.
_STUMP_EDGES = {"n_chars": [300, 1000, 3000], "n_words": [60, 200, 600], "distinct_share": [0.5, 0.7, 0.9], "n_punct": [10, 40, 160]}
_STUMPS = boosting.BoostSettings(rate=0.5, rounds=3, depth=1, least_weight=2.0, least_gain=0.01)


def _stump_sql() -> str:
    """The rounds one after another: gains of every cut from sums over the rows, the best cut, two weights."""
    listed = ", ".join(f"('{f}', {i}, {c}, {e!r})" for i, (f, es) in enumerate(_STUMP_EDGES.items()) for c, e in enumerate(es))
    value = "case feature " + " ".join(f"when '{f}' then {f}" for f in _STUMP_EDGES) + " end"
    s = _STUMPS
    score = lambda g, h: f"({g}) * ({g}) / ({h} + {s.penalty})"
    parts = [
        f"cuts as (select * from (values {listed}) v(feature, place, cut, edge))",
        "m0 as (select *, 0.0::double as margin from docs)",
    ]
    for r in range(s.rounds):
        parts += [
            f"g{r} as materialized (select *, 1 / (1 + exp(-margin)) - quality as g, exp(-margin) / (1 + exp(-margin)) / (1 + exp(-margin)) as h from m{r})",
            f"t{r} as (select sum(g) as tg, sum(h) as th from g{r} where {hash_unit('doc_id')} < 0.8)",
            f"l{r} as (select feature, place, cut, edge, sum(g) as lg, sum(h) as lh from g{r}, cuts where {hash_unit('doc_id')} < 0.8 and {value} < edge group by all)",
            f"b{r} as materialized (select feature, edge, lg, lh, tg, th from l{r}, t{r} where lh >= {s.least_weight} and th - lh >= {s.least_weight} "
            f"and round(0.5 * ({score('lg', 'lh')} + {score('tg - lg', 'th - lh')} - {score('tg', 'th')}) - {s.least_gain}, 9) > 0 "
            f"order by round(0.5 * ({score('lg', 'lh')} + {score('tg - lg', 'th - lh')} - {score('tg', 'th')}) - {s.least_gain}, 9) desc, place, cut limit 1)",
            f"m{r + 1} as (select g.* exclude (margin, g, h), margin - {s.rate} * case when b.edge is null then tg0 / (th0 + {s.penalty}) "
            f"when {value} < edge then lg / (lh + {s.penalty}) else (tg - lg) / (th - lh + {s.penalty}) end as margin "
            f"from g{r} g cross join (select tg as tg0, th as th0 from t{r}) left join b{r} b on true)",
        ]
    body = ", ".join(parts)
    return sql(f"select doc_id, round(1 / (1 + exp(-margin)), 6) as score from (with {body} select * from m{s.rounds}) where {hash_unit('doc_id')} >= 0.8", "docs")


@query("M07 M11", _stump_sql())
def boosted_stumps(spark, sf_dir):
    """Three rounds of second-order boosted stumps on documents, scores of the test documents."""
    train, test = _documents(spark, sf_dir)
    features, edges = list(_STUMP_EDGES), [[float(e) for e in es] for es in _STUMP_EDGES.values()]
    model = boosting.fit_boosted(train, features, "label", ["doc_id"], _STUMPS, edges=edges)
    return boosting.score_boosted(model, test, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


_BAGS = forest.ForestSettings(trees=3, depth=1, features_a_node=4, least_weight=5.0)


def _bag_sql() -> str:
    """Row weights of each tree, the weighted split that lowers the variance most, and the mean of two shares."""
    listed = ", ".join(f"('{f}', {i}, {c}, {e!r})" for i, (f, es) in enumerate(_STUMP_EDGES.items()) for c, e in enumerate(es))
    value = "case feature " + " ".join(f"when '{f}' then {f}" for f in _STUMP_EDGES) + " end"
    draw = f"cast(floor({hash_unit('doc_id', seed='draw-42')} * 2147483646) as bigint)"
    parts, scores = [f"cuts as (select * from (values {listed}) v(feature, place, cut, edge))"], []
    for t, m in enumerate(forest._multipliers(_BAGS)):
        drawn = " + ".join(f"cast(u >= {x!r}::double as integer)" for x in forest.TIMES)
        gain = "round(0.5 * (ly * ly / lw + (ty - ly) * (ty - ly) / (tw - lw) - ty * ty / tw), 9)"
        parts += [
            f"w{t} as materialized (select *, {drawn} as w from (select *, ({draw} * {m} % 2147483647) / 2147483647.0::double as u from train))",
            f"t{t} as (select sum(w * quality)::double as ty, sum(w)::double as tw from w{t})",
            f"l{t} as (select feature, place, cut, edge, sum(w * quality)::double as ly, sum(w)::double as lw from w{t}, cuts where {value} < edge group by all)",
            f"b{t} as materialized (select * from l{t}, t{t} where lw >= 5 and tw - lw >= 5 and {gain} > 0 order by {gain} desc, place, cut limit 1)",
            f"s{t} as (select doc_id, case when {value} < edge then ly / lw else (ty - ly) / (tw - lw) end as score from test, b{t})",
        ]
        scores.append(f"select * from s{t}")
    return sql(f"select doc_id, round(avg(score), 6) as score from (with {', '.join(parts)} {' union all '.join(scores)}) group by doc_id", "docs", test=_TEST, train=_TRAIN)


@query("M06 M11", _bag_sql())
def bagged_stumps(spark, sf_dir):
    """Three bagged stumps on documents, rows drawn by a hash of their key; scores of the test documents."""
    train, test = _documents(spark, sf_dir)
    edges = [[float(e) for e in es] for es in _STUMP_EDGES.values()]
    model = forest.fit_forest(train, list(_STUMP_EDGES), "label", ["doc_id"], _BAGS, edges=edges)
    return forest.score_forest(model, test, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@query("M06 M11 E01 E02 E03 E06")
def bagged_forest_study(spark, sf_dir):
    """The forest that does not depend on partitions, on the study: its test figures beside MLlib's."""
    train, test = _study(spark, sf_dir)
    train = materialise(train, "train")
    own = forest.score_forest(forest.fit_forest(train, MODEL_FEATURES, LABEL, ["GEO_ID", "year"]), test, [LABEL])
    fitted = models.fit(train, models.with_features(models.random_forest(LABEL), MODEL_FEATURES, None))
    both = {"by key": own, "by partition": models.score(fitted, test, [LABEL])}
    return functools.reduce(DataFrame.unionByName, [_figures(s).select(F.lit(n).alias("bags"), "*") for n, s in both.items()])


@query("M15 A17 A18 M14 M04 M05 M06")
def neighbor_count_sweep(spark, sf_dir):
    """Five-fold AUC of the study for 0 to 20 neighbours, then the base models with the best count.

    Rows with a ``model`` are refitted on all training rows with that count; their figures are those of the test rows.
    """
    base, upto = neighbor_sweep_tables(
        *study_tables(spark, sf_dir), 20, replace(MODEL_SETTINGS, neighbor_group=())
    )
    base = materialise(base, "base")
    train, test = dataset.hash_split(base, ["GEO_ID", "year"])
    train = materialise(dataset.fold_column(dataset.undersample(train, LABEL, ["GEO_ID", "year"]), ["GEO_ID", "year"], 5), "train")
    summaries = [f"n_{c}" for c in (*NEIGHBOR_MEANS, *NEIGHBOR_TOTALS)]
    scores = tuning.sweep_neighbors(
        upto, train, ["GEO_ID", "year"], OWN_FEATURES, summaries, range(21),
        lambda names: models.with_features(models.logistic_regression(LABEL), names), label=LABEL,
    )
    best = tuning.best_key(scores, "k", "auc").first()["best_k"]
    names = [*OWN_FEATURES, *(summaries if best else [])]

    def chosen(rows):
        return rows.join(upto.where(F.col("k") == best).drop("k"), ["GEO_ID", "year"]).na.drop(subset=names) if best else rows

    fitted, rows = materialise(chosen(train), "best-train"), materialise(chosen(test), "best-test")
    kinds = {
        "naive_bayes": (models.gaussian_naive_bayes(LABEL), "standard"),
        "logistic_regression": (models.logistic_regression(LABEL), "standard"),
        "random_forest": (models.random_forest(LABEL, trees=50), None),
    }
    out = scores.select("k", F.lit(None).cast("string").alias("model"), "auc", F.lit(None).cast("double").alias("precision_1"),
                        F.lit(None).cast("double").alias("recall_1"), (F.col("k") == best).alias("best"))
    for name, (estimator, scaling) in kinds.items():
        model = models.fit(fitted, models.with_features(estimator, names, scaling))
        figures = _figures(models.score(model, rows, [LABEL]))
        out = out.unionByName(figures.select(F.lit(best).alias("k"), F.lit(name).alias("model"), "auc", "precision_1", "recall_1", F.lit(True).alias("best")))
    return out


@query("M16 M08 A17 M06")
def penalty_sweep(spark, sf_dir):
    """All 25 published penalties on the study: survivors, five-fold AUC of a forest on them, and the best.

    The forest of the best penalty is refitted on its survivors; ``test_auc``, ``precision_1`` and
    ``recall_1`` are its figures on the test rows.
    """
    train, test = _study_folds(spark, sf_dir)
    sweep = materialise(tuning.sweep_alpha(train, MODEL_FEATURES, tuning.PENALTIES, label=LABEL), "penalties")
    best = sweep.agg(F.min_by(F.struct("alpha", "names"), F.struct(-F.col("auc"), "alpha")).alias("b")).first()["b"]
    names = best["names"].split(",")
    model = models.fit(train, models.with_features(models.random_forest(LABEL), names, None))
    figures = _figures(models.score(model, test, [LABEL])).select(
        F.lit(best["alpha"]).alias("alpha"), F.col("auc").alias("test_auc"), "precision_1", "recall_1"
    )
    marked = sweep.withColumn("best", F.col("alpha") == best["alpha"])
    return marked.join(F.broadcast(figures), "alpha", "left")


_LASSO_ALPHAS = ", ".join(map(str, tuning.PENALTIES))
#: Without the words, which nearly repeat the characters: there descent on SQL's side takes very many steps.
_LASSO_FEATURES = [c for c in DOCUMENT_FEATURES if c != "n_words"]
_Z = ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()" for c in _LASSO_FEATURES)


@query(
    "M08 M16",
    f"""with recursive {sql("", "docs").strip().removeprefix("with ")}, z as (
          select list_value({_Z}) as x, quality - avg(quality) over () as y from ({_TRAIN})),
        i as (select unnest(range(3)) as i),
        c as materialized (select list(row order by a) as c from (select a, list(v order by b) as row from (
          select p.i as a, q.i as b, avg(x[p.i + 1] * x[q.i + 1]) as v from z, i p, i q group by all) group by a)),
        m as materialized (select list(v order by i) as m from (select i, avg(x[i + 1] * y) as v from z, i group by i)),
        w(alpha, step, w) as (
          select unnest([{_LASSO_ALPHAS}]::double[]), 0, [0.0, 0.0, 0.0]::double[]
          union all
          select alpha, step + 1, list_transform(w, lambda v, k: case when k <> step % 3 + 1 then v else
            sign(m[k] - list_dot_product(c[k], w) + c[k][k] * v) * greatest(abs(m[k] - list_dot_product(c[k], w) + c[k][k] * v) - alpha, 0) / c[k][k] end)
          from w, c, m where step < 1500)
        select alpha, feature, round(weight, 6) as weight, weight <> 0 as kept from (
          select alpha, unnest({_LASSO_FEATURES!r}) as feature, unnest(w) as weight from w where step = 1500)""",
)
def lasso_path_documents(spark, sf_dir):
    """Weights of the document features for all published penalties, from one table of moments."""
    train, _ = _documents(spark, sf_dir)
    m = lasso_path.moments(train, _LASSO_FEATURES)
    return lasso_path.path_table(train, m, lasso_path.lasso_path(m, tuning.PENALTIES)).withColumn("weight", F.round("weight", 6))


@query(
    "M08 M16",
    f"select unnest([{_LASSO_ALPHAS}]::double[]) as alpha, true as optimal, {len(MODEL_FEATURES)} as features",
)
def lasso_path_study(spark, sf_dir):
    """The conditions of the minimum for every penalty and feature of the study, from its rows."""
    train, _ = _study(spark, sf_dir)
    train = materialise(train, "train")
    m = lasso_path.moments(train, MODEL_FEATURES, LABEL)
    held = lasso_path.optimality(train, m, lasso_path.lasso_path(m, tuning.PENALTIES), LABEL)
    return held.groupBy("alpha").agg(F.bool_and("optimal").alias("optimal"), F.count(F.lit(1)).cast("int").alias("features"))


@query("M17 M10 M12")
def network_grid(spark, sf_dir):
    """Grid over the width and depth of the network."""
    train, _ = _documents(spark, sf_dir)
    folded = dataset.fold_column(train, ["doc_id"], 2)
    shapes = [models.network_layers(len(DOCUMENT_FEATURES), base=b, depth=d) for b in (10, 20) for d in (1, 2, 3)]
    found = tuning.grid_search(
        folded, models.with_features(models.perceptron(shapes[0], rounds=10), DOCUMENT_FEATURES),
        {"layers": shapes}, folds=2, fold_col="fold",
    )
    rows = [{"layers": "-".join(map(str, s["layers"])), "auc": s["auc"]} for s in tuning.grid_scores(found)]
    return tuning.tabulate(spark, rows, "layers string, auc double")


#: Starting weights of the checked network: 4 inputs, 2 tanh units, 2 outputs; and its settings.
_NET_START = (
    [[0.4, -0.2], [-0.3, 0.1], [0.2, 0.5], [0.1, -0.4]], [0.1, -0.1], [[0.3, -0.5], [-0.2, 0.6]], [0.05, -0.05],
)
_NET = network.NetworkSettings(base=2, depth=1, activation="tanh", rate=0.8, epochs=3)


def _net_sql() -> str:
    """Forward pass, derivatives and mean gradients of every step, one column per weight."""
    n, (a, b, v, c) = len(DOCUMENT_FEATURES), _NET_START
    weights = {f"a{i}{j}": a[i][j] for i in range(n) for j in (0, 1)} | {f"b{j}": b[j] for j in (0, 1)}
    weights |= {f"v{j}{k}": v[j][k] for j in (0, 1) for k in (0, 1)} | {f"c{k}": c[k] for k in (0, 1)}
    slopes = {f"a{i}{j}": f"x{i} * e{j}" for i in range(n) for j in (0, 1)} | {f"b{j}": f"e{j}" for j in (0, 1)}
    slopes |= {f"v{j}{k}": f"h{j} * d{k}" for j in (0, 1) for k in (0, 1)} | {f"c{k}": f"d{k}" for k in (0, 1)}
    scaled = ", ".join(f"({f} - avg_{f}) / std_{f} as x{i}" for i, f in enumerate(DOCUMENT_FEATURES))
    parts = [
        f"z as (select doc_id, quality as y, {hash_unit('doc_id')} < 0.8 as training, {scaled} from docs, stats)",
        "p0 as (select " + ", ".join(f"{value!r}::double as {w}" for w, value in weights.items()) + ")",
    ]
    for t in range(_NET.epochs + 1):
        hidden = ", ".join("tanh(" + " + ".join(f"x{i} * a{i}{j}" for i in range(n)) + f" + b{j}) as h{j}" for j in (0, 1))
        out = ", ".join(f"1 / (1 + exp(-(h0 * v0{k} + h1 * v1{k} + c{k}))) as s{k}" for k in (0, 1))
        error = ", ".join(f"s{k} * (1 - s{k}) / (s0 + s1) - (y = {k})::integer * (1 - s{k}) as d{k}" for k in (0, 1))
        back = ", ".join(f"(d0 * v{j}0 + d1 * v{j}1) * (1 - h{j} * h{j}) as e{j}" for j in (0, 1))
        moved = ", ".join(f"any_value({w}) - {_NET.rate} * avg({slope}) as {w}" for w, slope in slopes.items())
        parts += [
            f"h{t} as (select *, {hidden} from z, p{t})",
            f"o{t} as (select *, {out} from h{t})",
            f"e{t} as (select *, {back} from (select *, {error} from o{t}))",
            f"p{t + 1} as materialized (select {moved} from e{t} where training)",
        ]
    stats = "select " + ", ".join(f"avg({f}) as avg_{f}, stddev_pop({f}) as std_{f}" for f in DOCUMENT_FEATURES) + " from train"
    body = f"select doc_id, round(s1 / (s0 + s1), 6) as score from (with {', '.join(parts)} select * from o{_NET.epochs}) where not training"
    return sql(body, "docs", train=_TRAIN, stats=stats)


@query("M09 M11", _net_sql())
def network_steps(spark, sf_dir):
    """Three steps of a small network along the mean gradient of all training documents; scores of the test documents."""
    train, test = _documents(spark, sf_dir)
    net = network.fit_network(train, DOCUMENT_FEATURES, "label", ["doc_id"], _NET, start=_NET_START)
    return network.score_network(net, test, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@query("M09 M10 M11 E01 E02 E03 E06")
def network_compared(spark, sf_dir):
    """The study's trial network (two layers, dropout, batch norm): trained on all rows, on a sample with early stopping, and MLlib's."""
    train, test = _study(spark, sf_dir)
    train, keys = materialise(train, "train"), ["GEO_ID", "year"]
    trial = network.NetworkSettings(base=10, depth=2, drop=0.01, norm_every=1)
    inner, outer = dataset.hash_split(train, keys, seed=7)
    s, o = (network.network_sample(r.withColumn("fold", F.lit(0)), MODEL_FEATURES, LABEL, keys, "fold", 4_000, trial.seed) for r in (inner, outer))
    fitted = {
        "all rows": network.fit_network(train, MODEL_FEATURES, LABEL, keys, replace(trial, rate=0.3, momentum=0.9, epochs=60)),
        "sample": network.fit_network_sample(s.x, s.y, s.draw, MODEL_FEATURES, trial, (o.x, o.y)),
    }
    scored = {n: network.score_network(net, test, [LABEL]) for n, net in fitted.items()}
    layers = models.network_layers(len(MODEL_FEATURES), base=10, depth=2)
    other = models.fit(train, models.with_features(models.perceptron(layers, LABEL, solver="l-bfgs", rounds=100), MODEL_FEATURES))
    scored["sigmoid units"] = models.score(other, test, [LABEL])
    return functools.reduce(DataFrame.unionByName, [_figures(r).select(F.lit(n).alias("network"), "*") for n, r in scored.items()])


@query("M17 M10 M12")
def network_tuning(spark, sf_dir):
    """All 72 points of the published network grid on the study: five folds, 200 epochs, area under ROC.

    Every fit takes all training rows outside its fold. The best point is fitted again on all training rows; ``test_auc``, ``precision_1`` and
    ``recall_1`` are its figures on the test rows.
    """
    train, test = _study_folds(spark, sf_dir)
    keys = ["GEO_ID", "year"]
    chosen, history = network.tune_network(train, MODEL_FEATURES, LABEL, keys)
    winner = network.fit_network_in_task(train, MODEL_FEATURES, LABEL, keys, chosen)
    figures = _figures(network.score_network(winner, test, [LABEL])).first()
    names = list(network.PUBLISHED_GRID)
    rows = [
        {**h, "best": best, **{n: figures[c] if best else None for n, c in (("test_auc", "auc"), ("precision_1", "precision_1"), ("recall_1", "recall_1"))}}
        for h in history for best in [all(h[n] == getattr(chosen, n) for n in names)]
    ]
    return tuning.tabulate(
        spark, rows, "base int, depth int, drop double, norm_every int, activation string, auc double, best boolean, "
        "test_auc double, precision_1 double, recall_1 double",
    )


@query("E01", sql("select label, prediction, count(*) as rows from scored group by all", "scored"))
def confusion_counts(spark, sf_dir):
    return metrics.confusion(scored_documents(spark, sf_dir))


@query(
    "E01",
    sql("""select label, count(*) filter (prediction = 0) as predicted_0, count(*) filter (prediction = 1) as predicted_1
           from scored group by label""", "scored"),
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored_documents(spark, sf_dir))


_CELLS = """select cast(count(*) filter (label = 1 and prediction = 1) as double) as tp,
  cast(count(*) filter (label = 0 and prediction = 1) as double) as fp,
  cast(count(*) filter (label = 1 and prediction = 0) as double) as fn,
  cast(count(*) filter (label = 0 and prediction = 0) as double) as tn from scored"""
_RATES = """select *, coalesce(tp / nullif(tp + fp, 0), 0) as p1, coalesce(tp / nullif(tp + fn, 0), 0) as r1,
  coalesce(tn / nullif(tn + fn, 0), 0) as p0, coalesce(tn / nullif(tn + fp, 0), 0) as r0,
  (tp + fn) / (tp + fp + fn + tn) as s1 from cells"""
_F = """select *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) as f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) as f0 from rates"""


@query(
    "E02 E03 E04 E05 E07",
    sql("""select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn,
                  round(p1, 6) as precision_1, round(r1, 6) as recall_1, round(p0, 6) as precision_0, round(r0, 6) as recall_0,
                  round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy,
                  round(s1 * p1 + (1 - s1) * p0, 6) as weighted_precision, round(s1 * r1 + (1 - s1) * r0, 6) as weighted_recall,
                  round(f1, 6) as f1_1, round(f0, 6) as f1_0, round(s1 * f1 + (1 - s1) * f0, 6) as weighted_f1
           from f""", "scored", cells=_CELLS, rates=_RATES, f=_F),
)
def class_metrics(spark, sf_dir):
    """Precision, recall, F1, weighted values and accuracy from one pass."""
    m = metrics.class_metrics(scored_documents(spark, sf_dir))
    return m.withColumns({c: F.round(c, 6) for c in m.columns if c not in ("tp", "fp", "fn", "tn")})


@query(
    "E06",
    sql("""select round((sum(case when label = 1 then r else 0 end) - p * (p + 1) / 2) / (cast(p as double) * n), 6) as auc from (
             select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r,
                    count(*) filter (label = 1) over () as p, count(*) filter (label = 0) over () as n from scored)
           group by p, n""", "scored"),
)
def area_under_roc(spark, sf_dir):
    """Exact AUC of the scores, ties counted half."""
    return metrics.area_under_roc(scored_documents(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


@query(
    "E06 M14",
    sql("""select lang, round((sum(case when label = 1 then r else 0 end) - p * (p + 1) / 2) / nullif(cast(p as double) * n, 0), 6) as auc from (
             select lang, label, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2.0::double as r,
                    count(*) filter (label = 1) over (partition by lang) as p, count(*) filter (label = 0) over (partition by lang) as n from scored)
           group by lang, p, n""", "scored"),
)
def area_under_roc_by_language(spark, sf_dir):
    """Exact AUC of every language, all in one job."""
    return metrics.area_under_roc_by(scored_documents(spark, sf_dir), ["lang"]).withColumn("auc", F.round("auc", 6))


@query(
    "E06",
    sql("""select round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) as auc from cells""",
        "scored", cells=_CELLS),
)
def area_under_roc_of_classes(spark, sf_dir):
    """AUC read off the hard predictions."""
    scored = scored_documents(spark, sf_dir)
    return metrics.area_under_roc(scored, score="prediction").withColumn("auc", F.round("auc", 6))


@query(
    "E07",
    sql("select round(avg(-ln(case when label = 1 then score else 1 - score end)), 6) as log_loss from scored", "scored"),
)
def log_loss(spark, sf_dir):
    return metrics.log_loss(scored_documents(spark, sf_dir)).withColumn("log_loss", F.round("log_loss", 6))


_SLICES = {
    "all": "true",
    "long_or_english": "(n_chars > 500 or lang = 'en')",
    "many_marks": "n_punct > 50",
    "both": "(n_punct > 50 and (n_chars > 500 or lang = 'en'))",
}


@query(
    "E08 F07 E02",
    sql(" union all ".join(
        f"""select '{name}' as slice, count(*) filter ({w} and label = 1 and prediction = 1) as tp,
              count(*) filter ({w} and label = 0 and prediction = 1) as fp,
              count(*) filter ({w} and label = 1 and prediction = 0) as fn,
              count(*) filter ({w} and label = 0 and prediction = 0) as tn,
              count(*) filter ({w} and label = 1 and prediction = 1)
                / nullif(cast(count(*) filter ({w} and prediction = 1) as double), 0) as precision,
              count(*) filter ({w} and label = 1 and prediction = 1)
                / nullif(cast(count(*) filter ({w} and label = 1) as double), 0) as recall from scored"""
        for name, w in _SLICES.items()), "scored"),
)
def slice_metrics(spark, sf_dir):
    """Metrics inside several predicates in one pass."""
    long_or_english = (F.col("n_chars") > 500) | (F.col("lang") == "en")
    many = F.col("n_punct") > 50
    return metrics.slice_metrics(scored_documents(spark, sf_dir), {
        "all": F.lit(True),
        "long_or_english": long_or_english,
        "many_marks": many,
        "both": many & long_or_english,
    })


@query(
    "E09 X08",
    sql("select prediction - label as residual, count(*) as rows, "
        + ", ".join(f"round(avg({c}), 4) as {c}_mean, round(stddev_samp({c}), 4) as {c}_std" for c in DOCUMENT_FEATURES)
        + " from scored group by 1", "scored"),
)
def residual_profile(spark, sf_dir):
    """Feature means and deviations per residual class."""
    p = metrics.residual_profile(scored_documents(spark, sf_dir), DOCUMENT_FEATURES)
    return p.withColumns({c: F.round(c, 4) for c in p.columns if c not in ("residual", "rows")})


@query(
    "E10 J10 F08",
    sql("""select doc_id, label, prediction, case when label = 1 and prediction = 1 then 'hit'
             when label = 1 then 'missed' else 'other' end as outcome from scored""", "scored"),
)
def outcome_classes(spark, sf_dir):
    """Outcome class per document, the data behind a map."""
    return metrics.outcome(scored_documents(spark, sf_dir).select("doc_id", "label", "prediction"))


@query(
    "A17",
    sql("select arg_min(lang, -rate * 1000000 + k) as best_lang, max(rate) as best_rate from (select lang, avg(quality) as rate, row_number() over (order by lang) as k from docs group by lang)", "docs"),
)
def best_group(spark, sf_dir):
    """Group with the best rate, the first one on a tie."""
    rates = profile.positive_rate(document_features(spark, sf_dir), ["lang"], "quality")
    return tuning.best_key(rates, "lang", "positive_rate").withColumnRenamed("best_positive_rate", "best_rate")


@query(
    "A18 M14",
    sql(f"""select round(avg(rate), 6) as mean_rate from (
              select cast(floor({hash_unit('doc_id', seed='fold-42')} * 5) as integer) as fold, avg(quality) as rate from docs group by 1)""", "docs"),
)
def mean_over_folds(spark, sf_dir):
    """Mean of a per-fold score, folds by key hash."""
    docs = dataset.fold_column(document_features(spark, sf_dir), ["doc_id"], 5)
    folds = docs.groupBy("fold").agg(F.avg("quality").alias("rate"))
    return folds.agg(F.round(F.avg("rate"), 6).alias("mean_rate"))

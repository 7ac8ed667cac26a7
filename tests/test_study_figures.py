"""Figures that the study queries report, recomputed by SQL over the score tables they come from."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cohortlens.plans import queries_models
from cohortlens.plans.study import LABEL, MODEL_FEATURES
from tools.compare import differences

SF = "/root/testdata/sf0.01"
AREA = f"""(select avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end)
            from scored a, scored b where a.{LABEL} = 1 and b.{LABEL} = 0)"""
CELLS = f"""count(*) filter ({LABEL} = 1 and prediction = 1) as tp, count(*) filter ({LABEL} = 0 and prediction = 1) as fp,
            count(*) filter ({LABEL} = 1 and prediction = 0) as fn, count(*) filter ({LABEL} = 0 and prediction = 0) as tn"""


def by_sql(scored: pd.DataFrame, text: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("scored", scored)
    return con.sql(text).df()


@pytest.fixture(scope="module")
def forest_scores(spark):
    return queries_models._forest_on_test(spark, SF)


@pytest.fixture
def held(monkeypatch, forest_scores):
    """The queries read the one stored score table that SQL reads too."""
    monkeypatch.setattr(queries_models, "_forest_on_test", lambda spark, sf_dir: forest_scores)
    return forest_scores.toPandas()


def test_slices(spark, held):
    got = entry.queries()["study_slices"](spark, SF).toPandas()
    slices = {
        "all": "true", "white_or_educated": "(race_white > w or n_ed_total > e)", "compact": "n_land_area < l",
        "both": "(race_white > w or n_ed_total > e) and n_land_area < l",
    }
    middle = "(select median(race_white) as w, median(n_ed_total) as e, median(n_land_area) as l from scored)"
    want = by_sql(held, " union all ".join(
        f"""select *, case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tp + fn > 0 then tp / (tp + fn) end as recall
            from (select '{n}' as slice, {CELLS} from scored, {middle} where {w})""" for n, w in slices.items()))
    assert differences(got, want) == "" and got.set_index("slice").loc["all", ["tp", "fp", "fn", "tn"]].sum() == len(held)


def test_outcomes(spark, held):
    got = entry.queries()["study_outcomes"](spark, SF).toPandas()
    want = by_sql(held, f"""select GEO_ID, {LABEL}, prediction, case when {LABEL} = 0 then 'other' when prediction = 1 then 'hit'
                            else 'missed' end as outcome from scored""")
    assert differences(got, want) == ""


def test_residual_profile(spark, held):
    got = entry.queries()["study_residuals"](spark, SF).toPandas().sort_values("residual").set_index("residual")
    figures = ", ".join(f"avg({c}) as {c}_mean, stddev_samp({c}) as {c}_std" for c in MODEL_FEATURES)
    want = by_sql(held, f"select prediction - {LABEL} as residual, count(*) as rows, {figures} from scored group by 1 order by 1").set_index("residual")
    assert set(got.columns) == set(want.columns)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, check_index_type=False, rtol=1e-9)


def test_figures_of_every_model(spark, monkeypatch):
    kept = []
    score = queries_models.models.score

    def keeping(model, rows, keep):
        stored = queries_models.materialise(score(model, rows, keep), "kept")
        kept.append(stored.toPandas())
        return stored

    monkeypatch.setattr(queries_models.models, "score", keeping)
    got = entry.queries()["study_model_figures"](spark, SF).toPandas()
    assert len(got) == len(kept) == len(queries_models._study_models())
    for (_, row), scored in zip(got.iterrows(), kept):
        want = by_sql(scored, f"select {CELLS}, {AREA} as auc from scored").iloc[0]
        assert [row[c] for c in ("tp", "fp", "fn", "tn")] == [want[c] for c in ("tp", "fp", "fn", "tn")]
        precision = want["tp"] / (want["tp"] + want["fp"]) if want["tp"] + want["fp"] else 0.0
        recall = want["tp"] / (want["tp"] + want["fn"])
        assert row["auc"] == pytest.approx(want["auc"]) and row["precision_1"] == pytest.approx(precision)
        assert row["recall_1"] == pytest.approx(recall) and row["accuracy"] == pytest.approx((want["tp"] + want["tn"]) / len(scored))
        assert row["f1_1"] == pytest.approx(2 * precision * recall / (precision + recall) if precision + recall else 0.0)

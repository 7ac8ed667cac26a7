"""Every registered query against its SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlens.plans.catalog import ENTRIES
from tools.compare import TABLES, differences

SF = "/root/testdata/sf0.001"
#: Large enough for groups that the ways for large groups really cut.
ORACLE_SF = "/root/testdata/sf0.01"
SLOW = {
    "logistic_study", "boosted_trees_study", "network_study", "lasso_features", "neighbor_count_sweep",
    "staged_tuning", "penalty_sweep", "network_grid", "forest_study", "study_model_figures", "boosted_trees_compared",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{ORACLE_SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, ORACLE_SF).toPandas()
    assert differences(got, duck.sql(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(ENTRIES) - set(entry.oracle_sql()) - SLOW))
def test_query_without_sql_yields_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[-1] == "gent" and df.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["feature_panel_rows", "tract_labels", "tract_neighbor_list", "study_model_matrix", "spending_cohort",
     "label_any_year", "nearest_points", "neighbor_means_strict", "area_under_roc", "undersampled_majority"],
)
def test_plans_have_no_python_rows_and_no_pair_products(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["positive_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text


def test_group_join_broadcasts_the_counted_statistics(spark):
    text = plan(entry.queries()["spending_cohort"](spark, SF))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_neighbour_ranking_is_trimmed_before_the_shuffle(spark):
    assert plan(entry.queries()["nearest_points"](spark, SF)).count("WindowGroupLimit") >= 2


def test_coverage_lists_every_inventory_group():
    covered = {c for e in ENTRIES.values() for c in e.covers}
    ranges = {"S": 11, "P": 12, "X": 11, "F": 10, "J": 10, "A": 18, "W": 2, "T": 3, "U": 5, "M": 18, "E": 11, "D": 4}
    missing = {f"{g}{i:02d}" for g, n in ranges.items() for i in range(1, n + 1)} - covered
    assert not missing, sorted(missing)

"""Look-ahead labels on hand-built panels with known answers."""

import pytest

from cohortlens.operators.lookahead import forward_max, lookahead_label

ROWS = [
    # id, year, per-capita income, median income
    ("A", 2010, 100.0, 1.0), ("A", 2011, 110.0, 5.0), ("A", 2013, 119.0, 15.0),
    ("B", 2010, 100.0, 1.0), ("B", 2011, 100.0, 5.0), ("B", 2012, 100.0, 30.0),
    ("C", 2010, 100.0, 1.0), ("C", 2013, 120.0, 1.0),
    ("D", 2010, 100.0, 1.0), ("D", 2014, 500.0, 99.0),
    ("E", 2010, 100.0, 1.0),
    ("F", 2010, 0.0, 1.0), ("F", 2011, 50.0, 1.0),
]
BENCHMARKS = [(2010, 10.0), (2011, 10.0), (2012, 14.0), (2013, 20.0), (2014, 50.0)]


def labels(spark, **options):
    panel = spark.createDataFrame([("s", *r) for r in ROWS], "state string, id string, year int, pci double, med double")
    marks = spark.createDataFrame([("s", *b) for b in BENCHMARKS], "state string, year int, benchmark double")
    out = lookahead_label(
        panel.filter("year = 2010"), panel, id="id", group=["state"], growth_col="pci",
        level_col="med", benchmarks=marks, **options,
    )
    return {r["id"]: r["label"] for r in out.collect()}


@pytest.mark.parametrize(
    "benchmark, match, expected",
    [
        ("future", "any", {"A": 0, "B": 1, "C": 1, "D": 0, "E": 0, "F": 0}),
        ("future", "first", {"A": 0, "B": 0, "C": 1, "D": 0, "E": 0, "F": 0}),
        ("base", "any", {"A": 1, "B": 1, "C": 1, "D": 0, "E": 0, "F": 0}),
        ("base", "first", {"A": 0, "B": 0, "C": 1, "D": 0, "E": 0, "F": 0}),
    ],
)
def test_known_labels(spark, benchmark, match, expected):
    assert labels(spark, benchmark=benchmark, match=match) == expected


def test_repeated_rows_do_not_change_labels(spark):
    panel = spark.createDataFrame(
        [("s", *r) for r in ROWS for _ in range(50)], "state string, id string, year int, pci double, med double"
    )
    marks = spark.createDataFrame([("s", *b) for b in BENCHMARKS], "state string, year int, benchmark double")
    cohort = panel.filter("year = 2010").distinct()
    out = lookahead_label(
        cohort, panel, id="id", group=["state"], growth_col="pci", level_col="med", benchmarks=marks
    )
    assert {r["id"]: r["label"] for r in out.collect()} == {"A": 0, "B": 1, "C": 1, "D": 0, "E": 0, "F": 0}


def test_unknown_option_is_refused(spark):
    with pytest.raises(ValueError):
        labels(spark, benchmark="past")


def test_forward_window_skips_gaps(spark):
    panel = spark.createDataFrame(ROWS, "id string, year int, pci double, med double")
    got = {(r["id"], r["year"]): r["forward_max"] for r in forward_max(panel, "id", "year", "pci").collect()}
    assert got[("A", 2010)] == 119.0 and got[("D", 2010)] is None and got[("C", 2013)] is None

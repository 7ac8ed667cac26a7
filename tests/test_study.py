"""The study on small count tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import flag, planar_distance, strict_sum, text_after, weighted_mean, without_last
from cohortlens.plans import derived_tables, study
from cohortlens.plans.study import (
    MODEL_FEATURES,
    StudySettings,
    feature_panel,
    model_matrix,
    typed_attributes,
    with_attributes,
)
from cohortlens.sources.schemas import ATTRIBUTE_SCHEMA, ATTRIBUTES, COUNT_SCHEMA
from tests.test_sources import count_row


def counts(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in COUNT_SCHEMA) for r in rows], COUNT_SCHEMA)


def attributes(spark, places):
    rows = []
    for geo, lat, lon, land in places:
        values = dict.fromkeys(ATTRIBUTES, "x") | {
            "GEOID10": geo, "INTPTLAT10": lat, "INTPTLON10": lon, "ALAND10": land,
        }
        rows.append(tuple(values[a] for a in ATTRIBUTES))
    return spark.createDataFrame(rows, ATTRIBUTE_SCHEMA)


def test_cleaning_rules(spark):
    rows = [
        count_row("06000000001", 2010, income=1),
        count_row("06000000002", 2010, income=0),
        count_row("06000000003", 2010, income=-666666666),
        count_row("06000000004", 2010, income=None),
        count_row("06000000005", 2010, B08301_001E=0),
    ]
    got = {r["GEO_ID"]: r for r in feature_panel(counts(spark, rows)).collect()}
    assert set(got) == {"06000000001", "06000000005"}
    assert got["06000000005"]["trans_walk"] is None
    assert got["06000000001"]["ed_total"] == pytest.approx(80 / 20)


def test_ratio_formulas(spark):
    row = count_row(
        "06000000001", 2010, B15002_019E=200, B15002_002E=100, B15002_032E=20, B15002_015E=5,
        B08301_001E=50, B08301_021E=5, B02001_001E=400, B02001_003E=100,
    )
    got = feature_panel(counts(spark, [row])).first()
    assert got["ed_total"] == pytest.approx((20 + 10 * 3 + 5 + 10 * 3) / 300)
    assert got["ed_fem"] == pytest.approx(50 / 200)
    assert got["ed_male"] == pytest.approx(35 / 100)
    assert got["trans_remote"] == pytest.approx(0.1) and got["race_black"] == pytest.approx(0.25)
    assert (got["med_house_inc"], got["per_cap_inc"], got["population"]) == (50_000, 10, 10)


def test_land_area_needs_64_bits(spark):
    got = typed_attributes(attributes(spark, [("06000000001", "+37.5", "-122.25", "9999999999999")])).first()
    assert (got["INTPTLAT10"], got["INTPTLON10"], got["ALAND10"]) == (37.5, -122.25, 9999999999999)


def test_inner_join_is_left_join_without_nulls(spark):
    panel = feature_panel(counts(spark, [count_row(f"0600000000{i}", 2010) for i in range(1, 4)]))
    places = attributes(spark, [("06000000001", "+37.5", "-122", "5"), ("06000000002", "bad", "-122", "5")])
    left = with_attributes(panel, places, "left")
    assert left.count() == 3
    assert with_attributes(panel, places).count() == left.na.drop().count() == 1


def test_matrix_of_a_small_state(spark):
    rng = np.random.default_rng(3)
    geos = [f"06{i:09d}" for i in range(30)]
    rows = [
        count_row(g, y, income=int(20_000 + 1_000 * i + 500 * (y - 2010) * (i % 3)),
                  B19301_001E=int(10_000 + 900 * (y - 2010) * (i % 4)))
        for i, g in enumerate(geos) for y in range(2010, 2017)
    ]
    places = [(g, f"{37 + rng.random():.6f}", f"{-122 + rng.random():.6f}", str(10_000 + i)) for i, g in enumerate(geos)]
    matrix = model_matrix(counts(spark, rows), attributes(spark, places), StudySettings(neighbors=5)).toPandas()
    assert list(matrix.columns) == ["GEO_ID", "state", *MODEL_FEATURES, "gent"]
    assert len(MODEL_FEATURES) == 27
    assert sorted(set(matrix["year"])) == list(range(2010, 2016))
    assert (matrix.groupby("year").size() >= 3).all()
    assert set(matrix["gent"]) == {0, 1}
    assert (matrix["n_population"] == 50).all()
    xy = {g: (float(a), float(b)) for g, a, b, _ in places}
    land = {g: int(v) for g, _, _, v in places}
    for _, r in matrix.iterrows():
        x, y = xy[r["GEO_ID"]]
        near = sorted(((x - a) ** 2 + (y - b) ** 2, g) for g, (a, b) in xy.items() if g != r["GEO_ID"])[:5]
        assert r["n_land_area"] == sum(land[g] for _, g in near)


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, 2.0, "a US b")], "a double, b double, c double, w double, t string")
    r = df.select(
        strict_sum(["a", "b"]).alias("s"), strict_sum(["a", "c"]).alias("t"),
        weighted_mean(["a", "c"], ["w", "w"]).alias("m"),
        planar_distance(F.col("a"), F.lit(0.0), F.col("a") + 3, F.lit(4.0)).alias("d"),
        text_after("t", "US").alias("after"), text_after("t", "XX").alias("absent"),
        without_last("t", 20).alias("empty"), flag(F.col("b") > 1).alias("f"),
    ).first()
    assert tuple(r) == (None, 4.0, 2.0, 5.0, " b", None, "", 0)


def test_neighbours_are_searched_in_base_years_only(spark, monkeypatch):
    stored, write = {}, study.materialise
    monkeypatch.setattr(study, "materialise", lambda df, label: stored.setdefault(label, write(df, label)))
    rows = [count_row(f"06{i:09d}", y, income=20_000 + 1_000 * i) for i in range(30) for y in range(2010, 2019)]
    places = [(f"06{i:09d}", f"{37 + i / 50}", "-122", "5") for i in range(30)]
    matrix = model_matrix(counts(spark, rows), attributes(spark, places), StudySettings(neighbors=5, max_base_year=2013))
    assert sorted(r["year"] for r in stored["located"].select("year").distinct().collect()) == [2010, 2011, 2012, 2013]
    assert sorted(r["year"] for r in matrix.select("year").distinct().collect()) == [2010, 2011, 2012, 2013]


def test_both_tables_come_from_one_pass_over_the_lines(spark, tmp_path):
    day = datetime.date
    lines = [(1, 1, "N", "O", 5.0, 100.5), (1, 2, "R", "F", 3.0, 50.0), (2, 1, "A", "O", 2.0, 70.9), (3, 4, None, "O", None, 10.0),
             (4, 2, "R", "O", 9.0, None), (None, 1, "N", "F", 1.0, 1.0), (5, 3, "R", "F", 30.0, 900.0), (5, 3, "R", "F", 30.0, 900.0)]
    orders = [(1, 7, day(1995, 5, 1)), (2, 7, day(1996, 1, 1)), (3, 7, None), (4, 8, day(1995, 2, 2)), (4, 8, day(1995, 2, 2)), (5, None, day(1997, 3, 3)), (5, 9, day(1997, 3, 3))]
    customer = [(7, "a", 1, 10.5), (8, "b", 2, -950.0), (8, "b", 2, 3.0), (9, "c", None, -1.25), (10, "d", 3, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customer, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = derived_tables.study_tables(spark, str(tmp_path))
    for table, plain in zip(got, (derived_tables.count_table, derived_tables.attribute_table)):
        want = plain(spark, str(tmp_path))
        assert table.dtypes == want.dtypes and want.count() > 2
        assert sorted(map(str, table.collect())) == sorted(map(str, want.collect()))
        assert not any("lineitem" in f for f in table.inputFiles())
    # What is joined and sorted per line has no text, and each status and flag keeps its own counts.
    assert not [c for c, t in derived_tables._lines(spark, str(tmp_path)).dtypes if t == "string"]
    seven = got[0].where("GEO_ID like '%7' and year = 1995").first()
    assert [seven[c] for c in ("B15002_019E", "B15002_002E", "B08301_003E", "B08301_004E", "B08301_010E", "B02001_002E")] == [1, 1, 1, 0, 1, 5]


def test_the_stored_panel_has_the_keys_that_later_steps_read(spark, monkeypatch):
    stored, write = {}, study.materialise
    monkeypatch.setattr(study, "materialise", lambda df, label: stored.setdefault(label, write(df, label)))
    rows = [count_row(f"06{i:09d}", y, income=20_000 + 1_000 * i) for i in range(30) for y in range(2010, 2019)]
    places = [(f"06{i:09d}", f"{37 + i / 50}", "-122", "5") for i in range(30)]
    for group in (("state",), ("state", "county")):
        model_matrix(counts(spark, rows), attributes(spark, places), StudySettings(neighbors=5, group=group))
        assert set(stored["panel"].columns) & set(study.PANEL_KEYS) == {"GEO_ID", "year", *group}
        stored.clear()

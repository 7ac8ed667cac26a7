"""Percentiles, cohorts and the joins below them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import bits_value, ordered_bits
from cohortlens.operators import cohort as cohort_module
from cohortlens.operators import scale
from cohortlens.operators.cohort import eligible_cohort, group_percentile


def groups(spark, rows):
    return spark.createDataFrame(rows, "g string, year int, v double")


@pytest.mark.parametrize(
    "top, p, threshold, members",
    [(11, 0.10, 20.0, [10.0, 20.0]), (11, 0.20, 30.0, [10.0, 20.0, 30.0]), (10, 0.10, 19.0, [10.0])],
)
def test_known_cohorts(spark, top, p, threshold, members):
    df = groups(spark, [("a", 2010, 10.0 * i) for i in range(1, top + 1)])
    assert group_percentile(df, ["g"], "v", p).first()["threshold"] == pytest.approx(threshold)
    chosen = eligible_cohort(df, ["g", "year"], "v", p).orderBy("v").collect()
    assert [r["v"] for r in chosen] == members


def test_base_year_limit(spark):
    df = groups(spark, [("a", y, float(v)) for y in (2015, 2016) for v in range(1, 12)])
    assert {r["year"] for r in eligible_cohort(df, ["g", "year"], "v", 0.1, max_year=2015).collect()} == {2015}


def test_every_group_keeps_at_least_its_share(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 900), "year": 2010, "v": rng.normal(size=900).round(1)})
    df = spark.createDataFrame(pdf)
    kept = eligible_cohort(df, ["g"], "v", 0.1).groupBy("g").count().toPandas().set_index("g")["count"]
    assert (kept.sort_index() >= 0.1 * pdf.groupby("g").size()).all()


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_searched_percentile_equals_built_in(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(cohort_module, "WHOLE_GROUP_ROWS", 1000)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(2)
    n = 40_000
    pdf = pd.DataFrame({
        # one group holds a third of all rows, another one is small
        "g": rng.choice(["hot", "warm", "cold", "small"], n, p=[0.4, 0.3, 0.29, 0.01]),
        "v": np.where(rng.random(n) < 0.3, 7.0, rng.normal(3, 100, n).round(2)),
    })
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("v") != 5.0, F.col("v")))
    wanted = {"p0": 0.0, "p10": 0.1, "p11": 0.11, "p50": 0.5, "p100": 1.0}
    got = group_percentile(df, ["g"], "v", wanted).orderBy("g").toPandas()
    want = group_percentile(df, ["g"], "v", wanted, method="hash").orderBy("g").toPandas()
    pd.testing.assert_frame_equal(got, want)
    whole = group_percentile(df, [], "v", wanted).toPandas()
    values = pdf["v"][pdf["v"] != 5.0]
    np.testing.assert_allclose(whole.to_numpy()[0], np.quantile(values, list(wanted.values())))


def test_searched_percentiles_of_every_small_size(spark):
    """Groups of 1 to 60 rows: runs of ties, one value only, both signs, several fractions at once."""
    rng = np.random.default_rng(3)
    rows = []
    for n in range(1, 61):
        rows += [(f"even {n}", n, float(i)) for i in range(n)]
        rows += [(f"ties {n}", n, float(x)) for x in rng.integers(-3, 3, n)]
        rows += [(f"same {n}", n, -1.5) for _ in range(n)]
        rows += [(f"wide {n}", n, float(x)) for x in rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)]
    fractions = {"p00": 0.0, "p10": 0.1, "p20": 0.2, "p33": 1 / 3, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p1": 1.0}
    df = groups(spark, rows)
    got = group_percentile(df, ["g", "year"], "v", fractions, whole_group_rows=0).orderBy("g", "year").toPandas()
    want = group_percentile(df, ["g", "year"], "v", fractions, method="hash").orderBy("g", "year").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=0, atol=0)
    assert group_percentile(df.limit(0), ["g"], "v", 0.5, whole_group_rows=-1).collect() == []
    nulls = groups(spark, [("a", 1, None), ("b", 1, 2.0), (None, 1, 4.0)])
    for method in ("exact", "hash"):
        found = group_percentile(nulls, ["g"], "v", 0.5, whole_group_rows=0, method=method).orderBy("g").collect()
        assert [tuple(r) for r in found] == [("a", None), ("b", 2.0)]


def test_ordered_bits_order_and_round_trip(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([
        rng.integers(-(2**63), 2**63 - 1, 3000).view("f8"), rng.normal(size=500), 2.0 ** np.arange(-1074, 1024),
        np.nextafter(2.0 ** np.arange(-1021, 1024), 0), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf, 2.2250738585072014e-308, 1.7976931348623157e308],
    ])
    values = values[~np.isnan(values)]
    frame = spark.createDataFrame(pd.DataFrame({"v": values})).withColumn("bits", ordered_bits(F.col("v")))
    out = frame.withColumn("back", bits_value(F.col("bits"))).toPandas()
    raw = out["v"].to_numpy().copy()
    raw[raw == 0] = 0.0
    plain = raw.view("i8")
    plain = np.where(plain < 0, -(plain & 0x7FFFFFFFFFFFFFFF), plain)
    assert (out["bits"].to_numpy() == plain).all() and (out["back"].to_numpy() == raw).all()
    odd = spark.range(1).select(ordered_bits(F.lit(float("nan"))).alias("a"), ordered_bits(F.lit(None).cast("double")).alias("b")).first()
    assert odd["a"] > plain.max() and odd["b"] is None


def test_salted_join_equals_plain_join(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7))
    stats = spark.range(6).withColumnRenamed("id", "k").withColumn("s", F.col("k") * 10)
    for how in ("inner", "left"):
        plain = sorted(map(tuple, left.join(stats, ["k"], how).select("id", "k", "s").collect()))
        salted = sorted(map(tuple, scale.salted_join(left, stats, ["k"], how).select("id", "k", "s").collect()))
        assert [tuple(map(str, r)) for r in salted] == [tuple(map(str, r)) for r in plain]


class FakeSession:
    """Just the settings ``shared_folder`` looks at."""

    def __init__(self, master, configured=None):
        self.master, self.folder = master, None
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext, self.applicationId = self, f"app-{id(self)}"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session():
    assert scale.shared_folder(FakeSession("spark://x", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        scale.shared_folder(FakeSession("spark://x"))
    local = FakeSession("local[2]")
    first = scale.shared_folder(local)
    assert first and scale.shared_folder(local) == first
    assert local.folder is None  # the session's own setting stays as it is


def test_materialised_table_is_pruned_by_partition(spark):
    df = spark.range(100).withColumn("part", (F.col("id") % 4).cast("int"))
    stored = scale.materialise(df, "t", ["part"])
    assert stored.columns == ["id", "part"]
    assert stored.filter("part = 3").count() == 25
    plan = stored.filter("part = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan

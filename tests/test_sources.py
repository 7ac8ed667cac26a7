"""Readers and writers."""

import json

from pyspark.sql import functions as F

from cohortlens.sources import tables as io
from cohortlens.sources.schemas import ATTRIBUTE_SCHEMA, ATTRIBUTES, COUNT_SCHEMA, MEASURES


def count_row(geo, year, income=50_000, **values):
    row = {m: 10 for m in MEASURES} | {"B01002_001E": 33.5, "B19013_001E": income} | values
    return {**row, "GEO_ID": f"1400000US{geo}", "NAME": geo, "state": geo[:2], "county": geo[2:5], "tract": geo[5:], "year": year}


def test_json_tables_follow_their_own_header(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([["a", "b"], ["1", "x"], ["2", None]], indent=1))
    (tmp_path / "two.json").write_text(json.dumps([["b", "a"], ["y", "3"]]))
    (tmp_path / "none.json").write_text(json.dumps([["a", "b"]]))
    got = io.read_json_tables(spark, str(tmp_path), ["a", "b", "absent"])
    assert sorted(map(tuple, got.collect())) == [("1", "x", None), ("2", None, None), ("3", "y", None)]


def test_json_rows_split_by_line(spark, tmp_path):
    table = [["a", "b"], ["1", "x [y]"], ["2", None], ["3", "p, [q]]"]]
    (tmp_path / "t.json").write_text("[" + ",\n".join(json.dumps(r) for r in table) + "]\n")
    got = io.read_json_rows(spark, str(tmp_path), ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [("1", "x [y]"), ("2", None), ("3", "p, [q]]")]


def test_packed_json_lines(spark, tmp_path):
    (tmp_path / "packed.json").write_text("\n".join(json.dumps([["a"], [str(i)]]) for i in range(5)))
    got = io.read_json_tables(spark, str(tmp_path), ["a"], one_per_file=False)
    assert sorted(r["a"] for r in got.collect()) == list("01234")


def test_count_files_round_trip_keeps_leading_zero(spark, tmp_path):
    rows = [count_row("06001400100", y) for y in (2010, 2011)] + [count_row("48001400100", 2010)]
    df = spark.createDataFrame([tuple(r[f.name] for f in COUNT_SCHEMA) for r in rows], COUNT_SCHEMA)
    io.write_csv(df, f"{tmp_path}/counts", ["state", "year"])
    back = io.read_counts(spark, f"{tmp_path}/counts").select(*COUNT_SCHEMA.names)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.filter("state = '06'").count() == 2


def test_types_are_text_unless_asked_for(spark, tmp_path):
    (tmp_path / "g.csv").write_text(",".join(ATTRIBUTES) + "\n" + ",".join(["06"] * len(ATTRIBUTES)) + "\n")
    assert io.read_attributes(spark, str(tmp_path)).schema == ATTRIBUTE_SCHEMA
    assert io.read_csv(spark, str(tmp_path)).first()["GEOID10"] == "06"
    assert io.read_csv(spark, str(tmp_path), infer=True).first()["GEOID10"] == 6


def test_state_and_year_from_file_names(spark, tmp_path):
    for state, year in (("06", 2010), ("48", 2011)):
        (tmp_path / f"census_{state}_{year}.csv").write_text("a\n1\n2\n")
    got = io.stamp_from_path(io.read_csv(spark, f"{tmp_path}/census_*", "a int"))
    assert sorted(map(tuple, got.collect())) == [(1, "06", 2010), (1, "48", 2011), (2, "06", 2010), (2, "48", 2011)]


def test_text_typed_by_schema(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    got = io.typed_by(df, spark.createDataFrame([], "a bigint, b double").schema)
    assert tuple(got.first()) == (1, None)


def test_stamp_and_combine(spark):
    one = io.stamp(spark.range(1), year=2010)
    two = spark.range(1).select(F.lit(2011).alias("year"), "id")
    assert sorted(map(tuple, io.combine([one, two]).collect())) == [(0, 2010), (0, 2011)]


def test_anchor_slice(spark):
    html = "<table>" + "".join(f'<a href="{i}">{i:02d}_STATE/</a>' for i in range(70)) + "</table>"
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    got = io.anchors(pages, "page_id", "html", 6, 51).orderBy("pos").collect()
    assert len(got) == 51 and got[0]["text"] == "05_STATE/" and got[0]["pos"] == 1
    assert io.anchors(pages, "page_id", "html").count() == 70


def test_files_split_by_row_count(spark, tmp_path):
    io.write_csv(spark.range(100).coalesce(1), f"{tmp_path}/out", rows_per_file=30)
    assert len(list((tmp_path / "out").glob("part-*"))) == 4
    assert io.read_csv(spark, f"{tmp_path}/out", "id bigint").count() == 100

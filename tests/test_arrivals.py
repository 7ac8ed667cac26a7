"""Files that arrive over time: the store equals a full run, and only parts that can change are written."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import arrivals
from cohortlens.sources.tables import write_csv

SCHEMA = "id string, state string, year int, value long"


def rows_of(spark, cells):
    return spark.createDataFrame([(f"e{i}", s, y, v) for s, y, vs in cells for i, v in enumerate(vs)], SCHEMA)


def deliver(df, folder):
    write_csv(df.withColumn("file", F.concat_ws("_", F.lit("census"), "state", "year")), folder, ["file"])


def panel(rows):
    return rows.where("value >= 0")


def best_later(rows):
    """Per entity and year the largest value of the next two years."""
    later = rows.select("id", "state", F.col("year").alias("y"), F.col("value").alias("v"))
    near = rows.join(later, ["id", "state"], "left").where("y is null or y between year and year + 2")
    return near.groupBy("id", "state", "year").agg(F.max(F.when(F.col("y") > F.col("year"), F.col("v"))).alias("best"))


def take(spark, inbox, store):
    return arrivals.take_arrivals(spark, [inbox], store, SCHEMA, panel, best_later, "best", 2)


def stored(spark, store):
    like = best_later(panel(rows_of(spark, [("06", 1, [1])])))
    return sorted(map(tuple, arrivals.read_parts(spark, f"{store}/best", like).collect()), key=str)


def files_under(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.startswith("part-")}


FIRST = [("06", y, [y % 7, 3 * y % 11, 5]) for y in range(2000, 2008)] + [("11", y, [y % 5, 4]) for y in range(2000, 2008)]


def full(spark, cells):
    return sorted(map(tuple, best_later(panel(rows_of(spark, cells))).collect()), key=str)


def test_deliveries_add_up_to_a_full_run(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    deliver(rows_of(spark, FIRST[:12]), f"{inbox}/a")
    assert take(spark, inbox, store) == list(range(1998, 2008))
    assert stored(spark, store) == full(spark, FIRST[:12])
    assert take(spark, inbox, store) == []
    before = files_under(store)
    deliver(rows_of(spark, FIRST[12:]), f"{inbox}/b")
    assert take(spark, inbox, store) == list(range(2002, 2008))
    assert stored(spark, store) == full(spark, FIRST)
    after = files_under(store)
    gone = {f for f in before if after.get(f) != before[f]}
    assert gone and all("/best/year=" in f and int(f.split("year=")[1][:4]) >= 2002 for f in gone)


def test_a_corrected_file_replaces_its_part(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    deliver(rows_of(spark, FIRST), f"{inbox}/a")
    take(spark, inbox, store)
    corrected = [(s, y, [90, 91] if (s, y) == ("06", 2004) else v) for s, y, v in FIRST]
    deliver(rows_of(spark, [("06", 2004, [90, 91])]), f"{tmp_path}/fresh")
    folder = f"{inbox}/a/file=census_06_2004"
    (new,) = [f for f in os.listdir(f"{tmp_path}/fresh/file=census_06_2004") if f.endswith(".csv")]
    (old,) = [f for f in os.listdir(folder) if f.endswith(".csv")]
    for name in os.listdir(folder):
        if name.endswith(".crc"):
            os.remove(f"{folder}/{name}")
    with open(f"{tmp_path}/fresh/file=census_06_2004/{new}") as source, open(f"{folder}/{old}", "w") as target:
        target.write(source.read())
    assert take(spark, inbox, store) == [2002, 2003, 2004]
    assert stored(spark, store) == full(spark, corrected)
    assert arrivals.read_manifest(spark, store).where("run = 2").count() == 1


def test_a_part_that_loses_all_rows_is_emptied(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    deliver(rows_of(spark, [("06", 2000, [1, 2]), ("06", 2001, [3, 4])]), f"{inbox}/a")
    take(spark, inbox, store)
    (path,) = [f"{d}/{f}" for d, _, fs in os.walk(f"{inbox}/a/file=census_06_2001") for f in fs if f.endswith(".csv")]
    for d, _, fs in os.walk(os.path.dirname(path)):
        for f in fs:
            if f.endswith(".crc"):
                os.remove(f"{d}/{f}")
    with open(path, "w") as f:
        f.write("id,state,year,value\ne0,06,2001,-1\n")
    assert take(spark, inbox, store) == [1999, 2000, 2001]
    assert stored(spark, store) == full(spark, [("06", 2000, [1, 2])])


def test_a_run_that_ended_half_way_is_repeated(spark, tmp_path, monkeypatch):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    deliver(rows_of(spark, FIRST), f"{inbox}/a")

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        arrivals.take_arrivals(spark, [inbox], store, SCHEMA, panel, fails, "best", 2)
    assert arrivals.read_manifest(spark, store).count() == 0
    take(spark, inbox, store)
    assert stored(spark, store) == full(spark, FIRST)


def test_rows_of_another_year_than_the_file_raise(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    wrong = rows_of(spark, [("06", 2000, [1])]).withColumn("file", F.lit("census_06_2003"))
    write_csv(wrong, f"{inbox}/a", ["file"])
    with pytest.raises(ValueError, match="other names"):
        take(spark, inbox, store)
    assert not arrivals.table_exists(spark, f"{store}/panel")


def test_names_without_state_and_empty_files_are_left_out(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    os.makedirs(inbox)
    open(f"{inbox}/notes.csv", "w").write("id,state,year,value\nx,06,2000,1\n")
    open(f"{inbox}/census_06_2000.csv", "w").close()
    assert take(spark, inbox, store) == []

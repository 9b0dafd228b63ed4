"""SQLite files: what is read back, which filters reach them, and what a failed write leaves."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from cueloom.sources import sqlite


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), F.col("id") % 13)).alias("name"), (F.col("id") / 4).alias("x")).repartition(3)
    sqlite.write_sqlite(rows, f"file://{tmp_path}/db", "t")
    return rows, str(tmp_path / "db")


def test_round_trip_and_overwrite(spark, folder):
    rows, path = folder
    assert len(os.listdir(path)) == 3 and all(f.startswith("part-") for f in os.listdir(path))
    back = sqlite.read_sqlite(spark, path, "t", 2)
    assert back.rdd.getNumPartitions() == 6 and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    sqlite.write_sqlite(rows.limit(5).coalesce(1), path, "t", "append")
    assert sqlite.read_sqlite(spark, path, "t").count() == 1005
    sqlite.write_sqlite(rows.limit(5).coalesce(1), path, "t")
    assert sqlite.read_sqlite(spark, path, "t").count() == 5 and len(os.listdir(path)) == 1


CASES = ["id > 990", "id >= 10 AND id < 12", "name = 'n3'", "name IS NULL AND id <= 21", "name IS NOT NULL AND x > 240.5", "id IN (1, 5, 7000)", "name LIKE 'n1%'", "NOT (id = 3) AND id < 6", "id % 100 = 3", "name <> 'n2' OR id = 4", "x = 2"]


@pytest.mark.parametrize("case", CASES)
def test_filters_change_no_answer(spark, folder, case):
    rows, path = folder
    assert sorted(map(tuple, sqlite.read_sqlite(spark, path, "t", push=True).where(case).collect()), key=str) == sorted(map(tuple, rows.where(case).collect()), key=str)


def test_filters_reach_the_file(spark, folder):
    """The reader takes what the file can answer; Spark filters by what it gives back."""
    _, path = folder
    back = sqlite.read_sqlite(spark, path, "t", push=True).where("id > 990 AND name = 'n3' AND id % 2 = 0")
    plan = back._jdf.queryExecution().executedPlan().toString()
    from pyspark.sql import datasource as ds
    from pyspark.sql.types import LongType, StringType, StructType

    reader = sqlite.PushingReader(sqlite.SqliteSource({"path": path, "table": "t"}), StructType().add("id", LongType()).add("name", StringType()))
    left = list(reader.pushFilters([ds.GreaterThan(("id",), 990), ds.EqualTo(("name",), "n3"), ds.StringEndsWith(("name",), "3"), ds.EqualTo(("id",), True), ds.EqualTo(("other",), 1)]))
    assert [sql for sql, _ in reader.where] == ['"id" > ?', '"name" = ?'] and len(left) == 3
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert got and all(i > 990 and n == "n3" for i, n in got)
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert filters and not any("> 990" in x for x in filters), plan


def test_stated_conditions(spark, folder):
    rows, path = folder
    stated = [("id", ">=", 10), ("id", "<", 500), ("name", "in", ["n3", "n4"]), ("x", ">", 3), ("name", "starts with", "n"), ("name", "is not null")]
    df = sqlite.read_sqlite(spark, path, "t", where=stated)
    want = rows.where("id >= 10 AND id < 500 AND name IN ('n3', 'n4') AND x > 3")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) and df.where("id = 3").count() == 0
    both = df.where("id < 100").unionByName(df.where("id >= 100"))  # one relation under two filters
    assert both.count() == want.count() == df.count()
    with pytest.raises(Exception, match="not a condition"):
        sqlite.read_sqlite(spark, path, "t", where=[("id", "=", "x")]).count()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select("id", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).cast("string").alias("s"))
    with pytest.raises(Exception):
        sqlite.write_sqlite(bad.repartition(3), str(tmp_path / "x"), "t", "append")
    assert not (tmp_path / "x").exists() or not [f for f in os.listdir(tmp_path / "x") if f.endswith(".db")]


def test_a_single_file_of_another_program(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "one.db")
    con.execute("CREATE TABLE jobs (id TEXT, n INTEGER, b BLOB)")
    con.executemany("INSERT INTO jobs VALUES (?, ?, ?)", [("a", 1, b"x"), ("b", None, None)])
    con.commit()
    con.close()
    df = sqlite.read_sqlite(spark, str(tmp_path / "one.db"), "jobs")
    assert [(r.id, r.n) for r in df.where("n IS NULL").collect()] == [("b", None)] and df.count() == 2
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, str(tmp_path / "one.db"), "nothing").count()

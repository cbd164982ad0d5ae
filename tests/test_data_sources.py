"""The content store and SQLite tables as data sources."""

import os
import sqlite3
import time
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sediment.sources import content_store, sqlite_tables


def names(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file())


def test_bodies_are_files_once(spark, tmp_path):
    bodies = [b"one", b"two", b"one", b"", "é".encode(), None, b"one"] * 3
    df = spark.createDataFrame([(b, ".txt" if b != b"two" else None) for b in bodies], "body binary, suffix string").repartition(5)
    content_store.store_bodies(df, str(tmp_path))
    want = sorted(f"{(h := sha256(b).hexdigest())[:2]}/{h}{'' if b == b'two' else '.txt'}" for b in {b for b in bodies if b is not None})
    assert names(tmp_path) == want and not (tmp_path / "_staging").exists()
    before = {n: os.stat(tmp_path / n).st_mtime_ns for n in want}
    content_store.store_bodies(df, f"file://{tmp_path}")
    assert {n: os.stat(tmp_path / n).st_mtime_ns for n in names(tmp_path)} == before
    back = {r.path: (r.n_bytes, bytes(r.body)) for r in content_store.stored_bodies(spark, str(tmp_path)).collect()}
    assert sorted(back) == [n for n in want if before[n] and (tmp_path / n).stat().st_size] and len(back) == 3 and all(len(b) == n and sha256(b).hexdigest() in p for p, (n, b) in back.items())


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    content_store.store_bodies(spark.createDataFrame([(b"old", ".x")], "body binary, suffix string"), str(tmp_path))
    before = names(tmp_path)
    df = spark.range(0, 200, 1, 8).withColumn("body", F.encode(F.col("id").cast("string"), "UTF-8"))
    fails = df.withColumn("suffix", F.when(F.col("id") == 150, F.raise_error(F.lit("broken row"))).otherwise(".x"))
    with pytest.raises(Exception, match="broken row"):
        content_store.store_bodies(fails, str(tmp_path))
    assert names(tmp_path) == before and not (tmp_path / "_staging").exists()
    time.sleep(3)  # tasks that were still at work have ended
    assert names(tmp_path) == before
    with pytest.raises(Exception, match="append"):
        df.write.format(content_store.FORMAT).mode("overwrite").option("path", str(tmp_path)).save()


ROWS = [(i, f"name {i % 7}" if i % 5 else None, i / 4, bytes([i % 256]), i % 2 == 0) for i in range(1000)]
SCHEMA = "id long, name string, amount double, raw binary, even boolean"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sqlite"))
    sqlite_tables.write_sqlite(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, "t")
    return path


def test_tables_go_and_come_back(spark, folder):
    assert len([n for n in os.listdir(folder) if n.endswith(".sqlite")]) == 3 and len(os.listdir(folder)) == 3
    got = sqlite_tables.read_sqlite(spark, folder, "t", SCHEMA, partitions=4)
    assert got.rdd.getNumPartitions() == 12
    assert sorted((r[0], r[1], r[2], bytes(r[3]), r[4]) for r in got.collect()) == ROWS
    found = sqlite_tables.read_sqlite(spark, folder, "t")
    assert dict(found.dtypes) == {"id": "bigint", "name": "string", "amount": "double", "raw": "binary", "even": "bigint"} and found.count() == 1000


def test_a_failed_table_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 400, 1, 8).withColumn("x", F.when(F.col("id") == 333, F.raise_error(F.lit("broken row"))).otherwise("x"))
    with pytest.raises(Exception, match="broken row"):
        sqlite_tables.write_sqlite(bad, str(tmp_path), "t")
    time.sleep(2)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("condition", ["id > 990", "id >= 10 and id < 20", "name = 'name 3'", "name in ('name 1', 'name 2') and amount <= 30.25", "name is null", "name is not null and length(name) = 6", "id = 5 or id = 7", "name <=> null"])
def test_filters_and_columns_are_sqlites(spark, folder, condition):
    got = sqlite_tables.read_sqlite(spark, folder, "t", "id long, name string, amount double").where(condition)
    want = spark.createDataFrame(ROWS, SCHEMA).select("id", "name", "amount").where(condition)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_filter_is_not_sparks_any_more(spark, folder):
    """What SQLite answers is no Filter of the plan, and no more rows than it finds leave the scan."""
    df = sqlite_tables.read_sqlite(spark, folder, "t", "id long").where("id > 990")
    reader = sqlite_tables.SqliteTables({"path": folder, "table": "t"}).reader(df.schema)
    from pyspark.sql.datasource import GreaterThan, StringContains

    kept = list(reader.pushFilters([GreaterThan(("id",), 990), StringContains(("name",), "x")]))
    assert [type(f).__name__ for f in kept] == ["StringContains"] and reader.where == ['"id" > ?'] and reader.values == [990]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan or "isnotnull" in plan and "> 990" not in plan.split("Filter (")[1].split("\n")[0]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 9


def test_other_tables(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "odd ""name" (k TEXT PRIMARY KEY, v) WITHOUT ROWID')
        c.execute("INSERT INTO \"odd \"\"name\" VALUES ('a', x'01'), ('b', NULL)")
        c.execute("CREATE TABLE empty (a INTEGER)")
        c.execute("CREATE TABLE sparse (a INTEGER PRIMARY KEY)")
        c.execute("INSERT INTO sparse VALUES (-5), (9000000000)")
    c.close()
    assert [(r.k, r.v and bytes(r.v)) for r in sqlite_tables.read_sqlite(spark, path, 'odd "name').orderBy("k").collect()] == [("a", b"\x01"), ("b", None)]
    assert sqlite_tables.read_sqlite(spark, path, "empty").collect() == []
    assert {r.a for r in sqlite_tables.read_sqlite(spark, path, "sparse").collect()} == {-5, 9000000000}
    with pytest.raises(Exception, match="no table"):
        sqlite_tables.read_sqlite(spark, path, "missing")
    with pytest.raises(ValueError, match="mounted"):
        sqlite_tables.local("s3://bucket/x.sqlite")

"""JDBC against an embedded database, filters that SQLite and DuckDB carry out, and loads that find nothing new."""

import os
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from brightcask.sources import catalog, readers, restore
from brightcask.sources.catalog import ForeignKey


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("derby")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{folder}/log")
    url = f"jdbc:derby:{folder}/db"
    db = spark._jvm.java.sql.DriverManager.getConnection(f"{url};create=true")
    does = db.createStatement()
    for s in (
        "create table store (id int primary key, label varchar(20) not null)",
        "create table sale (id bigint not null, day date not null, store_id int references store(id), price decimal(9,2), primary key (id, day))",
        "create table stg_raw (x int)",
        "create table empty_one (id int primary key)",
    ):
        does.execute(s)
    for i in range(3):
        does.execute(f"insert into store values ({i}, 's{i}')")
    for i in range(40):
        does.execute(f"insert into sale values ({i * i}, date('2024-01-{i % 28 + 1:02d}'), {i % 3}, {'null' if i == 7 else i / 4})")
    does.close()
    db.close()
    return url


def test_jdbc_catalog(spark, derby):
    columns, primary, foreign = readers.jdbc_tables(spark, derby)
    assert ("SALE", "PRICE", "DECIMAL", True) in columns and ("STORE", "LABEL", "VARCHAR", False) in columns
    assert primary == {"STORE": ["ID"], "SALE": ["ID", "DAY"], "STG_RAW": [], "EMPTY_ONE": ["ID"]} and foreign == [("SALE", "STORE_ID", "STORE", "ID")]
    source = catalog.jdbc_source(spark, "shop", derby)
    assert source.visible() == ["EMPTY_ONE", "SALE", "STORE"] and source.keys == [ForeignKey("SALE", "STORE_ID", "STORE", "ID")] and source.primary["SALE"] == ["ID", "DAY"]
    assert {r.column_name: r.data_type for r in catalog.columns(spark, source).filter("table_name = 'SALE'").collect()} == {"ID": "bigint", "DAY": "date", "STORE_ID": "int", "PRICE": "decimal(9,2)"}
    assert source.table(spark, "SALE").join(source.table(spark, "STORE").withColumnRenamed("ID", "STORE_ID"), "STORE_ID").count() == 40


def test_jdbc_is_read_in_parts(spark, derby):
    df = readers.jdbc(spark, derby, "SALE", partitions=5)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 40 and df.agg(F.sum("PRICE")).first()[0] == sum(i / 4 for i in range(40) if i != 7)
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 4
    by_day = readers.jdbc(spark, derby, "SALE", partitions=4, column="DAY")
    assert by_day.rdd.getNumPartitions() == 4 and by_day.count() == 40
    asked = readers.jdbc(spark, derby, "SALE", predicates=["STORE_ID = 0", "STORE_ID <> 0"])
    assert asked.rdd.getNumPartitions() == 2 and asked.count() == 40
    assert readers.jdbc(spark, derby, "EMPTY_ONE").count() == 0
    plan = df.filter("STORE_ID = 1").select("PRICE")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(STORE_ID,1)" in plan and "ReadSchema: struct<PRICE" in plan


def test_jdbc_round_trip(spark, derby):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k int, s string, x double")
    df.write.format("jdbc").options(url=derby, dbtable="BACK").mode("overwrite").save()
    assert sorted(map(tuple, readers.read(spark, "jdbc", url=derby, table="BACK").collect())) == [(1, "a", 1.5), (2, None, None)]


@pytest.mark.parametrize("kind", ["sqlite", "duckdb"])
def test_filters_are_carried_out_by_the_database(spark, tmp_path, kind):
    path = f"{tmp_path}/t.{kind}"
    with (sqlite3 if kind == "sqlite" else duckdb).connect(path) as db:
        db.execute("create table t (n bigint, s text, x double precision, b boolean)")
        db.executemany("insert into t values (?, ?, ?, ?)", [(i, f"Name {i}" if i % 3 else None, i / 2, i % 2 == 0) for i in range(50)])
    read = lambda *where: readers.read(spark, kind, where, path=path, table="t", partitions="2")
    rows = read().collect()
    cases = {
        "n > 10 and s like 'Name 1%'": [("n", ">", 10), ("s", "starts with", "Name 1")], "s is null": [("s", "is null")], "n in (1, 2, 99)": [("n", "in", [1, 2, 99])], "n <> 4 and x <= 2.5": [("n", "<>", 4), ("x", "<=", 2.5)],
        "s like '%ame 4%' and s is not null": [("s", "contains", "ame 4"), ("s", "is not null")], "x >= 24 and n < 49": [("x", ">=", 24), ("n", "<", 49)], "s = 'name 11'": [("s", "=", "name 11")], "b is null": [("b", "is null")],
    }
    for text, tests in cases.items():
        got = read(*tests)
        assert sorted(got.collect()) == sorted(spark.createDataFrame(rows, got.schema).filter(text).collect()), text
    source = (readers.SqliteSource if kind == "sqlite" else readers.DuckSource)({"path": path, "table": "t", "partitions": "2", "where": '[["n", ">", 10], ["n", "in", [11, 13, 40]], ["s", "starts with", "Name 1"]]'})
    reader = source.reader(read().schema)
    text, values = reader.query(readers.RowRange(0, 1000))
    assert text.endswith('where rowid between ? and ? and "n" > ? and "n" in (?, ?, ?) and substr("s", 1, 6) = ?') and values == [0, 1000, 10, 11, 13, 40, "Name 1"]
    assert sorted(n for p in reader.partitions() for b in reader.read(p) for n in b.to_pydict()["n"]) == [11, 13]
    whole, large = read(), read(("n", ">=", 40))
    assert whole.filter("n >= 40").union(whole.filter("n < 5")).count() == 15 and large.union(read(("n", "<", 5))).count() == 15 and large.filter("n < 45").union(large).count() == 15
    for test in (("b", "=", True), ("n", "=", "11"), ("n", "like", "1"), ("y", "=", 1), ("n", "in", [])):
        with pytest.raises(Exception, match="cannot be tested in the database"):
            read(test).collect()


def test_an_unchanged_source_is_not_loaded_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(100).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) as s", "array(id) as a", "map(id, 'x') as m", "named_struct('u', id) as n")
    assert restore.restored(df, path)
    before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)}
    assert not restore.restored(df.orderBy(F.desc("id")).repartition(5), path) and {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)} == before
    assert restore.restored(df.withColumn("s", F.coalesce("s", F.lit(""))), path) and spark.read.parquet(path).filter("s is null").count() == 0
    assert restore.restored(df.drop("m"), path) and restore.restored(df.drop("m").union(df.drop("m").limit(1)), path)
    swapped = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    assert restore.fingerprint(swapped) != restore.fingerprint(swapped.selectExpr("b as a", "a as b")) and restore.fingerprint(swapped.limit(0)).endswith("|0|0|0")

"""Kept profiles: what they say beside exact values, and which files are read for them."""

import os

from pyspark.sql import functions as F

from brightcask.plans import sketches


def part(spark, lo, hi, path, mode="append"):
    spark.range(lo, hi, numPartitions=1).select(F.col("id"), (F.col("id") % 1000 / 10).alias("x"), F.concat(F.lit("w"), F.col("id") % 77).alias("word"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("holes"), F.lit(None).cast("int").alias("none")).write.mode(mode).parquet(path)


def check(spark, got, n):
    rows = {r["name"]: r for r in got.collect()}
    near = lambda a, b, e: abs(a - b) <= e * b
    assert set(rows) == {"id", "x", "word", "holes", "none"} and all(r.n_rows == n for r in rows.values())
    assert rows["holes"].n_values == n * 4 // 5 and rows["none"].n_values == 0 and (rows["none"].least, rows["none"].median, rows["none"].n_distinct) == (None, None, 0)
    assert near(rows["id"].n_distinct, n, 0.03) and near(rows["x"].n_distinct, 1000, 0.03) and near(rows["word"].n_distinct, 77, 0.03)
    assert (rows["word"].least, rows["word"].most, rows["word"].median) == ("w0", "w9", None) and (float(rows["id"].least), float(rows["id"].most)) == (0, n - 1)
    assert all(abs(rows["id"][q] - p * n) <= 0.02 * n and abs(rows["x"][q] - p * 100) <= 2 for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))


def test_a_new_file_is_read_alone(spark, tmp_path):
    path, store = f"{tmp_path}/t", f"{tmp_path}/store"
    for k in range(4):
        part(spark, 5000 * k, 5000 * (k + 1), path)
    assert len(sketches.refresh(spark, "parquet", path, store)) == 4 and sketches.refresh(spark, "parquet", path, store) == []
    check(spark, sketches.profile(spark, "parquet", path, store), 20_000)
    before = set(os.listdir(path))
    part(spark, 20_000, 25_000, path)
    (new,) = [f for f in set(os.listdir(path)) - before if f.endswith(".parquet")]
    assert [os.path.basename(f) for f in sketches.refresh(spark, "parquet", path, store)] == [new]
    check(spark, sketches.profile(spark, "parquet", path, store), 25_000)
    assert spark.read.parquet(store).count() == 5 * 5
    os.remove(f"{path}/{new}")
    check(spark, sketches.profile(spark, "parquet", path, store), 20_000)
    assert sketches.refresh(spark, "parquet", path, store) == []


def test_profiles_of_parts_merge_to_that_of_the_whole(spark):
    df = spark.range(6000).selectExpr("id % 9 as part", "sqrt(id) as root", "array(id) as list", "date_add(date'2020-01-01', cast(id % 400 as int)) as day")
    whole, parts = ({r["name"]: r for r in sketches.merged(sketches.sketched(df, by)).collect()} for by in ([], [F.col("part")]))
    for name in ("part", "root", "list", "day"):
        assert (parts[name].n_rows, parts[name].n_values, parts[name].least, parts[name].most) == (whole[name].n_rows, whole[name].n_values, whole[name].least, whole[name].most)
        assert abs(parts[name].n_distinct - df.select(name).distinct().count()) <= 0.03 * df.select(name).distinct().count()
    assert sketches.merged(sketches.sketched(df.filter("false"))).first().n_rows == 0

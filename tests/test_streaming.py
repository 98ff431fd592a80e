from pyspark.sql import functions as F

from brightcask.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    source = events.stream(spark, str(tmp_path / "in"), batch.schema)
    events.drain(events.once(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.select("event_id").distinct().count()


def test_windowed_stream_closes_old_windows(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = events.windowed_counts(events.stream(spark, str(tmp_path / "in"), batch.schema), late="1 hour")
    events.drain(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    whole = events.windowed_counts(batch)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.join(whole, ["window_start", "event_type", "n_events"], "left_anti").count() == 0
    assert 0 < got.count() <= whole.count()

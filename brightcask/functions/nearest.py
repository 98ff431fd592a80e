"""Corrections: the value, or the column, that a mistyped word most likely meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edits(a: Column, b: Column) -> Column:
    """Edit distance in which one swap of neighbouring letters counts as one edit; exact up to two."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    some = lambda meets: F.when(F.length(a) > 1, F.exists(F.sequence(F.lit(1), F.length(a) - 1), meets)).otherwise(False)
    plain = F.levenshtein(a, b)
    swap_alone = (plain == 2) & (F.length(a) == F.length(b)) & some(lambda i: swapped(i) == b)  # a swap is two plain edits
    swap_and_edit = (plain == 3) & some(lambda i: F.levenshtein(swapped(i), b, 1) >= 0)
    return F.when(swap_alone | swap_and_edit, plain - 1).otherwise(plain)


def nearest_values(words: DataFrame, df: DataFrame, column: str, most: int = 2) -> DataFrame:
    """(word, meant, distance): for each word, the column's value within so many edits; none if two are as near.

    Words meet only values whose length is within so many letters of their own, by a join on the length; the column goes in as its distinct
    values. Words of up to four letters may have one edit.
    """
    values = df.select(F.col(column).cast("string").alias("meant")).filter("meant is not null").distinct().withColumn("size", F.length("meant"))
    asked = words.select("word").distinct().withColumn("size", F.explode(F.sequence(F.greatest(F.length("word") - most, F.lit(0)), F.length("word") + most)))
    limit = F.when(F.length("word") <= 4, 1).otherwise(most)
    near = asked.join(values, "size").withColumn("distance", edits(F.lower("word"), F.lower("meant")).cast("long")).filter(F.col("distance") <= limit)
    best = near.groupBy("word").agg(F.min("distance").alias("distance"))
    return near.join(best, ["word", "distance"]).groupBy("word", "distance").agg(F.min("meant").alias("meant"), F.count("*").alias("n")).filter("n = 1").select("word", "meant", "distance")

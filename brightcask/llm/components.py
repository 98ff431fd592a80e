"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """links: (u, v), in any direction, of any orderable type. Returns (u, v): every linked node but its component's smallest, v.

    Every step is two aggregations and joins over the links, which get fewer; the number of steps grows with the logarithm of the
    longest path. Steps end when the links stay the same.
    """
    at = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = None
    while True:
        now = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return at
        last = now
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        done, at = at, staged(small.filter("u <> v").distinct(), "small-star")
        dropped(done, near, large, least)

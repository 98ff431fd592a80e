"""Joins of two large tables by overlapping intervals, as equi-joins of bins.

An axis is cut into bins, on levels whose bins are each FACTOR times as wide as those of the level before. An interval belongs to the
first level whose bins are as wide as it is long, so it lies in two bins of it at most, however long it is. Two intervals meet on the
coarser of their levels: each is given its bins on its own level and on those coarser ones that the other side has. A pair is taken in
the first bin of its overlap alone, so it comes once, and no bin needs all pairs of its rows: the exact condition follows the join on the bin.

Where only sums over the rows met are asked for, sums_within makes no pairs: a sum over an interval is the difference of two running sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightcask.plans.ordering import numbered

#: Two bins of a level at most: the number of levels is that of the digits of the longest interval, in this base.
FACTOR = 4


def _levelled(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """(row, a, b, level) of the rows with an interval; a is not above b."""
    length = F.greatest(F.col("b") - F.col("a"), F.lit(0.0)) / F.lit(float(width))
    level = F.when(length <= 1, 0).otherwise(F.ceil(F.log(length) / math.log(FACTOR))).cast("int")
    level = F.when(F.pow(F.lit(float(FACTOR)), level) < length, level + 1).otherwise(level)  # a logarithm's last digit may be off
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), start.cast("double").alias("a"), end.cast("double").alias("b"))
    return rows.filter("a <= b").withColumn("level", level)


def _levels(df: DataFrame) -> set[int]:
    return {r.level for r in df.select("level").distinct().collect()}  # some thirty at most


def _binned(df: DataFrame, own: set[int], other: set[int], width: float) -> DataFrame:
    """df with (at, bin) for the row's own level and those coarser ones that the other side has, and each bin that the interval lies in."""

    def bins(n: int) -> Column:
        """Two of them at most, unless the level is too fine for the row, which then has none on it."""
        first, last = (F.floor(F.col(c) / (width * FACTOR**n)) for c in "ab")
        return F.when((F.col("level") == n) | (F.col("level") < n) & F.lit(n in other), F.transform(F.sequence(first, last), lambda k: F.struct(F.lit(n).alias("at"), k.alias("bin")))).otherwise(F.array())

    on = [bins(n) for n in sorted(own | other)]
    return df.select("*", F.inline(F.flatten(F.array(*on))))


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(l, r): the rows of left and right, as structs, whose closed intervals overlap, and whose columns in on are equal, if any are given.

    Spans are numbers; width is that of the finest bins, about the length of a usual interval. Rows without a span, or with an end before
    its start, meet nothing. A row that comes twice is met twice.
    """
    a, b = _levelled(left, *left_span, width), _levelled(right, *right_span, width)
    of_a, of_b = _levels(a), _levels(b)
    pick = lambda df, one, other, side: _binned(df, one, other, width).select(F.col("row").alias(side), F.col("a").alias(f"{side}a"), F.col("b").alias(f"{side}b"), F.col("level").alias(f"{side}level"), "at", "bin")
    met = pick(a, of_a, of_b, "l").alias("x").join(pick(b, of_b, of_a, "r").alias("y"), [F.col("x.at") == F.col("y.at"), F.col("x.bin") == F.col("y.bin"), *[F.col(f"l.`{c}`") == F.col(f"r.`{d}`") for c, d in on]])
    exact = (F.col("la") <= F.col("rb")) & (F.col("ra") <= F.col("lb"))
    once = (F.col("x.at") == F.greatest("llevel", "rlevel")) & (F.col("x.bin") == F.floor(F.greatest("la", "ra") / (F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), F.col("x.at")))))
    return met.filter(exact & once).select("l", "r")


def sums_within(centres: DataFrame, points: DataFrame, at: str, reach: int, sums: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """(*on, at, *sums): for each distinct (*on, at) of centres without nulls, the sums of these columns over the points whose on is equal and
    whose at is no further off than reach; 0 where there are none.

    Points are summed up by (*on, at) first, so those of one place, however many, are one row. Both ends of each interval lie among them in
    one order with running sums. Sums are to be whole numbers or decimals, for differences of doubles would depend on what comes before.
    """
    of = [*on, at]
    held = points.dropna(subset=of).groupBy(*of).agg(*[F.sum(c).alias(c) for c in sums]).withColumns({"_centre": F.col(at), "_end": F.lit(1)})
    ends = F.inline(F.array(*[F.struct((F.col(at) + d).alias("_at"), F.lit(e).alias("_end")) for d, e in ((-reach, 0), (reach, 2))]))  # before and behind the points of their place
    asked = centres.select(*of).dropna().distinct().select(*on, F.col(at).alias("_centre"), ends).withColumnRenamed("_at", at)
    running = numbered(held.unionByName(asked, allowMissingColumns=True), [*[(c, True) for c in of], ("_end", True)], "_number", sums={f"_{c}": c for c in sums})
    upto = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    return running.filter("_end <> 1").groupBy(*on, F.col("_centre").alias(at)).agg(*[F.sum(F.when(F.col("_end") == 2, upto(c)).otherwise(-upto(c))).alias(c) for c in sums])


def micros(ts: Column) -> Column:
    """A time as microseconds."""
    return F.unix_micros(ts.cast("timestamp"))

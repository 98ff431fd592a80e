"""Chart data as DataFrames: every transform runs over the whole result, and only the few finished marks are collected.

Null measures are left out of statistics and counts of bins; null categories are a category of their own. An empty input gives
no marks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH = 100_000  # accuracy of the sketch that narrows quantiles down
AGGREGATIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def bars(df: DataFrame, x: str, y: str, how: str = "sum", color: str | None = None, digits: int = 2) -> DataFrame:
    """(x[, color], y): one mark for each group. how = "none" takes y as it is: it is an aggregate already."""
    by = [x, *([color] if color else [])]
    if how == "none":
        return df.select(*by, y)
    return df.groupBy(*by).agg(F.round(AGGREGATIONS[how](y), digits).alias(y))


def nice_step(lo: Column, hi: Column, bins: int) -> Column:
    """1, 2 or 5 times a power of ten, such that at most bins steps cover lo to hi."""
    raw = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return power * F.when(raw / power <= 1, 1).when(raw / power <= 2, 2).when(raw / power <= 5, 5).otherwise(10)


def histogram(df: DataFrame, y: str, bins: int = 20) -> DataFrame:
    """(bin_start, bin_end, n) of non-empty bins with nice edges; extremes are one row, met by all."""
    ends = df.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi")).select(nice_step(F.col("_lo"), F.col("_hi"), bins).alias("_step"))
    counted = df.filter(F.col(y).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.floor(F.col(y) / F.col("_step")).alias("_bin"), "_step").agg(F.count("*").alias("n"))
    return counted.select((F.col("_bin") * F.col("_step")).alias("bin_start"), ((F.col("_bin") + 1) * F.col("_step")).alias("bin_end"), "n")


def quantiles(df: DataFrame, y: str, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(by, q0, q1 ...): exact quantiles, interpolated between the two values around each place; null values are left out. at ascends.

    A group may hold a third of all rows, so no task takes a group's values. A sketch tells for each place two values that it lies
    between, a few hundred-thousandths of the rows apart. Rows are then counted, between such values by value and elsewhere by stretch, in
    partial aggregates, and the running count over those few counts finds the places exactly.
    """
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for n, c in zip(names, by, strict=True)], F.col(y).cast("double").alias("_y")).filter("_y is not null")
    bound = lambda side: F.percentile_approx("_y", F.array(*[F.lit(min(1.0, max(0.0, p + side * 4 / SKETCH))) for p in at]), F.lit(SKETCH))
    ends = rows.groupBy(*names).agg(F.count("*").alias("_n"), bound(-1).alias("_lo"), bound(1).alias("_hi"))
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"e.{n}")) for n in names]
    met = rows.alias("r").join(ends.alias("e"), same) if names else rows.alias("r").crossJoin(F.broadcast(ends).alias("e"))  # without groups, one row
    above, over = (F.size(F.filter(c, lambda b: f(b))) for c, f in (("_lo", lambda b: b <= F.col("_y")), ("_hi", lambda b: b < F.col("_y"))))
    few = F.col("_n") <= SKETCH  # all counted by value
    counts = met.select(*[F.col(f"r.{n}") for n in names], "_n", F.when(few, 0).otherwise(above + over).alias("_zone"), F.when(few | (above > over), F.col("_y")).alias("_y")).groupBy(*names, "_n", "_zone", "_y").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_zone", "_y"))
    counts = counts.withColumn("_upto", upto)
    holds = lambda place: F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_y")))
    places = [F.lit(float(p)) * (F.col("_n") - 1) for p in at]
    sides = [c.alias(f"{n}{i}") for i, p in enumerate(places) for n, c in (("_a", holds(F.floor(p))), ("_b", holds(F.ceil(p))))]
    found = counts.groupBy(*names, "_n").agg(*sides)
    value = lambda i: F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (places[i] - F.floor(places[i]))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], *[value(i).alias(f"q{i}") for i in range(len(at))])


def scatter(df: DataFrame, x: str, y: str, bins: int = 30, points: int = 3, key: Sequence[str] = ()) -> DataFrame:
    """(x_bin, y_bin, n, place, x, y): a grid of cells with nice edges, how many rows each holds, and up to so many of them as points.

    The points of a cell are those whose key (else x and y) has the smallest MD5, so they are the same whatever the order of rows; each task
    passes on no more than so many of a cell. Marks are bounded by bins * bins * points, in both directions twice that many where edges
    are rounded; counts add up to all rows that have both values. x may be text, which has a column of cells for each value.
    """
    text = isinstance(df.schema[x].dataType, T.StringType)
    of = [F.col(f"`{x}`") if text else F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")]
    draw = F.md5(F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key or (x, y)]).cast("binary"))
    rows = df.select(of[0].alias("_x"), of[1].alias("_y"), draw.alias("_draw")).filter("_x is not null and _y is not null")
    low, high = (F.struct(*[f(c).alias(c) for c in ("_y",) if text] or [f("_x").alias("_x"), f("_y").alias("_y")]) for f in (F.min, F.max))
    ends = rows.agg(low.alias("lo"), high.alias("hi")).select(*[nice_step(F.col(f"lo.{c}"), F.col(f"hi.{c}"), bins).alias(f"{c}step") for c in (("_y",) if text else ("_x", "_y"))])
    cell = lambda c: F.floor(F.col(c) / F.col(f"{c}step")) * F.col(f"{c}step")
    placed = rows.crossJoin(F.broadcast(ends)).select((F.col("_x") if text else cell("_x")).alias("x_bin"), cell("_y").alias("y_bin"), "_x", "_y", "_draw")  # ends is one row
    counts = placed.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("x_bin", "y_bin").orderBy("_draw", "_x", "_y")
    drawn = placed.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= points)
    return drawn.join(counts, ["x_bin", "y_bin"]).select("x_bin", "y_bin", "n", F.col("place").cast("long").alias("place"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def boxplot(df: DataFrame, y: str, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Least, quartiles and most; whiskers reach the extremes."""
    found = quantiles(df, y, by, (0.0, 0.25, 0.5, 0.75, 1.0))
    return found.select(*by, *[F.round(f"q{i}", digits).alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))])


def given_boxes(df: DataFrame, x: str | None, columns: Mapping[str, str]) -> DataFrame:
    """The marks of a result that holds quartiles already: (x, least, q1, median, q3, most), as they are."""
    middle = columns.get("median", columns.get("avg"))
    at = {"least": columns.get("min", columns["q1"]), "q1": columns["q1"], "median": middle, "q3": columns["q3"], "most": columns.get("max", columns["q3"])}
    return df.select(*([x] if x else []), *[F.col(f"`{c}`").alias(n) for n, c in at.items()])


def shares(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """(x, y, share): parts of a whole. The total is one row of its own, so the groups stay spread."""
    parts = df.groupBy(x).agg(F.sum(y).alias("_y"))
    total = df.agg(F.sum(y).alias("_total"))  # one row
    return parts.crossJoin(F.broadcast(total)).select(x, F.round("_y", 2).alias(y), F.round(F.try_divide(F.col("_y"), F.col("_total")), digits).alias("share"))


def stack(df: DataFrame, x: str, y: str, color: str) -> DataFrame:
    """(x, color, y0, y1): the pieces of each bar from zero up, in order of color."""
    parts = df.groupBy(x, color).agg(F.sum(y).alias("_y"))
    top = F.sum("_y").over(Window.partitionBy(x).orderBy(F.asc_nulls_first(color)).rowsBetween(Window.unboundedPreceding, 0))
    return parts.select(x, color, F.round(top - F.col("_y"), 2).alias("y0"), F.round(top, 2).alias("y1"))


def fold(df: DataFrame, x: str, measures: Sequence[str]) -> DataFrame:
    """(x, series, value): wide measures as one long series, all of them."""
    return df.unpivot([x], list(measures), "series", "value")


def period(df: DataFrame, year: str, month: str, out: str = "period") -> DataFrame:
    """df with year and month as one date if every row's make one; as it is, without the column, if any row's do not."""
    valid = F.col(month).between(1, 12) & F.col(year).between(1, 9999)
    if not df.agg(F.coalesce(F.every(F.coalesce(valid, F.lit(False))), F.lit(True))).first()[0]:
        return df
    return df.withColumn(out, F.make_date(F.col(year).cast("int"), F.col(month).cast("int"), F.lit(1)))

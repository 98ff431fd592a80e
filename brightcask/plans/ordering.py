"""Window functions over a whole table in one order, without bringing it to one task.

A sample gives bounds that cut the order into parts of about equal size; a row's part follows from its own values. Rows and sums of each
part are counted by a partial aggregate, so every part knows what comes before it, and a window within each part does the rest: one
shuffle of the rows, by part. What reaches the driver is a sample of so many rows, and a row for each part.

Ranks, which rows of equal keys share, are found on the distinct keys with their counts and joined back, so a key that a third of all
rows has is counted in partial aggregates and split by adaptive execution where it is joined. Nulls come last in either direction.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample to a part.
SAMPLED = 48
Order = Sequence[tuple[str, bool]]  # columns, and whether ascending


def _sorted(order: Order) -> list[Column]:
    return [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order]


def _bounds(df: DataFrame, order: Order, parts: int) -> list[list[str | None]]:
    """The values, as text, at which parts begin after the first."""
    sample = df.select(*[F.col(f"`{c}`") for c, _ in order]).withColumn("_draw", F.xxhash64(F.monotonically_increasing_id(), F.lit(11))).orderBy("_draw").limit(SAMPLED * parts)
    rows = sample.orderBy(*_sorted(order)).select(*[F.col(f"`{c}`").cast("string") for c, _ in order]).collect()
    at = [rows[len(rows) * k // parts] for k in range(1, parts)] if rows else []
    return [list(b) for i, b in enumerate(at) if i == 0 or b != at[i - 1]]


def _part(df: DataFrame, order: Order, bounds: list[list[str | None]]) -> Column:
    """The number of bounds that are not after the row; found among every so many bounds, then among those between two of them."""
    if not bounds:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c, _ in order]
    bound = lambda b: F.struct(*[F.lit(v).cast(k).alias(f"v{i}") for i, (v, k) in enumerate(zip(b, kinds, strict=True))])
    step = math.isqrt(len(bounds)) or 1
    stretches = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def reached(b: Column) -> Column:
        out = F.lit(True)  # equal values: the row begins the part
        for i, (c, up) in reversed(list(enumerate(order))):
            own, its = F.col(f"`{c}`"), b[f"v{i}"]
            before = its < own if up else its > own
            out = F.when(own.isNull(), its.isNotNull() | out).when(its.isNull(), False).otherwise(before | ((its == own) & out))
        return out

    first = F.size(F.filter(F.array(*[bound(s[0]) for s in stretches]), reached))
    inner = F.get(F.array(*[F.array(*map(bound, s)) for s in stretches]), F.greatest(first - 1, F.lit(0)))
    return F.when(first == 0, 0).otherwise((first - 1) * step + F.size(F.filter(inner, reached)))


def numbered(df: DataFrame, order: Order, row_number: str = "row_number", ntiles: Mapping[str, int] | None = None, sums: Mapping[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """df with the row's number in the order from 1, and by name: ntiles, the tile of so many; sums, the running sum of a column up to the row.

    The order's columns together should tell rows apart; rows that are equal in all of them follow each other in any order, and lie in one part.
    """
    ntiles, sums = ntiles or {}, sums or {}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, order, parts)
    cut = df.withColumn("_part", _part(df, order, bounds))
    held = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(sums.values()) for x in (F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(f"s{i}"), F.count(f"`{c}`").alias(f"c{i}"))]).orderBy("_part").collect()  # a row per part
    before, total, upto = {}, 0, [0] * 2 * len(sums)
    for r in held:
        before[r["_part"]] = (total, *upto)
        total, upto = total + r.n, [u + r[f"{'sc'[i % 2]}{i // 2}"] for i, u in enumerate(upto)]
    offset = lambda i, kind: F.get(F.array(*[F.lit(str(before.get(p, (0,) * (2 * len(sums) + 1))[i])).cast(kind) for p in range(len(bounds) + 1)]), F.col("_part"))
    of = Window.partitionBy("_part").orderBy(*_sorted(order))
    out = cut.withColumn(row_number, F.row_number().over(of) + offset(0, "long"))
    upto_row = of.rowsBetween(Window.unboundedPreceding, 0)
    for i, (name, c) in enumerate(sums.items()):
        own = F.sum(f"`{c}`").over(upto_row)
        kind = cut.select(F.sum(f"`{c}`")).schema[0].dataType
        out = out.withColumn(name, F.when(own.isNotNull() | (offset(2 * i + 2, "long") > 0), F.coalesce(own, F.lit(0)) + offset(2 * i + 1, kind)))
    for name, k in ntiles.items():
        out = out.withColumn(name, tile(F.col(row_number), total, k))
    return out.drop("_part")


def tile(number: Column, total: int, tiles: int) -> Column:
    """The tile of a row's number; the first tiles have one row more where they are not all of one size."""
    size, more = divmod(total, tiles)
    at, large = number - 1, (size + 1) * more
    return F.when(at < large, F.floor(at / (size + 1)) + 1).otherwise(more + F.floor((at - large) / max(size, 1)) + 1).cast("long")


def ranked(df: DataFrame, order: Order, rank: str | None = None, dense_rank: str | None = None, percent_rank: str | None = None, cume_dist: str | None = None, parts: int | None = None) -> DataFrame:
    """df with those of these that are named: ranks in the order, which rows that are equal in its columns share."""
    keys = [c for c, _ in order]
    counts = numbered(df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias("_n")), order, "_dense", sums={"_upto": "_n"}, parts=parts)
    total = F.lit(df.count())
    first = F.col("_upto") - F.col("_n") + 1
    made = {rank: first, dense_rank: F.col("_dense"), percent_rank: F.when(total > 1, (first - 1) / (total - 1)).otherwise(F.lit(0.0)), cume_dist: F.col("_upto") / total}
    named = counts.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], *[v.alias(n) for n, v in made.items() if n])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])

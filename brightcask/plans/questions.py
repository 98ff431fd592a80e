"""Questions over a source: measure, dimensions, filters, time grain, top. They become one DataFrame each.

Joins follow foreign keys from the measure's table to the tables of dimensions and filters. Each is to a parent, so no row is counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightcask.plans.profile import ORIGIN
from brightcask.plans.transforms import AGGREGATIONS
from brightcask.sources.catalog import ForeignKey, Source, join_path


class AmbiguousQuestion(ValueError):
    """The source has no way to answer the question as it is put."""


@dataclass(frozen=True)
class Measure:
    name: str
    table: str
    expression: str = "1"
    how: str = "count"
    unit: str | None = None


@dataclass(frozen=True)
class Question:
    measures: Sequence[Measure]
    by: Sequence[tuple[str, str]] = ()  # (table, column)
    filters: Sequence[tuple[str, str]] = ()  # (table, SQL condition)
    grain: tuple[str, str, str] | None = None  # (table, column, month or another unit of date_trunc)
    having: str | None = None
    above_average: bool = False
    top: int | None = None
    digits: int = 2
    raw: bool = False  # the measures' rows themselves, as distributions and comparisons of single things need them


def grained(q: Question, intent: str) -> Question:
    """The question at the grain that its intent needs: distributions and correlations look at rows, not at sums of them."""
    return replace(q, raw=True, having=None, above_average=False) if intent in ("boxplot", "histogram", "distribution", "correlation") else q


def ask(spark: SparkSession, source: Source, keys: Sequence[ForeignKey], q: Question) -> DataFrame:
    """The answer as a DataFrame. Rows are summed up by the keys that lead out of the measures' table before they are joined to its parents."""
    start = q.measures[0].table
    if any(m.table != start for m in q.measures):
        raise AmbiguousQuestion("measures of one question come from one table")
    needed = [t for t, _ in (*q.by, *q.filters)] + ([q.grain[0]] if q.grain else [])
    ways = {goal: join_path(list(keys), start, goal) for goal in dict.fromkeys(needed)}
    if unreached := [goal for goal, way in ways.items() if way is None]:
        raise AmbiguousQuestion(f"no keys lead from {start} to {unreached[0]}")
    df, joined, early = _filtered(spark, source, start, q), {start}, not q.raw and any(ways.values())
    if early:
        own = [c for t, c in q.by if t == start] + ([q.grain[1]] if q.grain and q.grain[0] == start else [])
        out = [way[0].column for way in ways.values() if way]
        df = df.groupBy(*dict.fromkeys([*own, *out])).agg(*[c for i, m in enumerate(q.measures) for c in _parts(m, i)])
    for way in ways.values():
        for fk in way:
            if fk.parent not in joined:
                df = df.join(_filtered(spark, source, fk.parent, q), F.col(fk.column) == F.col(fk.parent_column))
                joined.add(fk.parent)
    if q.raw:
        out = df.select(*[_noted(F.col(c), c, t, c) for t, c in q.by], *[_noted(F.round(F.expr(m.expression), q.digits), m.name, m.table, m.expression, "none", m.unit) for m in q.measures])
        return out.orderBy(F.desc(q.measures[0].name), *[c for _, c in q.by]).limit(q.top) if q.top else out
    groups: list[Column] = [_noted(F.col(c), c, t, c) for t, c in q.by]
    if q.grain:
        groups.append(_noted(F.date_trunc(q.grain[2], q.grain[1]).cast("timestamp_ntz"), q.grain[2], q.grain[0], q.grain[1]))
    out = df.groupBy(*groups).agg(*[_aggregate(m, q.digits, _whole(m, i) if early else AGGREGATIONS[m.how](F.expr(m.expression))) for i, m in enumerate(q.measures)])
    first = q.measures[0].name
    if q.having:
        out = out.filter(q.having)
    if q.above_average:
        out = out.withColumn("_mean", F.avg(first).over(Window.partitionBy())).filter(F.col(first) > F.col("_mean")).drop("_mean")  # one row for each group
    return out.orderBy(F.desc(first), *[c for _, c in q.by]).limit(q.top) if q.top else out


def _parts(m: Measure, i: int) -> list[Column]:
    """What a group's rows come to before the joins, from which _whole makes the measure."""
    value = F.expr(m.expression)
    if m.how == "avg":
        return [F.sum(value).alias(f"_m{i}"), F.count(value).alias(f"_n{i}")]
    return [AGGREGATIONS[m.how](value).alias(f"_m{i}")]


def _whole(m: Measure, i: int) -> Column:
    if m.how == "avg":
        return F.try_divide(F.sum(f"_m{i}"), F.sum(f"_n{i}"))
    return AGGREGATIONS["sum" if m.how == "count" else m.how](f"_m{i}")


def _filtered(spark: SparkSession, source: Source, table: str, q: Question) -> DataFrame:
    df = source.table(spark, table)
    for t, condition in q.filters:
        if t == table:
            df = df.filter(condition)
    return df


def _aggregate(m: Measure, digits: int, value: Column) -> Column:
    return _noted(value if m.how == "count" else F.round(value, digits), m.name, m.table, m.expression, m.how, m.unit)


def _noted(value: Column, name: str, table: str, expression: str, how: str | None = None, unit: str | None = None) -> Column:
    """value by its name, with a note of where it comes from that goes along with the column, whatever is filtered, sorted or joined after."""
    return value.alias(name, metadata={ORIGIN: {k: v for k, v in (("table", table), ("expression", expression), ("how", how), ("unit", unit)) if v is not None}})

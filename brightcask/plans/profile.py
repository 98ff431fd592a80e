"""What a result's columns are: type, role, periodicity, how they may be summed up; and one pass of statistics over the rows.

Roles go by type first and whole words of the name second: a number named update_count is a measure, though "date" is in it.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and stems that name time, free text and periods. They must be these, for column names rely on them.
TIME_WORDS = ("date", "time", "month", "year", "day", "week", "quarter", "decade")
TIME_STEMS = ("дата", "время", "месяц", "год", "день", "недел", "квартал", "десятилет")
TEXT_STEMS = ("description", "comment", "note", "описан", "коммент")
PERIODS = (("day", "day"), ("день", "day"), ("week", "week"), ("недел", "week"), ("month", "month"), ("месяц", "month"), ("quarter", "quarter"), ("квартал", "quarter"), ("decade", "year"), ("десятилет", "year"), ("year", "year"), ("год", "year"))
#: Further words for time, and names that say a number is an aggregate already.
MORE_TIME = ("ts", "timestamp", "weekday", "hour")
AGGREGATES = re.compile(r"^(count|sum|avg|mean|min|max|total|n)_|_(count|sum|avg|total)$")


@dataclass(frozen=True)
class FieldProfile:
    name: str
    kind: str  # number, string, date, datetime, boolean, unknown
    role: str  # measure, dimension, time, id, text
    periodicity: str | None
    aggregations: tuple[str, ...]
    default: str


def words(name: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-zа-яё]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()) if w]


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.ArrayType, T.StructType)):
        return "string"
    return "unknown"


def role_of(name: str, kind: str) -> str:
    ws = words(name)
    if ws and (ws[0] in ("id", "uuid") or ws[-1] in ("id", "uuid", "key") or ws[-1].endswith("key")):
        return "id"
    named_time = any(w in TIME_WORDS + MORE_TIME or w.startswith(TIME_STEMS) for w in ws)
    if kind in ("date", "datetime") or (named_time and kind == "string") or (kind == "number" and ws and (ws[-1] in TIME_WORDS + MORE_TIME or ws[-1].startswith(TIME_STEMS))):
        return "time"
    if kind == "number":
        return "measure"
    if any(w.startswith(TEXT_STEMS) for w in ws):
        return "text"
    return "dimension"


def periodicity_of(name: str) -> str | None:
    return next((p for w in words(name) for stem, p in PERIODS if w.startswith(stem)), None)


def field_profile(field: T.StructField, derived: bool | None = None) -> FieldProfile:
    """derived: whether the column is an aggregate already, which must not be summed up again; by its name if not given."""
    kind = kind_of(field.dataType)
    role = role_of(field.name, kind)
    derived = bool(AGGREGATES.search(field.name)) if derived is None else derived
    if role == "measure":
        allowed, default = (("none",), "none") if derived else (("sum", "avg", "min", "max", "count"), "sum")
    elif role == "time":
        allowed, default = ("min", "max", "count"), "none"
    else:
        allowed, default = ("count",), "count"
    return FieldProfile(field.name, kind, role, periodicity_of(field.name) if role == "time" else None, allowed, default)


#: The key in a column's metadata under which a question notes where the column comes from: table, expression and how it was summed up.
ORIGIN = "origin"


def origin(field: T.StructField) -> dict:
    """What is noted of a column's origin; nothing if it did not come from a question."""
    return dict((field.metadata or {}).get(ORIGIN, {}))


def profiles(df: DataFrame) -> list[FieldProfile]:
    """The profile of each column. What a question has noted goes before what a name looks like: a sum is a sum by whatever name, and a raw value is none."""
    return [field_profile(f, origin(f)["how"] != "none" if "how" in origin(f) else None) for f in df.schema.fields]


# Names of columns that are statistics already, by words and their beginnings.
STATISTIC_WORDS = {
    "q1": ("q1", "p25", "percentile_25", "percentile25", "quartile_1", "нижний_квартиль", "первый_квартиль"),
    "median": ("median", "q2", "p50", "percentile_50", "percentile50", "медиана"),
    "avg": ("avg", "average", "mean", "среднее", "средний", "средняя"),
    "q3": ("q3", "p75", "percentile_75", "percentile75", "quartile_3", "верхний_квартиль", "третий_квартиль"),
    "min": ("min", "minimum", "least", "минимум", "минимальный"),
    "max": ("max", "maximum", "most", "максимум", "максимальный"),
}


def statistic_of(name: str) -> str | None:
    """Which statistic a column's name says that it is, by whole words."""
    padded = f"_{'_'.join(words(name))}_"
    return next((stat for stat, forms in STATISTIC_WORDS.items() if any(f"_{f}_" in padded for f in forms)), None)


def statistic_fields(names: list[str]) -> dict[str, str]:
    """By statistic: the first column that is one. Empty unless both quartiles and a middle are there, which a box plot needs."""
    found: dict[str, str] = {}
    for n in names:
        if stat := statistic_of(n):
            found.setdefault(stat, n)
    return found if {"q1", "q3"} <= found.keys() and {"median", "avg"} & found.keys() else {}


def statistics(df: DataFrame) -> DataFrame:
    """(name, n_rows, n_values, n_distinct, least, most) for each column; least and most are text.

    Each column is counted by value, reading that column alone, and the counts are summed up: partial aggregates all along, so exact
    distinct counts multiply no rows and keep no set of values.
    """
    zero = F.lit(0).cast("long")

    def of(f: T.StructField) -> DataFrame:
        column = F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
        values = df.groupBy(column.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        known = F.col("v").isNotNull()
        return values.agg(F.lit(f.name).alias("name"), F.coalesce(F.sum("n"), zero).alias("n_rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), zero).alias("n_values"), F.count_if(known).alias("n_distinct"), F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("most"))

    return functools.reduce(DataFrame.unionByName, map(of, df.schema.fields))


def sniffed(df: DataFrame) -> DataFrame:
    """(name, kind): what the values of text columns are: date, datetime, number or string; unknown if there is none."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    every = lambda c, p: F.every(F.col(f"`{c}`").rlike(p))
    kind = lambda c: (
        F.when(F.count(F.col(f"`{c}`")) == 0, "unknown").when(every(c, r"^\d{4}(-\d{2}(-\d{2})?)?$"), "date").when(every(c, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"), "datetime").when(every(c, r"^[+-]?\d+(\.\d+)?$"), "number").otherwise("string")
    )
    return df.agg(F.array(*[F.struct(F.lit(c).alias("name"), kind(c).alias("kind")) for c in text]).alias("all")).select(F.inline("all"))

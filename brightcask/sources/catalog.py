"""Data sources as namespaces of lazily read tables, with keys found by their names and as inclusions of their values."""

from __future__ import annotations

import functools
import re
from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightcask.sources import readers

HIDDEN = ("stg_", "int_")  # Fixed values: prefixes and ends of helper tables that are not shown.
HIDDEN_ENDS = ("_tmp",)
HIDDEN_PARTS = ("bridge_smoke",)
BITS = 62  # columns to a number that says which columns hold a value


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str


@dataclass
class Source:
    """A named set of tables: name -> (format, options with path), see readers.read."""

    name: str
    tables: Mapping[str, tuple[str, Mapping[str, str]]]
    keys: list[ForeignKey] = field(default_factory=list)
    primary: Mapping[str, list[str]] = field(default_factory=dict)  # the primary keys that are declared, by table

    def visible(self) -> list[str]:
        return [t for t in self.tables if not (low := t.lower()).startswith(HIDDEN) and not low.endswith(HIDDEN_ENDS) and not any(p in low for p in HIDDEN_PARTS)]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        kind, options = self.tables[name]
        return readers.read(spark, kind, **options)


def folder(name: str, path: str, tables: list[str]) -> Source:
    """A source of Parquet tables under one path."""
    return Source(name, {t: ("parquet", {"path": f"{path}/{t}.parquet"}) for t in tables})


def database(name: str, path: str) -> Source:
    """A source of all tables of a SQLite or DuckDB file, with the keys that it declares."""
    kind = "duckdb" if path.endswith(".duckdb") else "sqlite"
    primary, foreign = (readers.duckdb_keys if kind == "duckdb" else readers.sqlite_keys)(path)
    return Source(name, {t: (kind, {"path": path, "table": t}) for t in primary}, [ForeignKey(*k) for k in foreign], primary)


def jdbc_source(spark: SparkSession, name: str, url: str, schema: str | None = None, **options: str) -> Source:
    """A source of the tables of a JDBC database, with the keys that it declares."""
    found, primary, foreign = readers.jdbc_tables(spark, url, schema, **options)
    where = lambda t: f'{schema}."{t}"' if schema else t
    return Source(name, {t: ("jdbc", {"url": url, "table": where(t), **options}) for t in sorted({c[0] for c in found})}, [ForeignKey(*k) for k in foreign], primary)


def columns(spark: SparkSession, source: Source, marks: bool = False) -> DataFrame:
    """(table_name, column_name, position, data_type) of the visible tables; only schemas are read. With marks also primary_key, and in
    refers_to the table and column that a key leads to, as far as the source declares them."""
    to = {(k.table, k.column): f"{k.parent}.{k.parent_column}" for k in source.keys}
    rows = [(t, f.name, i, f.dataType.simpleString(), f.name in source.primary.get(t, ()), to.get((t, f.name))) for t in source.visible() for i, f in enumerate(source.table(spark, t).schema.fields)]
    out = spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, primary_key boolean, refers_to string")
    return out if marks else out.drop("primary_key", "refers_to")


def samples(spark: SparkSession, source: Source, table: str, rows: int = 3) -> DataFrame:
    """The first rows of a table."""
    return source.table(spark, table).limit(rows)


#: Words before and after the thing that a key column names, and what tables are called besides.
REFERS, KEY_ENDS, TABLE_ENDS = r"(?:link_to_|ref_|fk_)", r"(?:id|key|uuid)", ("_data", "_table")


def own_prefix(names: list[str]) -> str:
    """What all columns of a table begin with, up to a first underscore: o_ for o_orderkey, o_custkey ..."""
    first = {n.split("_", 1)[0] for n in names}
    return f"{first.pop()}_" if len(first) == 1 and len(names) > 1 and all("_" in n for n in names) else ""


def thing(column: str, prefix: str = "") -> str | None:
    """What a key column is the key of, by its name: cust for o_custkey, member for link_to_member, nothing for id; None if it names no key."""
    name = column.lower().removeprefix(prefix)
    found = re.fullmatch(rf"{REFERS}?(?P<a>.*?)_?{KEY_ENDS}|{REFERS}(?P<b>.+)", name)
    return None if not found else found["b"] if found["a"] is None else found["a"]


def names_table(word: str | None, table: str) -> int:
    """How surely a word means a table: 3 its name or its singular, 2 one with an end that says nothing, 1 its beginning, 0 not at all."""
    table = table.lower()
    if not word:
        return 0
    for sure, name in ((3, table), *((2, table.removesuffix(e)) for e in TABLE_ENDS if table.endswith(e))):
        if word in (name, name.removesuffix("s"), name.removesuffix("es"), re.sub("ies$", "y", name)) or name in (f"{word}s", word.removesuffix("s")):
            return sure
    return int(len(word) > 2 and table.startswith(word))


def evidence(child: tuple[str, str | None], parent: tuple[str, str | None], known: int) -> int:
    """How much the names of two columns (table, thing) say for the first to refer to the second; known: how surely the thing means any table."""
    (t, what), (p, own) = child, parent
    mine, its = names_table(what, t), names_table(what, p)
    if not what or t == p or mine >= max(its, 1) or own is None:
        return 0  # no thing, or the key of its own table
    if its and its == known and (own == "" or own == what or names_table(own, p)):
        return 10 + its  # names the parent, and is met by the parent's own key
    return 5 if own == what and not known else 0  # both name one thing that has no table


def candidates(spark: SparkSession, source: Source) -> list[tuple[ForeignKey, int]]:
    """Pairs of columns whose names say that one refers to the other, and how surely. Only schemas are read."""
    keys = []
    for t in source.visible():
        names = source.table(spark, t).columns
        keys += [(t, c, what) for c in names if (what := thing(c, own_prefix(names))) is not None]
    known = {w: max((names_table(w, t) for t in source.visible()), default=0) for _, _, w in keys}
    return [(ForeignKey(t, c, p, d), sure) for t, c, w in keys for p, d, o in keys if (sure := evidence((t, w), (p, o), known[w]))]


def families(df: DataFrame) -> dict[str, str]:
    """Columns that can be keys, as whole numbers or as text; values of the two are never the same."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return {n: "number" if isinstance(k, T.IntegralType) else "text" for n, k in kinds.items() if isinstance(k, (T.IntegralType, T.StringType))}


def _sketched(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(at, family, n, sketch) of each column, at being its place in columns: a pass over each table, as partial aggregates of bounded size."""
    out = []
    for t in dict.fromkeys(t for t, _ in columns):
        df = tables[t]
        family = families(df)
        mine = [(i, c) for i, (of, c) in enumerate(columns) if of == t]
        value = lambda c, family=family: F.col(f"`{c}`").cast("bigint" if family[c] == "number" else "string")
        row = lambda i, c, family=family, value=value: F.struct(F.lit(i).alias("at"), F.lit(family[c]).alias("family"), F.count(value(c)).alias("n"), F.theta_sketch_agg(value(c)).alias("sketch"))
        out.append(df.agg(F.array(*[row(i, c) for i, c in mine]).alias("all")).select(F.inline("all")))
    return functools.reduce(DataFrame.unionByName, out)


def possible(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> set[tuple[int, int]]:
    """Pairs (a, b) of places in columns such that b's values may be unique and hold all of a's, as far as sketches tell.

    Two sketches hold all values of their columns whose hashes lie below a bound. A value below both bounds that only a's has is proof
    that b lacks it, so no pair is lost; as many rows reach the driver as there are pairs of columns left.
    """
    s = _sketched(tables, columns).filter("n > 0")
    b = s.select(F.col("at").alias("b"), "family", F.col("n").alias("m"), F.col("sketch").alias("other")).filter(F.theta_sketch_estimate("other") >= 0.8 * F.col("m"))
    held = F.theta_sketch_estimate(F.theta_difference("sketch", "other")) == 0
    return {(r.at, r.b) for r in s.join(b, "family").filter("at <> b").filter(held).select("at", "b").collect()}


def inclusions(spark: SparkSession, source: Source, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """(table_name, column_name, parent, parent_column, n_distinct, coverage): every column whose values all are among those of a column in which
    no value comes twice; coverage is the share of the parent's values that it has. Nulls do not count; a column without values has no rows.

    Sketches discard most pairs. What is left is one job over all tables: values are counted by column, then each value tells which columns
    hold it, as bits, and the bits that all values of a column have in common are the columns that include it.
    """
    schema = "table_name string, column_name string, parent string, parent_column string, n_distinct long, coverage double"
    tables = {t: source.table(spark, t) for t in (source.visible() if columns is None else dict.fromkeys(t for t, _ in columns))}
    kinds = {t: families(df) for t, df in tables.items()}
    columns = [(t, c) for t, c in (columns or [(t, c) for t in tables for c in kinds[t]]) if c in kinds[t]]
    pairs = possible(tables, columns) if len(columns) > 1 else set()
    if not pairs:
        return spark.createDataFrame([], schema)
    left = sorted({i for pair in pairs for i in pair})
    place = {i: k for k, i in enumerate(left)}
    values = []
    for t in dict.fromkeys(columns[i][0] for i in left):
        df, family = tables[t], kinds[t]
        mine = [(place[i], c) for i, (of, c) in enumerate(columns) if of == t and i in place]
        number = lambda c, family=family: F.col(f"`{c}`").cast("bigint") if family[c] == "number" else F.lit(None).cast("bigint")
        text = lambda c, family=family: F.lit(None).cast("string") if family[c] == "number" else F.when(F.length(f"`{c}`") > 64, F.sha2(F.col(f"`{c}`").cast("binary"), 256)).otherwise(F.col(f"`{c}`"))
        values += [df.select(F.lit(k).alias("at"), number(c).alias("number"), text(c).alias("text")).filter(f"`{c}` is not null") for k, c in mine]
    counted = functools.reduce(DataFrame.unionByName, values).groupBy("number", "text", "at").agg(F.count(F.lit(1)).alias("n"))
    words = range(-(-len(left) // BITS))
    bit = lambda w: F.bit_or(F.when(F.expr(f"at div {BITS} = {w}"), F.expr(f"shiftleft(1L, cast(at % {BITS} as int))")).otherwise(0)).alias(f"in{w}")
    held = counted.groupBy("number", "text").agg(F.collect_list(F.struct("at", "n")).alias("of"), *[bit(w) for w in words])  # no more than columns
    each = held.select(F.inline("of"), *[f"in{w}" for w in words]).groupBy("at").agg(F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("most"), *[F.bit_and(f"in{w}").alias(f"in{w}") for w in words])
    named = spark.createDataFrame([(k, *columns[i]) for i, k in place.items()], "at int, t string, c string")  # a row per column
    each = each.join(F.broadcast(named), "at")
    has = lambda b: functools.reduce(Column.__or__, [(F.floor(b / BITS) == w) & (F.col(f"in{w}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (b % BITS).cast("int"))) != 0) for w in words])
    child = each.select("at", "t", "c", "n_distinct", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(left) - 1)), has)).alias("b")).filter("at <> b")
    parent = each.filter("most = 1").select(F.col("at").alias("b"), F.col("t").alias("parent"), F.col("c").alias("parent_column"), F.col("n_distinct").alias("m"))
    return child.join(parent, "b").select(F.col("t").alias("table_name"), F.col("c").alias("column_name"), "parent", "parent_column", "n_distinct", (F.col("n_distinct") / F.col("m")).alias("coverage"))


def foreign_keys(spark: SparkSession, source: Source) -> DataFrame:
    """(table_name, column_name, parent, parent_column, n_distinct, coverage): for each column at most one parent, found by names and data.

    A column refers to another if names say so and the data bear it out (inclusions). Of several parents the one that the name means most
    surely is taken, then the one of whose values more are used, then the first by name.
    """
    pairs = candidates(spark, source)
    found = inclusions(spark, source, list(dict.fromkeys(k for fk, _ in pairs for k in ((fk.table, fk.column), (fk.parent, fk.parent_column)))))
    sure = spark.createDataFrame([(fk.table, fk.column, fk.parent, fk.parent_column, s) for fk, s in pairs], "table_name string, column_name string, parent string, parent_column string, sure int")  # a row per pair of names
    best = F.row_number().over(Window.partitionBy("table_name", "column_name").orderBy(F.desc("sure"), F.desc("coverage"), "parent", "parent_column"))
    met = found.join(F.broadcast(sure), ["table_name", "column_name", "parent", "parent_column"]).withColumn("best", best).filter("best = 1")
    return met.select("table_name", "column_name", "parent", "parent_column", "n_distinct", "coverage")


def keys_of(spark: SparkSession, source: Source) -> list[ForeignKey]:
    """The source's keys: as declared, else as found in its data."""
    return source.keys or [ForeignKey(r.table_name, r.column_name, r.parent, r.parent_column) for r in foreign_keys(spark, source).collect()]


def join_path(keys: list[ForeignKey], start: str, goal: str) -> list[ForeignKey] | None:
    """The shortest way from one table to another along keys to parents; None if there is none."""
    ways: deque[tuple[str, list[ForeignKey]]] = deque([(start, [])])
    seen = {start}
    while ways:
        at, way = ways.popleft()
        if at == goal:
            return way
        for fk in keys:
            if fk.table == at and fk.parent not in seen:
                seen.add(fk.parent)
                ways.append((fk.parent, [*way, fk]))
    return None

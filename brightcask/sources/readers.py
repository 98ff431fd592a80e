"""Reading and writing by format name. SQLite and DuckDB files are read by partitions of their row ids, in parallel."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 10_000  # rows
FILES = ("parquet", "orc", "csv", "json", "text")
SQLITE_TYPES = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUM": "double", "DEC": "double", "BOOL": "boolean", "BLOB": "binary"}


def sqlite_type(declared: str) -> str:
    """Spark's type for a declared SQLite type, by the first part that fits; text if none does."""
    return next((spark for part, spark in SQLITE_TYPES.items() if part in declared.upper()), "string")


#: What a condition may say of a column, with its SQL; the value of "in" is a list, "is null" and "is not null" have none.
TESTS = {"=": "{c} = ?", "<>": "{c} <> ?", ">": "{c} > ?", ">=": "{c} >= ?", "<": "{c} < ?", "<=": "{c} <= ?", "in": "{c} in ({marks})", "is null": "{c} is null", "is not null": "{c} is not null", "starts with": "substr({c}, 1, {length}) = ?", "contains": "instr({c}, ?) > 0"}


def condition(test: tuple, kinds: dict[str, str]) -> tuple[str, list]:
    """A test (column, what, value) as SQL with its values. Only columns whose values the database compares as Spark does can be tested."""
    name, what, *rest = test
    if what not in TESTS or name not in kinds:
        raise ValueError(f"cannot be tested in the database: {name} {what}")
    values = [] if "null" in what else list(rest[0]) if what == "in" else rest
    alike = {"bigint": int, "int": int, "string": str, "double": (int, float)}.get(kinds[name])
    if "null" not in what and (alike is None or not values or any(isinstance(v, bool) or not isinstance(v, alike) or v != v for v in values)):
        raise ValueError(f"cannot be tested in the database: {name} ({kinds[name]}) {what} {values}")
    column = '"' + name.replace('"', '""') + '"'
    return TESTS[what].format(c=column, marks=", ".join("?" * len(values)), length=len(values[0]) if what == "starts with" else 0), values


class RowRange(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, names: list[str], booleans: set[int], kinds: list | None = None) -> None:
        self.path, self.table, self.parts, self.names, self.booleans, self.kinds = path, table, parts, names, booleans, kinds
        self.conditions: list[tuple[str, list]] = []  # which the database carries out

    def query(self, partition: RowRange) -> tuple[str, list]:
        """What the database is asked for a part, and the values in it."""
        columns = ", ".join(f'"{n}"' for n in self.names)
        where = " and ".join(["rowid between ? and ?", *(c for c, _ in self.conditions)])
        return f'select {columns} from "{self.table}" where {where}', [partition.lo, partition.hi, *(v for _, vs in self.conditions for v in vs)]

    def partitions(self) -> list[RowRange]:
        with _opened(self.path) as db:
            lo, hi = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if lo is None:
            return [RowRange(0, -1)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [RowRange(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: RowRange):
        """Arrow batches of so many rows."""
        import pyarrow as pa

        with _opened(self.path) as db:
            rows = db.execute(*self.query(partition))
            while some := rows.fetchmany(BATCH):
                cols = [[bool(v) if v is not None else None for v in c] if i in self.booleans else list(c) for i, c in enumerate(zip(*some, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, self.kinds, strict=True)], names=self.names)


class SqliteSource(DataSource):
    """format("sqlite"): options path (a file that all executors see), table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _declared(self) -> list[tuple[str, str]]:
        with _opened(self.options["path"]) as db:
            return [(c[1], sqlite_type(c[2])) for c in db.execute(f'pragma table_info("{self.options["table"]}")')]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self._declared())

    def reader(self, schema) -> SqliteReader:
        booleans = {i for i, (_, t) in enumerate(self._declared()) if t == "boolean"}
        from pyspark.sql.pandas.types import to_arrow_schema

        return _tested(SqliteReader(self.options["path"], self.options["table"], int(self.options.get("partitions", "4")), schema.fieldNames(), booleans, to_arrow_schema(schema).types), schema, self.options.get("where", "[]"))


def _tested(reader: SqliteReader, schema: T.StructType, where: str) -> SqliteReader:
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    reader.conditions = [condition(tuple(test), kinds) for test in json.loads(where)]
    return reader


def _opened(path: str):
    """A read-only connection that closes with its block."""
    import contextlib
    import sqlite3

    return contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def sqlite_keys(path: str) -> tuple[dict[str, list[str]], list[tuple[str, str, str, str]]]:
    """Declared keys of a SQLite file: primary key columns by table, and (table, column, parent, parent column)."""
    with _opened(path) as db:
        tables = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by rowid")]
        primary = {t: [c[1] for c in sorted(db.execute(f'pragma table_info("{t}")'), key=lambda c: c[5]) if c[5]] for t in tables}
        foreign = [(t, k[3], k[2], k[4] or (primary.get(k[2]) or [k[3]])[0]) for t in tables for k in db.execute(f'pragma foreign_key_list("{t}")')]
    return primary, foreign


def duckdb_keys(path: str) -> tuple[dict[str, list[str]], list[tuple[str, str, str, str]]]:
    """Declared keys of a DuckDB file, as sqlite_keys gives them. A key of several columns is one entry for each."""
    with _duck(path) as db:
        primary = {t: [] for (t,) in db.execute("select table_name from duckdb_tables() where not internal order by table_oid").fetchall()}
        declared = db.execute("select table_name, constraint_type, constraint_column_names, referenced_table, referenced_column_names from duckdb_constraints() where constraint_type in ('PRIMARY KEY', 'FOREIGN KEY') order by table_oid, constraint_index").fetchall()
    primary |= {t: list(cs) for t, kind, cs, _, _ in declared if kind == "PRIMARY KEY"}
    return primary, [(t, c, parent, pc) for t, kind, cs, parent, pcs in declared if kind == "FOREIGN KEY" for c, pc in zip(cs, pcs, strict=True)]


class DuckReader(SqliteReader):
    def partitions(self) -> list[RowRange]:
        with _duck(self.path) as db:
            n = db.execute(f'select count(*) from "{self.table}"').fetchall()[0][0]
        step = max(1, -(-n // self.parts))
        return [RowRange(a, min(a + step, n) - 1) for a in range(0, n, step)] or [RowRange(0, -1)]

    def read(self, partition: RowRange):
        with _duck(self.path) as db:
            yield from db.sql(self.query(partition)[0], params=self.query(partition)[1]).to_arrow_table().to_batches()


class DuckSource(SqliteSource):
    """format("duckdb"): options as for sqlite; rows come as Arrow batches."""

    @classmethod
    def name(cls) -> str:
        return "duckdb"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with _duck(self.options["path"]) as db:
            return from_arrow_schema(db.execute(f'select * from "{self.options["table"]}" limit 0').to_arrow_table().schema, prefer_timestamp_ntz=True)

    def reader(self, schema) -> DuckReader:
        return _tested(DuckReader(self.options["path"], self.options["table"], int(self.options.get("partitions", "4")), schema.fieldNames(), set()), schema, self.options.get("where", "[]"))


def _duck(path: str):
    import duckdb

    return duckdb.connect(path, read_only=True)


def jdbc(spark: SparkSession, url: str, table: str, partitions: int = 8, column: str | None = None, predicates: list[str] | None = None, **options: str) -> DataFrame:
    """A table of a JDBC source in parallel parts: by predicates, a part each, or by equal ranges of a column between its least and most
    values, which the database is asked for. The column is the first one of the primary key if that is a number, a date or a time; without one
    the table is one part. Filters and columns go to the database, as Spark's own source sends them."""
    made = {"url": url, "dbtable": table, **options}
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    reader = spark.read.format("jdbc").options(**made)
    whole = reader.load()
    kinds = {f.name: f.dataType for f in whole.schema.fields}
    if column is None:
        keys = jdbc_tables(spark, url, **options)[1].get(table.split(".")[-1].strip('"'), [])
        column = next((k for k in keys[:1] if isinstance(kinds.get(k), (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))), None)
    if column is None:
        return whole
    lo, hi = whole.agg(F.min(f"`{column}`").cast("string"), F.max(f"`{column}`").cast("string")).first()  # the database's own least and most
    if lo is None:
        return whole
    if isinstance(kinds[column], T.NumericType):
        lo, hi = (str(int(float(v)) if "." in v or "E" in v else int(v)) for v in (lo, hi))
    return reader.options(partitionColumn=column, lowerBound=lo, upperBound=hi, numPartitions=partitions).load()


def jdbc_tables(spark: SparkSession, url: str, schema: str | None = None, user: str | None = None, password: str | None = None, **_: str) -> tuple[list[tuple[str, str, str, bool]], dict[str, list[str]], list[tuple[str, str, str, str]]]:
    """(columns, primary, foreign) of a database, as its driver tells them: (table, column, type, nullable), primary key columns by table, and
    (table, column, parent, parent column). Only the catalog is read; the same calls serve every engine with a driver on the class path."""
    jvm = spark._jvm
    db = jvm.java.sql.DriverManager.getConnection(url, *((user, password) if user is not None else ()))
    try:
        meta = db.getMetaData()
        kinds = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 2)
        kinds[0], kinds[1] = "TABLE", "VIEW"

        def rows(found, *names: str) -> list[tuple]:
            out = []
            while found.next():
                out.append(tuple(found.getString(n) for n in names))
            found.close()
            return out

        system = {"SYS", "SYSIBM", "INFORMATION_SCHEMA", "information_schema", "pg_catalog"}
        tables = [(s, t) for s, t in rows(meta.getTables(None, schema, "%", kinds), "TABLE_SCHEM", "TABLE_NAME") if s not in system]
        columns = [(t, c, k, n != "NO") for s, t in tables for c, k, n in rows(meta.getColumns(None, s, t, "%"), "COLUMN_NAME", "TYPE_NAME", "IS_NULLABLE")]
        primary = {t: [c for _, c in sorted((int(n), c) for c, n in rows(meta.getPrimaryKeys(None, s, t), "COLUMN_NAME", "KEY_SEQ"))] for s, t in tables}
        foreign = [(t, c, p, pc) for s, t in tables for c, p, pc in rows(meta.getImportedKeys(None, s, t), "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")]
        return columns, primary, foreign
    finally:
        db.close()


def read(spark: SparkSession, kind: str, where: Sequence[tuple] = (), **options: str) -> DataFrame:
    """A DataFrame of one table. kind: a file format, sqlite, duckdb, jdbc (whose driver must be on the class path), or view.

    where: tests (column, what, value), see TESTS, that SQLite and DuckDB carry out themselves. They are part of the relation and not pushed
    down by Spark: Spark 4.1 keeps what it has pushed to a Python source with the relation, so two filters on one DataFrame would share it
    and give wrong rows. Files and JDBC take Spark's filters.
    """
    if where:
        if kind not in ("sqlite", "duckdb"):
            raise ValueError(f"{kind} takes filters from Spark")
        options["where"] = json.dumps([list(test) for test in where])
    if kind == "view":
        return spark.table(options["name"])
    if kind == "jdbc":
        return jdbc(spark, options.pop("url"), options.pop("table"), int(options.pop("partitions", "8")), options.pop("column", None), **options)
    if kind in ("sqlite", "duckdb"):
        spark.dataSource.register(SqliteSource if kind == "sqlite" else DuckSource)
    elif kind not in FILES:
        raise ValueError(f"unknown source format: {kind}")
    reader = spark.read.format(kind)
    if "schema" in options:
        reader = reader.schema(options.pop("schema"))
    return reader.options(**options).load()


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", **options: str) -> None:
    """CSV gets a header, quotes only where needed and empty fields for nulls; other formats Spark's defaults."""
    if kind not in FILES:
        raise ValueError(f"unknown sink format: {kind}")
    defaults = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'} if kind == "csv" else {}
    df.write.format(kind).mode(mode).options(**(defaults | options)).save(path)


def repaired(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with columns cast to the types they should have had; what cannot be cast becomes null."""
    return df.select(*[df[f"`{c}`"].try_cast(types[c]).alias(c) if c in types else df[f"`{c}`"] for c in df.columns])

"""Sources by id: what is registered, found in a folder, given as fixed rows or switched off, and what is wrong with each."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from brightcask.sources.catalog import ForeignKey, Source, columns, database

DATABASES = (".sqlite", ".sqlite3", ".db", ".duckdb")
SCHEMA = "source_id string, engine string, tables long, columns long, state string"


class UnknownSource(LookupError):
    """No source has this id, or it is switched off."""


@dataclass
class Registry:
    """Sources by id. Under root, a folder of Parquet tables or a database file of the id's name is a source too."""

    sources: dict[str, Source]
    root: str | None = None
    disabled: frozenset[str] = frozenset()

    @classmethod
    def read(cls, path: str, root: str | None = None) -> Registry:
        """From JSON: id -> {engine, tables: {name: path}, keys: [[table, column, parent, column]], disabled}. Names that begin with _ are comments."""
        with open(path, encoding="utf-8") as f:
            entries = {k: v for k, v in json.load(f).items() if not k.startswith("_")}
        made = {}
        for name, e in entries.items():
            where = lambda t, p, e=e: {"path": e.get("path", p), "table": t} if e["engine"] in ("sqlite", "duckdb") else {"path": p}
            made[name] = Source(name, {t: (e["engine"], where(t, p)) for t, p in e.get("tables", {}).items()}, [ForeignKey(*k) for k in e.get("keys", [])])
        return cls(made, root, frozenset(n for n, e in entries.items() if e.get("disabled")))

    def get(self, name: str) -> Source:
        if name in self.disabled:
            raise UnknownSource(f"{name} is switched off")
        if name in self.sources:
            return self.sources[name]
        if self.root and os.path.isdir(folder := os.path.join(self.root, name)):
            tables = sorted(f.removesuffix(".parquet") for f in os.listdir(folder) if f.endswith(".parquet"))
            if tables:
                return Source(name, {t: ("parquet", {"path": os.path.join(folder, f"{t}.parquet")}) for t in tables})
        for end in DATABASES if self.root else ():
            if os.path.isfile(path := os.path.join(self.root, f"{name}{end}")):
                return database(name, path)
        raise UnknownSource(name)

    def states(self, spark: SparkSession) -> DataFrame:
        """A row for each source: engine, tables and columns, and whether it is ready, disabled or why it cannot be read. No path or password is told."""
        rows = []
        for name, source in self.sources.items():
            engine = next((kind for kind, _ in source.tables.values()), "none")
            n, state = 0, "disabled" if name in self.disabled else "ready"
            if state == "ready":
                try:
                    n = columns(spark, source).count()
                except Exception as e:  # whatever a reader raises is the state of its source
                    state = getattr(e, "getCondition", lambda: None)() or type(e).__name__
            rows.append((name, engine, len(source.visible()), n, state))
        return spark.createDataFrame(rows, SCHEMA)


def fixed(spark: SparkSession, tables: Mapping[str, tuple[str, list[tuple]]]) -> dict[str, DataFrame]:
    """Small tables given as (schema, rows), for examples and tests, as temporary views."""
    out = {}
    for name, (schema, rows) in tables.items():
        out[name] = spark.createDataFrame(rows, schema)
        out[name].createOrReplaceTempView(name)
    return out

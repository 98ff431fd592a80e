"""Results kept under an id: tables as Parquet, anything else as JSON, in any store that Spark can write to. And exports for people."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# The kinds of artifacts, which are parts of their ids.
KINDS = ("table", "chart_spec", "chart_image", "warning", "error", "debug_sql", "response")
ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")
MARK = "\ufeff"  # by which spreadsheets know UTF-8


class Artifacts:
    """Artifacts in a folder that driver and executors share."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, name: str, suffix: str) -> str:
        if not ID.fullmatch(name) or ".." in name:
            raise ValueError(f"no artifact id: {name!r}")
        return f"{self.folder}/{name}{suffix}"

    def save(self, request: str, kind: str, content: object) -> str:
        """Keeps a DataFrame as Parquet, anything else as JSON; returns the id: request, kind and eight hex digits."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        name = f"{request}-{kind}-{uuid.uuid4().hex[:8]}"
        if isinstance(content, DataFrame):
            content.write.parquet(self._path(name, ".parquet"))
        else:
            text = json.dumps(content, ensure_ascii=False, default=str)  # one line
            SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.text(self._path(name, ".json"))
        return name

    def load(self, spark: SparkSession, name: str) -> object:
        table = self._path(name, ".parquet")
        where = spark._jvm.org.apache.hadoop.fs.Path(table)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.parquet(table)
        return json.loads(spark.read.text(self._path(name, ".json")).first()[0])


def labelled(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """df with the labels that people read as column names; two equal ones get a number."""
    names: list[str] = []
    for c in df.columns:
        label, n = labels.get(c, c), 2
        while label in names:
            label, n = f"{labels.get(c, c)} {n}", n + 1
        names.append(label)
    return df.toDF(*names)


def csv_text(df: DataFrame, labels: Mapping[str, str] | None = None, rows: int = 1000) -> str:
    """The first rows as one CSV text with a byte order mark; quotes only where needed, nulls as empty fields. For whole tables write CSV with Spark."""

    def cell(v: object) -> str:
        text = "" if v is None else str(v)
        return '"' + text.replace('"', '""') + '"' if re.search(r'[",\n\r]', text) else text

    df = labelled(df, labels or {})
    lines = [df.columns, *df.limit(rows).collect()]
    return MARK + "\n".join(",".join(map(cell, line)) for line in lines) + "\n"


def json_text(df: DataFrame, labels: Mapping[str, str] | None = None, rows: int = 1000) -> str:
    """The first rows with their columns' ids and labels as one JSON text."""
    found = [r.asDict(recursive=True) for r in df.limit(rows).collect()]
    return json.dumps({"columns": [{"id": c, "label": (labels or {}).get(c, c)} for c in df.columns], "rows": found}, ensure_ascii=False, default=str)

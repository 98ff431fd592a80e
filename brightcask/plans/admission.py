"""Running a SELECT for someone else: one statement that only reads, a row cap that tells when it cuts, and a time limit.

The text is checked by its words outside of literals, quoted names and comments; Spark then parses and resolves it, and what
its functions come down to is checked in the plan. The cap is put on the DataFrame, never into the text, so a LIMIT inside the query neither counts for it nor hides it.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statements that change something, and functions that reach beyond the data.
FORBIDDEN = {"insert", "update", "delete", "merge", "drop", "create", "alter", "truncate", "grant", "revoke", "call", "set", "reset", "cache", "uncache", "refresh", "load", "msck", "analyze", "add", "use", "copy", "attach", "detach", "pragma", "vacuum", "execute"}
REACHING = {"reflect", "java_method", "try_reflect"}
#: A format before a quoted name makes Spark read a path.
PATH = re.compile(r"\b(?:parquet|orc|csv|json|text|avro|xml|binaryfile|delta|jdbc|sqlite|duckdb)`?\s*\.\s*`", re.I)
#: What Spark reads as one piece: raw literals, which know no escapes, literals, quoted names, and comments, which any kind of line end ends.
PIECES = re.compile(r"""(?P<text>(?<!\w)[rR](?:'[^']*'|"[^"]*")|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<name>`(?:[^`]|``)*`)|(?P<note>--[^\r\n]*|/\*.*?\*/)""", re.S)
#: The expression that calls methods of the JVM, whatever the function is called that comes down to it.
CALLS = "CallMethodViaReflection"
FILES = "spark.sql.runSQLOnFiles"


@dataclass(frozen=True)
class Verdict:
    ok: bool
    sql: str
    reason: str | None = None


@dataclass(frozen=True)
class Answer:
    rows: list[dict]
    truncated: bool
    error: str | None = None


def admitted(statements: Column) -> Column:
    """check() of a column of statements."""
    return F.pandas_udf(lambda some: some.map(lambda s: check(s or "").ok), "boolean")(statements)


def extract(text: str) -> str:
    """The statement in a text that may have words around it."""
    if fenced := re.search(r"```(?:sql)?\s*(.*?)```", text, re.S | re.I):
        text = fenced[1]
    elif start := re.search(r"(?:^|\n|:)\s*((?:select|with)\s.*)", text, re.S | re.I):
        text = start[1]
    return text.strip().rstrip(";").strip()


def check(sql: str) -> Verdict:
    """Whether sql is one reading statement, as far as its words tell. A name in backquotes may be a function or a file too."""
    kept = PIECES.sub(lambda m: m[0] if m["name"] else " " if m["note"] else " ? ", sql)
    bare = re.sub(r"`(?:[^`]|``)*`", " ? ", kept).strip().rstrip(";").strip()
    words = re.findall(r"[^\W\d]\w*", bare.lower())
    if not words:
        return Verdict(False, sql, "empty")
    if words[0] not in ("select", "with"):
        return Verdict(False, sql, "not a SELECT")
    if ";" in bare:
        return Verdict(False, sql, "more than one statement")
    if PATH.search(kept):
        return Verdict(False, sql, "a file is no table")
    if m := re.search(rf"\b({'|'.join(REACHING)})\s*\(", kept.lower().replace("`", "")):
        return Verdict(False, sql, f"forbidden: {m[1]}")
    # A word followed by a parenthesis is a function, as in replace(...); a statement's is not.
    for m in re.finditer(r"(?<![.\w])([^\W\d]\w*)(\s*\()?", bare.lower()):
        if m[1] in FORBIDDEN and not m[2] and m[1] not in ("set", "add", "use", "load", "cache", "call"):
            return Verdict(False, sql, f"forbidden: {m[1]}")
    return Verdict(True, sql)


def reaches_out(df: DataFrame) -> bool:
    """Whether the plan that Spark has made of a statement calls into the JVM, subqueries included: what functions come down to, not their names."""
    plan = getattr(df, "_jdf", None)
    return plan is not None and f"expressions.{CALLS}" in re.sub(r'"value":"(?:[^"\\]|\\.)*"', "", plan.queryExecution().analyzed().toJSON())


def unique_names(df: DataFrame) -> DataFrame:
    """df with _2, _3 after names that come again."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if seen[c.lower()] == 1 else f"{c}_{seen[c.lower()]}")
    return df.toDF(*names)


# The codes of errors and warnings, by which a caller tells them apart.
CODES = ("model_not_loaded", "schema_not_found", "ambiguous_query", "sql_generation_failed", "sql_validation_failed", "sql_execution_failed", "timeout", "empty_result", "row_limit_exceeded", "metadata_incomplete")
CONDITIONS = {"PATH_NOT_FOUND": "schema_not_found", "UNSUPPORTED_DATASOURCE_FOR_DIRECT_QUERY": "sql_validation_failed"}


def code_of(error: Exception) -> str:
    """The code of what Spark raised, by the condition that it names."""
    if isinstance(error, ParseException):
        return "sql_validation_failed"
    condition = error.getCondition() or "" if isinstance(error, PySparkException) else ""
    return CONDITIONS.get(condition.split(".")[0], "sql_execution_failed")


def edge(df: DataFrame) -> DataFrame:
    """df as a caller outside of Spark takes it: decimals as doubles, dates and times as ISO text, bytes as base64, maps and intervals as text."""

    def out(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(f.dataType, T.BinaryType):
            return F.base64(c)
        if isinstance(f.dataType, T.MapType):
            return F.to_json(c)
        if isinstance(f.dataType, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return c.cast("string")
        return c

    return df.select(*[out(f).alias(f.name) for f in df.schema.fields])


def capped(df: DataFrame, cap: int = 1000, seconds: float = 8.0) -> Answer:
    """The first rows of df, at most cap of them, within so many seconds."""
    context = df.sparkSession.sparkContext
    tag, fired = f"brightcask-{uuid.uuid4().hex}", threading.Event()
    timer = threading.Timer(seconds, lambda: (fired.set(), context.cancelJobsWithTag(tag)))
    context.addJobTag(tag)
    timer.start()
    try:
        rows = edge(unique_names(df)).limit(cap + 1).collect()
    except Exception as e:  # a cancelled job surfaces in many ways; the timer says which it is
        return Answer([], False, "timeout" if fired.is_set() else _told(e))
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return Answer([r.asDict(recursive=True) for r in rows[:cap]], len(rows) > cap)


def _told(e: Exception) -> str:
    return f"{code_of(e)}: {e.getCondition() if isinstance(e, PySparkException) else type(e).__name__}"


def run(spark: SparkSession, text: str, cap: int = 1000, seconds: float = 8.0) -> Answer:
    """Rows of a SELECT, at most cap of them. From the first run on, SQL of this session reads tables and views but no paths."""
    verdict = check(extract(text))
    if not verdict.ok:
        return Answer([], False, f"sql_validation_failed: {verdict.reason}")
    if spark.conf.get(FILES, "true") != "false":
        spark.conf.set(FILES, "false")
    try:
        df = spark.sql(verdict.sql)
        if reaches_out(df):
            return Answer([], False, "sql_validation_failed: forbidden: a method of the JVM")
    except PySparkException as e:
        return Answer([], False, _told(e))
    return capped(df, cap, seconds)

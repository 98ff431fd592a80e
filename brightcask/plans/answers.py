"""A question answered: corrected where it names what is not there, its result checked, described and given a status.

Corrections are tried once for each kind of failure. A corrected question counts only if it runs, and after an empty result only if it
brings rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightcask.functions.dictionary import Dictionary, containing, nearest
from brightcask.functions.nearest import nearest_values
from brightcask.plans.admission import PIECES
from brightcask.plans.profile import FieldProfile, field_profile, profiles
from brightcask.plans.questions import AmbiguousQuestion, Question, ask
from brightcask.sources.catalog import ForeignKey, Source, columns

INLINE = 100  # rows that a caller gets at once
MOST_VALUES = 50  # values that a word may stand for; more say nothing
LITERAL = re.compile(r"(?P<column>\w+)\s*=\s*'(?P<value>(?:[^']|'')*)'")


@dataclass(frozen=True)
class Notice:
    code: str
    text: str


@dataclass(frozen=True)
class Outcome:
    """status: success, partial_success (with warnings) or failed (with an error)."""

    status: str
    rows: list[dict] = field(default_factory=list)
    n_rows: int = 0
    fields: list[FieldProfile] = field(default_factory=list)
    warnings: list[Notice] = field(default_factory=list)
    error: Notice | None = None
    corrections: list[tuple[str, str]] = field(default_factory=list)
    df: DataFrame | None = field(default=None, compare=False)  # the result itself


def completed(df: DataFrame, given: Sequence[FieldProfile] = ()) -> tuple[list[FieldProfile], list[Notice]]:
    """A profile for each column of df: the given one where it is whole, else one inferred from the schema. A name that tells of time wins
    over a given measure. What is given for columns that df lacks, and types that nothing is known of, become warnings."""
    inferred = {f.name: f for f in profiles(df)}
    known = {f.name: f for f in given}
    out, told = [], [Notice("metadata_incomplete", f"no such column: {n}") for n in known if n not in inferred]
    for name, own in inferred.items():
        f = known.get(name, own)
        if f is not own and (f.kind in ("", "unknown") or f.role in ("", "unknown") or own.role == "time"):
            f = replace(own, aggregations=f.aggregations or own.aggregations, default=f.default if own.role == "measure" and f.default else own.default)
        if f.kind == "unknown":
            told.append(Notice("metadata_incomplete", f"type of {name} is not known"))
        out.append(f)
    return out, told


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that df lacks; a request that names any is refused."""
    have = {c.lower() for c in df.columns}
    return [c for c in wanted if c.lower() not in have]


def status(n_rows: int, warnings: int = 0) -> str:
    return "failed" if n_rows == 0 else "partial_success" if warnings else "success"


def statuses(results: dict[str, DataFrame], inline: int = INLINE) -> DataFrame:
    """(result, n_rows, shown, status, code) for named results: empty ones failed, those above the inline limit are partial. A job for each, one row each."""
    out = None
    for name, df in results.items():
        n = df.agg(F.count(F.lit(1)).alias("n_rows"))
        row = n.select(
            F.lit(name).alias("result"), "n_rows", F.least("n_rows", F.lit(inline)).cast("long").alias("shown"),
            F.when(F.col("n_rows") == 0, "failed").when(F.col("n_rows") > inline, "partial_success").otherwise("success").alias("status"),
            F.when(F.col("n_rows") == 0, "empty_result").when(F.col("n_rows") > inline, "row_limit_exceeded").alias("code"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def answer(spark: SparkSession, source: Source, keys: Sequence[ForeignKey], q: Question, inline: int = INLINE, held: Dictionary | None = None) -> Outcome:
    """Runs a question; columns that do not exist and values that bring no rows are replaced by what was most likely meant."""
    corrections: list[tuple[str, str]] = []
    try:
        df = ask(spark, source, keys, q)
    except AmbiguousQuestion as e:
        return Outcome("failed", error=Notice("ambiguous_query", str(e)))
    except AnalysisException as e:
        q, done = with_columns(spark, source, q)
        if not done:
            return Outcome("failed", error=Notice("sql_execution_failed", e.getCondition() or "analysis"))
        corrections += done
        try:
            df = ask(spark, source, keys, q)
        except AnalysisException as again:
            return Outcome("failed", error=Notice("sql_execution_failed", again.getCondition() or "analysis"))
    rows = df.limit(inline + 1).collect()
    if not rows:
        other, done = with_values(spark, source, q, held)
        if done and (found := (changed := ask(spark, source, keys, other)).limit(inline + 1).collect()):
            df, rows, corrections = changed, found, corrections + done
    fields, warnings = completed(df)
    if not rows:
        return Outcome("failed", fields=fields, error=Notice("empty_result", "no row meets the question"), corrections=corrections)
    if len(rows) > inline:
        warnings.append(Notice("row_limit_exceeded", f"only the first {inline} rows are shown"))
    n = len(rows) if len(rows) <= inline else df.count()
    return Outcome(status(n, len(warnings)), [r.asDict(recursive=True) for r in rows[:inline]], n, fields, warnings, None, corrections, df)


def _nearest(spark: SparkSession, words: Sequence[str], df: DataFrame, column: str) -> dict[str, str]:
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: r.meant for r in nearest_values(asked, df, column).collect() if r.word != r.meant}


def unresolved(df: DataFrame, text: str) -> str | None:
    """The name in an expression over df that Spark finds no column for; None if there is none. Nothing is run."""
    try:
        df.select(F.expr(text))
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            return (e.getMessageParameters() or {}).get("objectName", "").split(".")[-1].strip("`") or None
    return None


def renamed(text: str, name: str, better: str) -> str:
    """text with a column's name replaced where it stands as a name: not in literals, not before a parenthesis, not as a part of others."""
    bare = rf"(?<![\w`]){re.escape(name)}(?![\w`]|\s*\()"
    return re.sub(rf"{PIECES.pattern}|(?P<found>{bare})", lambda m: f"`{better}`" if m["found"] or m["name"] == f"`{name}`" else m[0], text, flags=re.S)


def with_columns(spark: SparkSession, source: Source, q: Question) -> tuple[Question, list[tuple[str, str]]]:
    """q with the names for which Spark finds no column replaced by the nearest column of their table. Names of functions, words of SQL and
    what stands in literals stay as they are; a name with no nearest column stays, too."""
    known = columns(spark, source)
    done: list[tuple[str, str]] = []

    def fixed(table: str, text: str) -> str:
        df, seen = source.table(spark, table), set()
        while (name := unresolved(df, text)) and name not in seen:
            seen.add(name)
            if better := _nearest(spark, [name], known.filter(F.col("table_name") == table), "column_name").get(name):
                text = renamed(text, name, better)
                done.append((name, better))
        return text

    def column(table: str, name: str) -> str:
        return fixed(table, f"`{name}`").strip("`")

    return replace(
        q, measures=[replace(m, expression=fixed(m.table, m.expression)) for m in q.measures], by=[(t, column(t, c)) for t, c in q.by], filters=[(t, fixed(t, c)) for t, c in q.filters],
        grain=(q.grain[0], column(q.grain[0], q.grain[1]), q.grain[2]) if q.grain else None,
    ), done


def with_values(spark: SparkSession, source: Source, q: Question, held: Dictionary | None = None) -> tuple[Question, list[tuple[str, str]]]:
    """q with the text literals of its filters replaced by the nearest value of their column, else by all values that hold them.

    With a stored index of values (held) both are lookups of keys in it, one of each for the question, and no column is read; without one
    the nearest values are looked for among the distinct values of the column, and nothing holds a literal.
    """
    found = []
    for table, text in q.filters:
        texts = {f.name for f in source.table(spark, table).schema.fields if isinstance(f.dataType, T.StringType)}
        found += [(table, m["column"], m["value"].replace("''", "'")) for m in LITERAL.finditer(text) if m["column"] in texts]
    meant: dict[tuple[str, str, str], list[str]] = {}
    if held and found:
        words = spark.createDataFrame(found, "table_name string, column_name string, word string")
        meant = {(r.table_name, r.column_name, r.word): [r.meant] for r in nearest(words, held).collect() if r.meant != r.word}
        rest = [w for w in found if w not in meant]
        holding = containing(spark.createDataFrame(rest, words.schema), held).limit(MOST_VALUES + 1).collect() if rest else []
        for r in holding if len(holding) <= MOST_VALUES else []:
            meant.setdefault((r.table_name, r.column_name, r.word), []).append(r.value)
    elif found:
        for table, column, word in found:
            if better := _nearest(spark, [word], source.table(spark, table), column).get(word):
                meant[table, column, word] = [better]
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    done: list[tuple[str, str]] = []

    def better(table: str, m: re.Match[str]) -> str:
        word = m["value"].replace("''", "'")
        values = sorted(meant.get((table, m["column"], word), []))
        done.extend((word, v) for v in values)
        return m[0] if not values else f"{m['column']} = {quoted(values[0])}" if len(values) == 1 else f"{m['column']} in ({', '.join(map(quoted, values))})"

    filters = [(table, LITERAL.sub(lambda m, table=table: better(table, m), text)) for table, text in q.filters]
    return replace(q, filters=filters), done


__all__ = ["Notice", "Outcome", "answer", "completed", "field_profile", "missing_columns", "status", "statuses", "with_columns", "with_values"]

"""From a question to a chart: the answer, what its result suits, and the finished marks, kept under an id if there is a place for them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightcask.functions.dictionary import Dictionary
from brightcask.functions.intent import intent
from brightcask.functions.wording import asks_several
from brightcask.plans import charts, transforms
from brightcask.plans.answers import Outcome, answer
from brightcask.plans.profile import profiles, words
from brightcask.plans.questions import Question, grained
from brightcask.sources.artifacts import Artifacts
from brightcask.sources.catalog import ForeignKey, Source


@dataclass(frozen=True)
class Reply:
    """chart is None for an answer that failed; artifacts: ids by kind."""

    outcome: Outcome
    intent: str
    chart: dict | None
    others: list[str]
    artifacts: dict[str, str]


def with_period(df: DataFrame) -> DataFrame:
    """df with its year and its month as one date, by which a chart has one axis, if it has those two and no date."""
    numbers = {words(f.name)[-1]: f.name for f in profiles(df) if f.kind == "number" and f.role == "time" and words(f.name)}
    if any(f.kind in ("date", "datetime") for f in profiles(df)) or not {"year", "month"} <= numbers.keys():
        return df
    made = transforms.period(df, numbers["year"], numbers["month"])
    return made.drop(numbers["year"], numbers["month"]) if "period" in made.columns else df


def chart_of(df: DataFrame, asked: str, question: str = "", preferred: str | None = None) -> tuple[dict, list[str]]:
    """The spec of the best chart of a result, and the other forms that suit it. Several statistics at once make a table."""
    df = with_period(df)
    found = charts.choose(df, "statistics" if asks_several(question) else asked, preferred, question=question)
    return charts.spec(df, found[0], question), [c.kind for c in found[1:]]


def reply(spark: SparkSession, source: Source, keys: Sequence[ForeignKey], q: Question, question: str, preferred: str | None = None, kept: Artifacts | None = None, request: str = "request", held: Dictionary | None = None) -> Reply:
    """Answers a question, put in words and as what it asks of the source, with a chart.

    The result is computed once where it fits inline: its rows then are the chart's table.
    """
    what = spark.createDataFrame([(question,)], "q string").select(intent(F.col("q"))).first()[0]
    got = answer(spark, source, keys, grained(q, what), held=held)
    if got.error:
        ids = {"error": kept.save(request, "error", {"code": got.error.code, "text": got.error.text})} if kept else {}
        return Reply(got, what, None, [], ids)
    whole = len(got.rows) == got.n_rows
    df = spark.createDataFrame([tuple(r.values()) for r in got.rows], got.df.schema) if whole else got.df
    spec, others = chart_of(df, what, question, preferred)
    ids = {k: kept.save(request, k, v) for k, v in (("table", df), ("chart_spec", spec))} if kept else {}
    return Reply(got, what, spec, others, ids)

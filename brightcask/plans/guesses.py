"""A plain guess at what a question asks of a source, for want of anything better: one table, one measure, one dimension or time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightcask.functions.intent import intent
from brightcask.functions.wording import likeness, meant
from brightcask.plans.profile import profiles
from brightcask.plans.questions import Measure, Question, ask
from brightcask.sources.catalog import Source

# How much a guess shows.
TOP, SHOWN_ROWS, SHOWN_COLUMNS = 10, 50, 5
UNITS = ("day", "week", "month", "quarter", "year")


def guess(spark: SparkSession, source: Source, question: str) -> DataFrame:
    """The measure over time if the question asks for a trend, by the likeliest dimension if it ranks, compares or splits, else the first rows.

    The table is the one whose name and columns are likest to the question, the first of several; a measure that the question does not name
    is the number of rows.
    """
    tables = {t: source.table(spark, t) for t in source.visible()}
    name = max(tables, key=lambda t: 3 * likeness(t.rstrip("s"), question) + sum(likeness(c, question) > 0 for c in tables[t].columns))
    fields = profiles(tables[name])
    of = lambda *roles: [f.name for f in fields if f.role in roles]
    what = spark.createDataFrame([(question,)], "q string").select(intent(F.col("q"))).first()[0]
    named = [m for m in of("measure") if likeness(m, question)]
    y = meant(named, question)
    measure = Measure(y, name, f"`{y}`", "sum") if y else Measure("n_rows", name)
    if what in ("trend", "area") and of("time"):
        unit = next((u for u in UNITS if re.search(rf"\b{u}", question, re.I)), "month")
        return ask(spark, source, [], Question([measure], grain=(name, meant(of("time"), question), unit)))
    if what in ("top_n", "comparison", "part_to_whole") and of("dimension"):
        return ask(spark, source, [], Question([measure], by=[(name, meant(of("dimension"), question))], top=TOP if what == "top_n" else None))
    return tables[name].select(*tables[name].columns[:SHOWN_COLUMNS]).limit(SHOWN_ROWS)

"""What a question says of its chart besides the intent: several statistics, axes, and which of the result's fields it means."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# How questions name the statistics of which two or more make a table, in English and as Russian stems.
STATISTICS = {"min": r"min|minimum|least|lowest|миним|наименьш", "max": r"max|maximum|most|highest|максим|наибольш", "avg": r"avg|average|mean|средн"}
# Words by which a name stands for the thing that a question calls otherwise.
SAME = [{"revenue", "sales", "amount", "total", "выручка", "продажи", "сумма"}, {"order", "orders", "заказ", "заказы"}, {"count", "number", "количество", "сколько"}, {"customer", "client", "клиент"}, {"price", "cost", "цена", "стоимость"}, {"country", "nation", "страна"}]
START = r"(?<![\p{L}\p{N}])"
AXIS = 60  # characters between an axis and the field that belongs to it


def several_statistics(question: Column) -> Column:
    """Whether a question asks for two or more of least, most and mean."""
    text = F.lower(question)
    return F.coalesce(sum((text.rlike(f"{START}(?:{p})").cast("int") for p in STATISTICS.values()), F.lit(0)) >= 2, F.lit(False))


def asks_several(question: str) -> bool:
    """several_statistics() of one question."""
    return sum(bool(re.search(rf"(?<![^\W_])(?:{p})", question, re.I)) for p in STATISTICS.values()) >= 2


def stems(text: str) -> set[str]:
    """The words of a text by their first five letters, which endings leave alone."""
    return {w[:5] for w in re.findall(r"[^\W_]+", text.lower()) if len(w) > 1}


def likeness(name: str, question: str) -> int:
    """How many words of a question are in a field's name, as they are or by another name."""
    asked, named, whole = stems(question), stems(name), name.lower()
    here = sum(w in named or len(w) > 3 and w in whole for w in asked)
    return 2 * here + sum(any(w[:5] in asked for w in group) and any(w[:5] in named for w in group) for group in SAME)


def meant(names: Sequence[str], question: str) -> str | None:
    """The name that a question is likest to; the first of several."""
    return max(names, key=lambda n: likeness(n, question), default=None)


def on_axis(names: Sequence[str], question: str, axis: str) -> str | None:
    """The field that a question puts on the axis: "month on x", "x axis: month", "x = month", "месяц по оси x".

    Where the axis comes after its field, that stands before it in the same part of the sentence, nearest first; else the other way round.
    """
    text = question.lower()
    for mark in re.finditer(rf"\b(?P<after>(?:on|along|по|на)\s+(?:the\s+)?(?:оси\s+)?{axis}\b)|\b(?:ось|оси)\s+{axis}\b|\b{axis}[\s-]*axis|\b{axis}\s*[:=]", text):
        before = re.split(r"[,.;\n]|\band\b|\bи\b", text[max(0, mark.start() - AXIS) : mark.start()])[-1]
        after = re.split(r"[,.;\n]|\band\b|\bи\b", text[mark.end() : mark.end() + AXIS])[0]
        for side in (before, after) if mark["after"] else (after, before):
            held = [n for n in names if stems(n) <= stems(side)]
            if held:
                return max(held, key=lambda n: len(stems(n)))
    return None

"""What kind of answer a question asks for, as a column expression: it runs over a table of questions as over one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that tell an intent, in English and as Russian stems. They must be these, for questions rely on them; the first
# intent that matches counts.
WORDS = [
    ("heatmap", ["теплов", "heatmap", "heat map", "матриц"]),
    ("correlation", ["коррел", "correlation", "scatter", "dot plot", "point chart", "точеч", "точк", "рассеян", "рассеив"]),
    ("boxplot", ["boxplot", "box plot", "ящик", "выброс"]),
    ("histogram", ["гистограмм", "histogram"]),
    ("part_to_whole", ["кругов", "pie", "donut", "сектор", "доля", "доли", "share", "part-to-whole"]),
    ("composition", ["stacked", "накоплен", "разбив", "вклад", "состав"]),
    ("area", ["area chart", "area graph", "област", "площадн"]),
    ("trend", ["динамик", "тренд", "trend", "month", "monthly", "месяц", "месяч", "помесяч", "ежемесяч", "по дня", "по год", "decade", "десятилет"]),
    ("top_n", ["топ", "top", "лучшие", "лидер"]),
    ("comparison", ["сравн", "category", "категор", "по сегмент"]),
    ("distribution", ["распредел", "distribution", "histogram"]),
    ("table", ["таблиц", "table", "список", "list"]),
]
#: A question that names an axis asks for points, too.
AXIS = r"[xy][\s-]*axis"


def intent(question: Column) -> Column:
    """The first intent that a word of the question begins like; unknown if there is none or no question."""
    text = F.lower(question)
    out = F.lit("unknown")
    for name, words in reversed(WORDS):
        starts = "|".join([*words, AXIS] if name == "correlation" else words)
        out = F.when(text.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{starts})"), name).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))

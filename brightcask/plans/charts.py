"""Which chart a result gets. Sizes and signs come from aggregations over the result; the rows stay in Spark.

Each form of chart says which fields it would take, or none if the result does not suit it. Forms are then asked in order: the one that
the caller prefers, those that the question's intent names, those that the result's own shape suggests, and the table if there is no other.
A table that is asked for comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.functions.wording import meant, on_axis
from brightcask.plans import transforms
from brightcask.plans.profile import FieldProfile, profiles, statistic_fields

# How many categories, series and cells a reader can take in, and rows that make a line or a distribution.
SLICES, SERIES, STACKS, BOXES, CELLS, LINE_ROWS, RAW_ROWS, INLINE = 8, 8, 8, 20, 40, 3, 5, 100
LONG_LABEL, MANY_LABELS = 12, 5
#: Points that are drawn each; more are drawn by a grid of cells with a few of each.
POINTS = 2000

#: For each intent the forms that answer it, best first.
ASKED = {
    "table": ("table",), "heatmap": ("heatmap",), "correlation": ("scatter",), "boxplot": ("boxplot",), "histogram": ("histogram",), "distribution": ("histogram", "boxplot"),
    "part_to_whole": ("pie",), "composition": ("stacked_bar",), "area": ("area",), "trend": ("multi_line", "line"), "series": ("multi_line", "line"), "top_n": ("bar",), "comparison": ("bar",), "statistics": ("table",),
}
#: What a result is drawn as if the question says nothing that suits it.
SUGGESTED = ("bar", "line", "scatter", "histogram")


@dataclass(frozen=True)
class Candidate:
    kind: str
    x: str | None = None
    y: str | None = None
    color: str | None = None
    why: str = "suggested"  # preferred, asked, suggested or fallback


@dataclass(frozen=True)
class Result:
    """What the forms look at: fields by role, the question's own first; rows, distinct values and signs."""

    rows: int
    distinct: dict[str, int]
    positive: set[str]
    measures: tuple[FieldProfile, ...]
    times: tuple[FieldProfile, ...]
    dims: tuple[FieldProfile, ...]
    axes: tuple[str, ...]  # discrete fields in the order of x and y
    box: dict[str, str]  # columns that are a box plot's statistics already

    @property
    def y(self) -> str | None:
        return self.measures[0].name if self.measures else None

    @property
    def raw(self) -> str | None:
        """A measure whose rows are the values themselves, with enough of them for a distribution."""
        return self.y if self.measures and self.measures[0].default != "none" and self.rows >= RAW_ROWS else None

    def within(self, name: str, most: int, least: int = 2) -> bool:
        return least <= self.distinct[name] <= most


Form = Callable[[Result], Candidate | None]
FORMS: dict[str, Form] = {}


def form(f: Form) -> Form:
    FORMS[f.__name__.rstrip("_")] = f
    return f


@form
def table(r: Result) -> Candidate | None:
    return Candidate("table")


@form
def boxplot(r: Result) -> Candidate | None:
    by = r.dims[0].name if r.dims and r.within(r.dims[0].name, BOXES) else None
    if r.box:
        return Candidate("boxplot", r.dims[0].name if r.dims else None)
    return Candidate("boxplot", by, r.raw) if r.raw else None


@form
def histogram(r: Result) -> Candidate | None:
    return Candidate("histogram", r.raw) if r.raw else None


@form
def heatmap(r: Result) -> Candidate | None:
    few = [a for a in r.axes if r.within(a, CELLS, 1)]
    return Candidate("heatmap", few[0], few[1], r.y) if r.y and len(few) > 1 else None


@form
def scatter(r: Result) -> Candidate | None:
    if len(r.measures) > 1:
        return Candidate("scatter", r.measures[0].name, r.measures[1].name)
    return Candidate("scatter", r.dims[0].name, r.y) if r.dims and r.y and r.within(r.dims[0].name, CELLS) else None


@form
def pie(r: Result) -> Candidate | None:
    return Candidate("pie", r.dims[0].name, r.y) if r.dims and r.y in r.positive and r.within(r.dims[0].name, SLICES) else None


@form
def stacked_bar(r: Result) -> Candidate | None:
    first = [*r.dims, *r.times]
    parts = [d.name for d in r.dims if d != first[0] and r.within(d.name, STACKS)] if first else []
    if r.y and len(r.dims) == 1 and r.times and r.within(r.dims[0].name, STACKS):
        return Candidate("stacked_bar", r.times[0].name, r.y, r.dims[0].name)
    return Candidate("stacked_bar", first[0].name, r.y, parts[0]) if r.y and parts else None


@form
def multi_line(r: Result) -> Candidate | None:
    if not (r.times and r.y and r.rows >= LINE_ROWS):
        return None
    if r.dims and r.within(r.dims[0].name, SERIES):
        return Candidate("multi_line", r.times[0].name, r.y, r.dims[0].name)
    return Candidate("multi_line", r.times[0].name) if len(r.measures) > 1 else None


@form
def area(r: Result) -> Candidate | None:
    return Candidate("area", r.times[0].name, r.y) if r.times and r.y and r.rows >= LINE_ROWS else None


@form
def line(r: Result) -> Candidate | None:
    return Candidate("line", r.times[0].name, r.y) if r.times and r.y else None


@form
def bar(r: Result) -> Candidate | None:
    return Candidate("bar", r.dims[0].name, r.y) if r.dims and r.y else None


def looked_at(df: DataFrame, question: str = "") -> Result:
    """Sizes and signs of the result, in one pass. Fields that the question names come before others of their role.

    Distinct values are counted by sketches, which hold as few values as any form takes one by one and so count them exactly.
    """
    fields = profiles(df)
    role = lambda *names: sorted((f for f in fields if f.role in names), key=lambda f: (f.role == "id", f.name != meant([g.name for g in fields if g.role in names], question)) if question else f.role == "id")
    measures, times, dims = role("measure"), role("time"), role("dimension", "id")
    discrete = [f.name for f in (*dims, *times)] if not times else [f.name for f in (*times, *dims)]
    signs = [F.coalesce(F.min(F.col(f"`{f.name}`")) >= 0, F.lit(False)).alias(f"+ {f.name}") for f in measures]
    few = [F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{n}`").cast("string"))), F.lit(0)).alias(f"n {n}") for n in discrete]
    n = df.agg(F.count(F.lit(1)).alias("rows"), *signs, *few).first().asDict()
    x, y = (on_axis(discrete, question, a) if question else None for a in "xy")
    axes = [a for a in (x, *[d for d in discrete if d not in (x, y)]) if a]
    axes = [*axes[:1], *([y] if y and y != x else []), *axes[1:]] if y else axes
    return Result(n["rows"], {f: n[f"n {f}"] for f in discrete}, {f.name for f in measures if n[f"+ {f.name}"]}, tuple(measures), tuple(times), tuple(dims), tuple(axes), statistic_fields(df.columns))


def choose(df: DataFrame, intent: str = "unknown", preferred: str | None = None, most: int = 3, question: str = "") -> list[Candidate]:
    """The best charts for the result, best first."""
    r = looked_at(df, question)

    def offered() -> Iterator[Candidate]:
        for why, kinds in (("preferred", (preferred,) if preferred in FORMS else ()), ("asked", ASKED.get(intent, ())), ("suggested", SUGGESTED), ("fallback", ("table",))):
            for kind in kinds:
                if found := FORMS[kind](r):
                    yield replace(found, why=why)

    found: dict[str, Candidate] = {}
    for c in offered():
        found.setdefault(c.kind, c)
    if len(found) > 1 and found["table"].why == "fallback":
        del found["table"]
    return list(found.values())[:most]


def marks(df: DataFrame, chart: Candidate) -> DataFrame:
    """The finished data of a chart, from all rows of the result. Measures that are aggregates already are not summed up again."""
    how = {f.name: f.default for f in profiles(df)}
    if chart.kind == "histogram":
        return transforms.histogram(df, chart.x)
    if chart.kind == "boxplot" and chart.y is None:
        return transforms.given_boxes(df, chart.x, statistic_fields(df.columns))
    if chart.kind == "boxplot":
        return transforms.boxplot(df, chart.y, [chart.x] if chart.x else [])
    if chart.kind == "pie":
        return transforms.shares(df, chart.x, chart.y)
    if chart.kind == "stacked_bar":
        return transforms.stack(df, chart.x, chart.y, chart.color)
    if chart.kind == "heatmap":
        return transforms.bars(df, chart.x, chart.color, how[chart.color], chart.y)
    if chart.kind == "scatter":
        points = df.select(chart.x, chart.y)
        few = points.limit(POINTS + 1).count() <= POINTS
        return points if few else transforms.scatter(df, chart.x, chart.y).withColumnsRenamed({"x": chart.x, "y": chart.y})
    if chart.kind == "multi_line" and chart.y is None:
        return transforms.fold(df, chart.x, [f.name for f in profiles(df) if f.role == "measure"])
    if chart.kind in ("bar", "line", "area", "multi_line"):
        return transforms.bars(df, chart.x, chart.y, how[chart.y], chart.color)
    return df


def axis_type(field: FieldProfile) -> str:
    """How an axis reads a field: a year or another bare number of a period is ordinal and gets no thousands separator."""
    if field.kind in ("date", "datetime"):
        return "temporal"
    if field.role == "time":
        return "ordinal"
    return "quantitative" if field.role == "measure" else "nominal"


#: Marks inline of each form; a line or an area is shown whole up to more of them, for a part of it would be another line.
INLINE_OF = {"line": 1000, "area": 1000, "multi_line": 1000, "scatter": 3 * POINTS}


def ordered(data: DataFrame, chart: Candidate) -> DataFrame:
    """Marks in the order in which they are read: along the axis, or bars and slices by size, the largest first."""
    have = lambda *names: [F.asc_nulls_last(f"`{n}`") for n in names if n in data.columns]
    if chart.kind in ("bar", "pie") and chart.y in data.columns:
        return data.orderBy(F.desc_nulls_last(f"`{chart.y}`"), *have(chart.x))
    return data.orderBy(*o) if (o := have("x_bin", "y_bin", "place", "bin_start", *[c for c in (chart.x, chart.color, chart.y if chart.kind in ("scatter", "heatmap") else None) if c], "series")) else data


def spec(df: DataFrame, chart: Candidate, title: str = "") -> dict:
    """The chart as a plain dictionary, with the type of each axis, room for labels and its marks in order.

    Of marks above the form's limit the first are inline; truncated says so, and n_marks how many there are.
    """
    fields = {f.name: f for f in profiles(df)}
    data = ordered(marks(df, chart), chart)
    most = INLINE_OF.get(chart.kind, INLINE)
    rows = data.limit(most + 1).collect()
    cut = len(rows) > most
    out: dict = {"title": title, "mark": chart.kind, "encoding": {}, "values": [r.asDict(recursive=True) for r in rows[:most]], "truncated": cut, "n_marks": data.count() if cut else len(rows)}
    for channel in ("x", "y", "color"):
        if name := getattr(chart, channel):
            out["encoding"][channel] = {"field": name, "type": axis_type(fields[name])}
    if chart.x and out["encoding"]["x"]["type"] != "quantitative" and chart.x in data.columns:
        texts = [str(r[chart.x]) for r in rows]
        out["encoding"]["x"]["turned"] = len(texts) > MANY_LABELS or max(map(len, texts), default=0) > LONG_LABEL
    return out

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightcask.functions.intent import intent
from brightcask.plans import admission, charts, profile, transforms
from brightcask.plans.questions import AmbiguousQuestion, Measure, Question, ask
from brightcask.sources import catalog


def test_extract_statement():
    assert admission.extract("Here:\n```sql\nselect 1;\n```") == "select 1"
    assert admission.extract("answer: select a from t;") == "select a from t"


def test_run_caps_and_tells(spark):
    got = admission.run(spark, "select id, id from range(10)", cap=3)
    assert got.truncated and len(got.rows) == 3 and set(got.rows[0]) == {"id", "id_2"}
    got = admission.run(spark, "select * from (select id from range(10) limit 5)", cap=5)
    assert not got.truncated and len(got.rows) == 5


@pytest.mark.parametrize("sql", ["select `reflect`('java.lang.System','getProperty','user.home')", "select * from text.`/etc/hostname`", "select * from `text` . `/etc/hostname`", "select /* x */ java_method ('a', 'b')"])
def test_run_reaches_neither_files_nor_the_jvm(spark, sql):
    got = admission.run(spark, sql)
    assert got.rows == [] and got.error.startswith("sql_validation_failed")


def test_paths_are_closed_to_sql(spark):
    admission.run(spark, "select 1")
    with pytest.raises(Exception, match="UNSUPPORTED_DATASOURCE_FOR_DIRECT_QUERY|TABLE_OR_VIEW_NOT_FOUND"):
        spark.sql("select * from text.`/etc/hostname`").collect()


def test_values_at_the_edge(spark):
    row = admission.run(spark, "select cast(1.25 as decimal(5, 2)) d, date'2024-02-01' t, timestamp_ntz'2024-02-01 03:04:05' ts, map('a', 1) m, x'00ff' b").rows[0]
    assert row == {"d": 1.25, "t": "2024-02-01", "ts": "2024-02-01T03:04:05.000000", "m": '{"a":1}', "b": "AP8="}


def test_run_maps_errors(spark):
    assert admission.run(spark, "drop table x").error.startswith("sql_validation_failed")
    assert admission.run(spark, "select nope from range(1)").error.startswith("sql_execution_failed: UNRESOLVED_COLUMN")
    assert admission.run(spark, "select 1 from nowhere").error.startswith("sql_execution_failed: TABLE_OR_VIEW_NOT_FOUND")
    assert admission.run(spark, "select 1 / 0 as x").error.startswith("sql_execution_failed: DIVIDE_BY_ZERO")
    assert admission.run(spark, "select (1 from").error.startswith("sql_validation_failed")


def test_run_times_out(spark):
    slow = "select count(*) as n from range(3000000000) where sqrt(id) < -1"
    assert admission.run(spark, slow, seconds=1.0).error == "timeout"


def test_profile_roles():
    role = lambda n, k="number": profile.role_of(n, k)
    assert role("update_count") == "measure" and role("candidate", "string") == "dimension" and role("order_id") == "id"
    assert role("год") == "time" and role("месяц", "string") == "time" and role("comment", "string") == "text"
    assert profile.periodicity_of("order_month") == "month"


def test_derived_measures_are_not_summed_again(spark):
    df = spark.createDataFrame([("a", 2.0)], "k string, sum_x double")
    assert profile.profiles(df)[1].default == "none"
    bar = next(c for c in charts.choose(df, "comparison") if c.kind == "bar")
    assert [tuple(r) for r in charts.marks(df, bar).collect()] == [("a", 2.0)]


def test_statistics_and_sniffing_of_empty(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert {(r.name, r.n_rows) for r in profile.statistics(df).collect()} == {("a", 0), ("b", 0)}
    assert profile.sniffed(df).first().kind == "unknown"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(None,), (5.0,), (5.0,)], "x double")
    assert [(r.n) for r in transforms.histogram(df, "x").collect()] == [2]
    assert transforms.histogram(df.filter("false"), "x").count() == 0
    many = spark.range(1000).selectExpr("cast(id as double) x")
    bins = transforms.histogram(many, "x").collect()
    assert len(bins) <= 21 and sum(b.n for b in bins) == 1000


def test_more_than_a_hundred_rows_are_all_in_the_chart(spark):
    df = spark.range(500).selectExpr("'k' k", "1.0 x")
    assert transforms.bars(df, "k", "x").first().x == 500


def test_period_needs_every_row_to_be_a_month(spark):
    df = spark.createDataFrame([(2024, 2), (2024, 12)], "y int, m int")
    assert [r.period for r in transforms.period(df, "y", "m").collect()] == [datetime.date(2024, 2, 1), datetime.date(2024, 12, 1)]
    for bad in [(2024, 13), (None, 1)]:
        assert transforms.period(df.union(spark.createDataFrame([bad], "y int, m int")), "y", "m").columns == ["y", "m"]
    assert transforms.period(df.filter("false"), "y", "m").columns == ["y", "m", "period"]


def test_marks_for_each_chart(spark):
    df = spark.createDataFrame([(f"c{i % 3}", f"s{i % 2}", float(i), float(i * i), datetime.date(2024, 1 + i % 5, 1)) for i in range(30)], "c string, s string, x double, y double, d date")
    for wanted, cols, i in [("pie", ["c", "x"], "part_to_whole"), ("stacked_bar", ["c", "s", "x"], "composition"), ("histogram", ["x"], "histogram"), ("boxplot", ["c", "x"], "boxplot"), ("scatter", ["x", "y"], "correlation"), ("line", ["d", "x"], "trend"), ("area", ["d", "x"], "area"), ("heatmap", ["c", "s", "x"], "heatmap"), ("bar", ["c", "x"], "comparison"), ("table", ["c", "x"], "table")]:
        got = charts.choose(df.select(*cols), i)
        assert got[0].kind == wanted or wanted in [g.kind for g in got], (wanted, got)
        assert charts.marks(df.select(*cols), next(g for g in got if g.kind == wanted)).count() > 0


def test_fold_takes_all_measures(spark):
    df = spark.createDataFrame([("a", *range(8))], "k string, " + ", ".join(f"m{i} int" for i in range(8)))
    assert transforms.fold(df, "k", [f"m{i}" for i in range(8)]).count() == 8


def test_question_without_a_way_is_refused(spark):
    source = catalog.folder("s", "/root/testdata/sf0.001", ["orders", "part"])
    with pytest.raises(AmbiguousQuestion):
        ask(spark, source, [], Question([Measure("n", "orders")], by=[("part", "p_brand")]))


def test_intent_is_word_bound(spark):
    df = spark.createDataFrame([("Stop the candidate",), ("Покажи август",), ("",), ("pie of sales",)], "q string")
    assert [r[0] for r in df.select(intent(df.q)).collect()] == ["unknown", "unknown", "unknown", "part_to_whole"]


def test_quantiles_are_exact_on_skewed_groups_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=4000).tolist() + [1e12], "b": [5.0] * 50, None: rng.integers(0, 3, 100).astype(float).tolist(), "d": [7.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r.k: [r[f"q{i}"] for i in range(len(at))] for r in transforms.quantiles(df, "v", ["k"], at).collect()}
    assert got.keys() == groups.keys() and all(np.allclose(got[k], np.quantile(vs, at), rtol=1e-12) for k, vs in groups.items())
    assert np.allclose(list(transforms.quantiles(df, "v", [], at).first()), np.quantile([v for _, v in rows if v is not None], at), rtol=1e-12)


def test_charts_without_a_telling_intent(spark):
    months = [(datetime.date(2024, 1 + i % 12, 1), f"s{i % 3}", float(i), float(-i)) for i in range(24)]
    df = spark.createDataFrame(months, "d date, s string, x double, y double")
    first = lambda cols, intent="unknown", **more: charts.choose(df.select(*cols), intent, **more)[0]
    assert first(["d", "x"]).kind == "line"
    assert first(["x", "y"]).kind == "scatter"
    assert first(["d", "s", "x"], "comparison").kind == "bar" and first(["d", "s", "x"], "top_n").kind == "bar"
    assert first(["d", "s", "x"], "area").kind == "area" and first(["d", "s", "x"], "trend").kind == "multi_line"
    assert first(["s"]).kind == "table" and first(["s"]).why == "fallback"
    assert first(["s", "x"], preferred="pie").kind == "pie" and first(["s", "y"], preferred="pie").kind == "bar"
    boxes = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0)], "k string, min_x double, q1 double, median double, q3 double, max_x double")
    box = charts.choose(boxes, "boxplot")[0]
    assert (box.kind, box.x, box.y) == ("boxplot", "k", None)
    assert charts.marks(boxes, box).columns == ["k", "least", "q1", "median", "q3", "most"]


def test_questions_name_axes_and_fields(spark):
    from brightcask.functions import wording

    assert wording.on_axis(["month", "event_type"], "heatmap with month on x and event type on y", "x") == "month"
    assert wording.on_axis(["month", "event_type"], "heatmap with month on x and event type on y", "y") == "event_type"
    assert wording.on_axis(["месяц", "тип"], "по оси X месяц, по оси Y тип", "y") == "тип"
    assert wording.on_axis(["month"], "months of sales", "x") is None
    assert wording.meant(["n_orders", "revenue"], "sales by nation") == "revenue"
    df = spark.createDataFrame([("min and max price",), ("average price",), (None,), ("минимальная и средняя цена",)], "q string")
    assert [r[0] for r in df.select(wording.several_statistics(df.q)).collect()] == [True, False, False, True]


def test_spec_types_axes(spark):
    df = spark.createDataFrame([(2020 + i, f"a rather long name {i}", float(i)) for i in range(3)], "year int, name string, x double")
    by_year = charts.spec(df.select("year", "x"), charts.Candidate("line", "year", "x"))
    assert by_year["encoding"]["x"]["type"] == "ordinal" and by_year["encoding"]["y"]["type"] == "quantitative" and not by_year["truncated"]
    assert charts.spec(df.select("name", "x"), charts.Candidate("bar", "name", "x"))["encoding"]["x"] == {"field": "name", "type": "nominal", "turned": True}


def test_answers_correct_what_is_mistyped(spark):
    from brightcask.operators.semantics import KEYS, SALES
    from brightcask.plans import answers

    source = catalog.folder("sales", "/root/testdata/sf0.001", SALES)
    count = lambda *filters: Question([Measure("n", "customer")], by=[("customer", "c_mktsegment")], filters=list(filters))
    good = answers.answer(spark, source, KEYS, count())
    assert good.status == "success" and good.n_rows == 5 and not good.corrections and {f.role for f in good.fields} == {"dimension", "measure"}
    column = answers.answer(spark, source, KEYS, Question([Measure("n", "customer")], by=[("customer", "c_mktsegmnet")]))
    assert column.corrections == [("c_mktsegmnet", "c_mktsegment")] and column.rows and column.n_rows == 5
    value = answers.answer(spark, source, KEYS, count(("customer", "c_mktsegment = 'BUIDLING'")))
    assert value.corrections == [("BUIDLING", "BUILDING")] and [r["c_mktsegment"] for r in value.rows] == ["BUILDING"]
    none = answers.answer(spark, source, KEYS, count(("customer", "c_mktsegment = 'nothing of the kind'")))
    assert (none.status, none.error.code, none.rows) == ("failed", "empty_result", [])
    bad = answers.answer(spark, source, KEYS, Question([Measure("n", "customer")], by=[("customer", "quite_another_thing")]))
    assert (bad.status, bad.error.code) == ("failed", "sql_execution_failed")
    lost = answers.answer(spark, source, [], Question([Measure("n", "orders")], by=[("part", "p_brand")]))
    assert lost.error.code == "ambiguous_query"
    long = answers.answer(spark, source, KEYS, Question([Measure("n", "orders")], by=[("orders", "o_custkey")]), inline=3)
    assert long.status == "partial_success" and len(long.rows) == 3 < long.n_rows and long.warnings[0].code == "row_limit_exceeded"


def test_completed_metadata(spark):
    from brightcask.plans import answers
    from brightcask.plans.profile import FieldProfile

    df = spark.createDataFrame([(2024, 1.0, "x")], "order_year int, total double, k string").selectExpr("*", "interval 1 day as gap")
    given = [FieldProfile("order_year", "number", "measure", None, ("sum",), "sum"), FieldProfile("total", "number", "measure", None, ("none",), "none"), FieldProfile("gone", "number", "measure", None, (), "sum")]
    fields, warnings = answers.completed(df, given)
    by = {f.name: f for f in fields}
    assert by["order_year"].role == "time" and by["order_year"].default == "none" and by["total"].default == "none" and by["k"].role == "dimension"
    assert [w.code for w in warnings] == ["metadata_incomplete"] * 2
    assert answers.missing_columns(df, ["K", "nope"]) == ["nope"]


HOME = "reflect('java.lang.System', 'getProperty', 'user.home')"


@pytest.mark.parametrize(
    "text",
    [f"select 1 --\r, {HOME} as h", f"select r'\\', {HOME} as h, 'x'", f'select R"\\", {HOME} as h, "x"', f"select id as `a'b`, {HOME} as h, id as `c'd` from range(1)", f"select (select max({HOME}) from range(1)) as h", f"select `try_reflect`{HOME[7:]}"],
)
def test_statements_that_call_the_jvm_are_refused(spark, text):
    got = admission.run(spark, text)
    assert got.rows == [] and got.error.startswith("sql_validation_failed")


def test_a_call_is_seen_in_the_plan(spark):
    assert admission.reaches_out(spark.sql(f"select * from range(3) where id in (select length({HOME}) from range(2))"))
    assert not admission.reaches_out(spark.sql("select 'expressions.CallMethodViaReflection' as s, max(id) from range(3)"))


@pytest.mark.parametrize("text", ["select r'a\\' as x", "select 'it''s' as x -- reflect(\n", "select 1 as `drop` /* delete */", "select 'a\\'b; drop' as x"])
def test_what_only_looks_like_more_is_admitted(spark, text):
    assert admission.run(spark, text).error is None


def test_only_names_without_a_column_are_corrected():
    from brightcask.plans.answers import renamed

    text = "is_t is null and t > 1 and `t` < 2 and max(t) = t(1) and x = 't' and r't' = 't.t'"
    assert renamed(text, "t", "tt") == "is_t is null and `tt` > 1 and `tt` < 2 and max(`tt`) = t(1) and x = 't' and r't' = 't.t'"


def test_scatter_is_bounded_and_counts_every_row(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in rng.normal(0, 1, (4000, 2))] + [(7.0, 7.0)] * 500 + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    got = transforms.scatter(df, "a", "b", bins=10, points=2).collect()
    assert len(got) <= 12 * 12 * 2 and sum({(r.x_bin, r.y_bin): r.n for r in got}.values()) == 4500
    assert sorted(map(tuple, got)) == sorted(map(tuple, transforms.scatter(df.repartition(7), "a", "b", bins=10, points=2).collect()))
    assert transforms.scatter(df.filter("false"), "a", "b").collect() == []


def test_scatter_charts_take_a_dimension_and_thin_out_large_results(spark):
    few = spark.createDataFrame([(c, float(i)) for i, c in enumerate("abcabc")], "kind string, size double")
    assert charts.choose(few, "correlation")[0] == charts.Candidate("scatter", "kind", "size", None, "asked")
    assert charts.marks(few, charts.choose(few, "correlation")[0]).count() == 6
    many = spark.range(charts.POINTS + 1).selectExpr("cast(id as double) as width", "cast(id % 100 as double) as height")
    shown = charts.marks(many, charts.choose(many, "correlation")[0])
    assert {"n", "x_bin", "width", "height"} <= set(shown.columns) and shown.count() <= 32 * 32 * 3


def test_origins_go_along_with_columns(spark):
    source = catalog.folder("s", "/root/testdata/sf0.001", ["orders"])
    df = ask(spark, source, [], Question([Measure("income", "orders", "o_totalprice", "sum", "USD")], by=[("orders", "o_orderstatus")]))
    later = df.filter("income > 0").orderBy("income").limit(2).withColumn("more", df["income"] + 1)
    assert profile.origin(later.schema["income"]) == {"table": "orders", "expression": "o_totalprice", "how": "sum", "unit": "USD"} and profile.origin(later.schema["more"]) == {}
    by = {p.name: p.default for p in profile.profiles(later)}
    assert by == {"o_orderstatus": "count", "income": "none", "more": "sum"}
    assert charts.marks(df, charts.Candidate("bar", "o_orderstatus", "income")).count() == df.count()


def test_a_line_is_shown_whole_and_in_order(spark):
    days = spark.sql("select date_add(date'2020-01-01', cast(id as int)) as day, cast(id as double) as value from range(400)").repartition(7)
    shown = charts.spec(days, charts.Candidate("line", "day", "value"))
    assert len(shown["values"]) == 400 == shown["n_marks"] and not shown["truncated"] and [v["value"] for v in shown["values"]] == [float(i) for i in range(400)]
    many = spark.range(250).selectExpr("concat('c', id) as c", "cast(id as double) as size").repartition(5)
    shown = charts.spec(many, charts.Candidate("bar", "c", "size"))
    assert (shown["truncated"], shown["n_marks"], len(shown["values"])) == (True, 250, 100) and [v["size"] for v in shown["values"]] == [float(i) for i in range(249, 149, -1)]


def test_distinct_values_are_counted_exactly_as_far_as_forms_need(spark):
    for n in (1, 8, 9, 40, 41):
        assert charts.looked_at(spark.range(500).selectExpr(f"concat('v', id % {n}) as kind", "cast(id as double) as size")).distinct["kind"] == n


def test_a_reply_keeps_its_table_and_chart(spark, tmp_path):
    from brightcask.plans.reply import reply, with_period
    from brightcask.sources.artifacts import Artifacts

    source, kept = catalog.folder("s", "/root/testdata/sf0.001", ["orders"]), Artifacts(f"{tmp_path}/kept")
    q = Question([Measure("total", "orders", "o_totalprice", "sum")], by=[("orders", "o_orderpriorty")])
    got = reply(spark, source, [], q, "Share of each priority", kept=kept)
    assert (got.intent, got.chart["mark"], got.outcome.status) == ("part_to_whole", "pie", "success") and got.outcome.corrections == [("o_orderpriorty", "o_orderpriority")]
    assert kept.load(spark, got.artifacts["chart_spec"])["mark"] == "pie" and kept.load(spark, got.artifacts["table"]).count() == 5
    got = reply(spark, source, [], Question([Measure("n", "orders")], by=[("orders", "o_orderstatus")], filters=[("orders", "o_totalprice < 0")]), "How many?", kept=kept)
    assert got.chart is None and got.outcome.error.code == "empty_result" and kept.load(spark, got.artifacts["error"])["code"] == "empty_result"
    bad = spark.createDataFrame([(2020, 13, 1.0)], "order_year int, order_month int, total double")
    assert with_period(bad).columns == bad.columns and with_period(bad.withColumn("order_month", F.lit(12))).columns == ["total", "period"]


def test_several_statistics_in_a_question():
    from brightcask.functions.wording import asks_several

    assert asks_several("Min and max price") and asks_several("средняя и максимальная цена") and not asks_several("the maximum, the most") and not asks_several("") and not asks_several("administrator maxima")

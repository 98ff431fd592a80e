"""Chart data over the tables, and the choice of a chart by the result's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.operators.registry import Tables, query
from brightcask.plans import charts, transforms


@query("select o_orderpriority, round(sum(o_totalprice), 2) as o_totalprice from orders group by 1")
def bar_sum(t: Tables) -> DataFrame:
    return transforms.bars(t.orders, "o_orderpriority", "o_totalprice")


@query("""with e as (select max(c_acctbal) - min(c_acctbal) as span from customer), r as (select span / 20 as raw, pow(10, floor(log10(span / 20))) as p from e),
          s as (select p * case when raw / p <= 1 then 1 when raw / p <= 2 then 2 when raw / p <= 5 then 5 else 10 end as step from r)
          select floor(c_acctbal / step) * step as bin_start, (floor(c_acctbal / step) + 1) * step as bin_end, count(*) as n from customer, s group by 1, 2""")
def histogram_bins(t: Tables) -> DataFrame:
    return transforms.histogram(t.customer, "c_acctbal")


@query("""select c_mktsegment, min(c_acctbal) as least, round(quantile_cont(c_acctbal, 0.25), 4) as q1, round(quantile_cont(c_acctbal, 0.5), 4) as median, round(quantile_cont(c_acctbal, 0.75), 4) as q3, max(c_acctbal) as most from customer group by 1""")
def boxplot_stats(t: Tables) -> DataFrame:
    return transforms.boxplot(t.customer, "c_acctbal", ["c_mktsegment"])


@query("select o_orderstatus, round(sum(o_totalprice), 2) as o_totalprice, round(sum(o_totalprice) / (select sum(o_totalprice) from orders), 6) as share from orders group by 1")
def share_of_total(t: Tables) -> DataFrame:
    return transforms.shares(t.orders, "o_orderstatus", "o_totalprice")


@query("""with p as (select o_orderpriority, o_orderstatus, sum(o_totalprice) as y from orders group by 1, 2),
          w as (select *, sum(y) over (partition by o_orderpriority order by o_orderstatus nulls first rows unbounded preceding) as top from p)
          select o_orderpriority, o_orderstatus, round(top - y, 2) as y0, round(top, 2) as y1 from w""")
def stacked_breakdown(t: Tables) -> DataFrame:
    return transforms.stack(t.orders, "o_orderpriority", "o_totalprice", "o_orderstatus")


@query("""with m as (select c_mktsegment, min(c_acctbal) as least, max(c_acctbal) as most from customer group by 1)
          select c_mktsegment, 'least' as series, least as value from m union all select c_mktsegment, 'most', most from m""")
def fold_wide_long(t: Tables) -> DataFrame:
    wide = t.customer.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))
    return transforms.fold(wide, "c_mktsegment", ["least", "most"])


@query("select date_trunc('year', o_orderdate)::timestamp as year, o_orderstatus, count(*) as n_orders from orders group by 1, 2")
def multi_line_series(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("year"), "o_orderstatus").agg(F.count("*").alias("n_orders"))


@query("select isodow(ts)::bigint as weekday, hour(ts)::bigint as hour, count(*) as n_events, round(avg(value), 4) as mean_value from events group by 1, 2")
def weekday_hour_heatmap(t: Tables) -> DataFrame:
    cell = [(F.weekday("ts") + 1).cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")]
    return t.events.groupBy(*cell).agg(F.count("*").alias("n_events"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("select p_size, p_retailprice from part")
def scatter_pairs(t: Tables) -> DataFrame:
    return t.part.select("p_size", "p_retailprice")


@query("""select c_mktsegment, min(c_acctbal) as least, round(quantile_cont(c_acctbal, 0.25), 4) as q1, round(quantile_cont(c_acctbal, 0.5), 4) as median, round(quantile_cont(c_acctbal, 0.75), 4) as q3, max(c_acctbal) as most from customer group by 1""")
def boxplot_of_given_quartiles(t: Tables) -> DataFrame:
    """A result that holds quartiles already goes into its boxes as it is."""
    given = boxplot_stats(t).withColumnsRenamed({"least": "min_balance", "q1": "balance_q1", "q3": "balance_q3", "most": "max_balance"})
    return charts.marks(given, next(c for c in charts.choose(given, "boxplot") if c.kind == "boxplot"))


@query("""with y as (select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n_orders from orders group by 1, 2)
          select y, m, n_orders, make_date(y, m, 1) as period from y""")
def period_axis(t: Tables) -> DataFrame:
    months = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count("*").alias("n_orders"))
    return transforms.period(months, "y", "m")


@query("""select * from (values ('by segment', 'comparison', 'bar'), ('over months', 'trend', 'line'), ('months by status', 'trend', 'multi_line'), ('shares', 'part_to_whole', 'pie'),
          ('balances', 'histogram', 'histogram'), ('balances by segment', 'boxplot', 'boxplot'), ('size and price', 'correlation', 'scatter'), ('weekday and hour', 'heatmap', 'heatmap'), ('stacked', 'composition', 'stacked_bar'), ('listing', 'table', 'table'), ('area', 'area', 'area'), ('over months', 'unknown', 'line'), ('months by status', 'comparison', 'bar'), ('months by status', 'top_n', 'bar'), ('months by status', 'area', 'area'), ('size and price', 'unknown', 'scatter'), ('quartiles', 'boxplot', 'boxplot'), ('names', 'unknown', 'table')) v(result, intent, chart)""")
def chart_selection_cases(t: Tables) -> DataFrame:
    """The chart chosen for each of these results and intents."""
    orders, customers = t.orders, t.customer
    cases = [
        ("by segment", "comparison", group_of(customers, "c_mktsegment")),
        ("over months", "trend", time_series(t, [])),
        ("months by status", "trend", time_series(t, ["o_orderstatus"])),
        ("shares", "part_to_whole", group_of(orders, "o_orderstatus")),
        ("balances", "histogram", customers.select("c_acctbal")),
        ("balances by segment", "boxplot", customers.select("c_mktsegment", "c_acctbal")),
        ("size and price", "correlation", t.part.select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")),
        ("weekday and hour", "heatmap", weekday_hour_heatmap(t).select(F.col("weekday").cast("string").alias("weekday_name"), F.col("hour").cast("string").alias("hour_name"), "mean_value")),
        ("stacked", "composition", orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))),
        ("listing", "table", customers.select("c_name", "c_acctbal")),
        ("area", "area", time_series(t, [])),
        ("over months", "unknown", time_series(t, [])),
        *[("months by status", i, time_series(t, ["o_orderstatus"])) for i in ("comparison", "top_n", "area")],
        ("size and price", "unknown", t.part.select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")),
        ("quartiles", "boxplot", boxplot_stats(t)),
        ("names", "unknown", t.nation.select("n_name")),
    ]
    rows = [(name, intent, charts.choose(df, intent)[0].kind) for name, intent, df in cases]
    return t.spark.createDataFrame(rows, "result string, intent string, chart string")


def group_of(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").cast("double").alias("amount"))


def time_series(t: Tables, more: list[str]) -> DataFrame:
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), *more).agg(F.sum("o_totalprice").alias("total"))


CELLS = """e as (select min({x}) as xl, max({x}) as xh, min({y}) as yl, max({y}) as yh from {t}), r as (select (xh - xl) / 30 as xr, (yh - yl) / 30 as yr, pow(10, floor(log10((xh - xl) / 30))) as xp, pow(10, floor(log10((yh - yl) / 30))) as yp from e),
          s as (select xp * case when xr / xp <= 1 then 1 when xr / xp <= 2 then 2 when xr / xp <= 5 then 5 else 10 end as xs, yp * case when yr / yp <= 1 then 1 when yr / yp <= 2 then 2 when yr / yp <= 5 then 5 else 10 end as ys from r)"""


@query(f"""with {CELLS.format(x="l_quantity", y="l_extendedprice", t="lineitem")},
          c as (select floor(l_quantity / xs) * xs as x_bin, floor(l_extendedprice / ys) * ys as y_bin, l_quantity as x, l_extendedprice as y, md5(l_orderkey || ',' || l_linenumber || ',' || l_partkey) as draw from lineitem, s)
          select x_bin, y_bin, count(*) over (partition by x_bin, y_bin) as n, row_number() over (partition by x_bin, y_bin order by draw, x, y) as place, x, y from c qualify place <= 3""")
def scatter_density(t: Tables) -> DataFrame:
    """Every line by quantity and price: a bounded number of marks, whatever the number of rows."""
    return transforms.scatter(t.lineitem, "l_quantity", "l_extendedprice", key=["l_orderkey", "l_linenumber", "l_partkey"])


@query(f"""with {CELLS.format(x="c_nationkey", y="c_acctbal", t="customer")},
          c as (select c_mktsegment as x_bin, floor(c_acctbal / ys) * ys as y_bin, c_mktsegment as x, c_acctbal as y, md5(c_custkey::varchar) as draw from customer, s)
          select x_bin, y_bin, count(*) over (partition by x_bin, y_bin) as n, row_number() over (partition by x_bin, y_bin order by draw, x, y) as place, x, y from c qualify place <= 3""")
def scatter_of_a_dimension(t: Tables) -> DataFrame:
    """A measure's values by category."""
    return transforms.scatter(t.customer, "c_mktsegment", "c_acctbal", key=["c_custkey"])

"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightcask.operators.registry import Tables, query
from brightcask.plans.ordering import numbered, ranked


@query("""select p_partkey, p_brand, row_number() over w as row_no, rank() over w2 as rank_no, dense_rank() over w2 as dense_no, ntile(4) over w as quarter, round(percent_rank() over w2, 6) as pct
          from part window w as (partition by p_brand order by p_retailprice desc, p_partkey), w2 as (partition by p_brand order by p_size)""")
def window_rank(t: Tables) -> DataFrame:
    w, w2 = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"), Window.partitionBy("p_brand").orderBy("p_size")
    out = {"row_no": F.row_number().over(w), "rank_no": F.rank().over(w2), "dense_no": F.dense_rank().over(w2), "quarter": F.ntile(4).over(w)}
    return t.part.select("p_partkey", "p_brand", *[c.cast("long").alias(n) for n, c in out.items()], F.round(F.percent_rank().over(w2), 6).alias("pct"))


@query("""select o_orderkey, o_custkey, lag(o_totalprice) over w as before, lead(o_totalprice) over w as after, first_value(o_totalprice) over w as first,
          last_value(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as last
          from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def window_lag(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = "o_totalprice"
    return t.orders.select("o_orderkey", "o_custkey", F.lag(p).over(w).alias("before"), F.lead(p).over(w).alias("after"), F.first(p).over(w).alias("first"), F.last(p).over(whole).alias("last"))


@query("""with m as (select date_trunc('month', o_orderdate)::timestamp as month, round(sum(o_totalprice), 2) as total from orders group by 1)
          select month, total, round(sum(total) over (order by month rows unbounded preceding), 2) as running from m""")
def window_running_sum(t: Tables) -> DataFrame:
    """The window has no key, but one row for each month."""
    months = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return months.withColumn("running", F.round(F.sum("total").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)), 2))


@query("""select event_id, user_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as moving_avg,
          count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as in_last_hour from events""")
def window_moving_avg(t: Tables) -> DataFrame:
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    hour = F.expr("count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row)")
    return t.events.select("event_id", "user_id", F.round(F.avg("value").over(rows), 6).alias("moving_avg"), hour.alias("in_last_hour"))


@query("select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) where r <= 3")
def window_topn_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("select c_custkey, c_mktsegment, round(c_acctbal / sum(c_acctbal) over (partition by c_mktsegment), 8) as share from customer")
def window_ratio_to_total(t: Tables) -> DataFrame:
    """The totals are an aggregate, met by every row: no segment's rows are gathered in one task."""
    totals = t.customer.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("total"))
    return t.customer.join(totals, "c_mktsegment").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") / F.col("total"), 8).alias("share"))


@query("""select o_orderkey, row_number() over w as row_no, ntile(7) over w as tile, round(sum(o_totalprice) over (w rows unbounded preceding), 2) as running from orders window w as (order by o_totalprice desc, o_orderkey)""")
def window_numbers_of_all(t: Tables) -> DataFrame:
    """Row numbers, tiles and running sums in one order of the whole table."""
    out = numbered(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)], "row_no", {"tile": 7}, {"running": "o_totalprice"})
    return out.select("o_orderkey", "row_no", "tile", F.round("running", 2).alias("running"))


@query("""select l_orderkey, l_linenumber, rank() over w as rank_no, dense_rank() over w as dense_no, round(percent_rank() over w, 9) as pct, round(cume_dist() over w, 9) as cume from lineitem window w as (order by l_quantity, l_shipdate desc)""")
def window_ranks_of_all(t: Tables) -> DataFrame:
    """Ranks over the whole table, shared by rows with equal keys."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    out = ranked(lines, [("l_quantity", True), ("l_shipdate", False)], "rank_no", "dense_no", "pct", "cume")
    return out.select("l_orderkey", "l_linenumber", "rank_no", "dense_no", F.round("pct", 9).alias("pct"), F.round("cume", 9).alias("cume"))


@query("select event_id, ntile(100) over w as percentile, round(sum(value) over (w rows unbounded preceding), 4) as running from events window w as (order by ts, event_id)")
def window_running_sum_of_all(t: Tables) -> DataFrame:
    """The running total of every event since the first, and the hundredth of the stream that it lies in."""
    return numbered(t.events.select("event_id", "ts", "value"), [("ts", True), ("event_id", True)], "n", {"percentile": 100}, {"running": "value"}).select("event_id", "percentile", F.round("running", 4).alias("running"))

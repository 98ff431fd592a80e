"""Aggregations: counts, sums, several at once, two levels, having, quantiles, grouping sets, ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightcask.operators.registry import Tables, query
from brightcask.plans import transforms


def revenue():
    return F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("select count(*) as n_customers from customer")
def count_all(t: Tables) -> DataFrame:
    return t.customer.agg(F.count("*").alias("n_customers"))


@query("select count(*) as n_orders, count(o_orderpriority) as n_with_priority from orders where o_orderstatus = 'F'")
def count_filtered(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").agg(F.count("*").alias("n_orders"), F.count("o_orderpriority").alias("n_with_priority"))


@query("select c_mktsegment, count(*) as n_customers from customer group by c_mktsegment")
def group_count(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n_customers"))


@query("select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by l_returnflag")
def group_sum_expr(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(revenue(), 2).alias("revenue"))


@query("select c_mktsegment, min(c_acctbal) as least, round(avg(c_acctbal), 4) as mean, max(c_acctbal) as most from customer group by c_mktsegment")
def multi_aggregate(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("least"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.max("c_acctbal").alias("most"))


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
          round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n_lines from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    lines = t.lineitem.filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(charge), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n_lines"))


@query("""select c_mktsegment, round(min(spent), 2) as least, round(avg(spent), 2) as mean, round(max(spent), 2) as most from
          (select o_orderkey, c_mktsegment, sum(l_extendedprice * (1 - l_discount)) as spent from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2) group by 1""")
def two_level_aggregate(t: Tables) -> DataFrame:
    """Revenue per order first, then least, mean and most of it per segment."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(revenue().alias("spent"))
    met = per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy("c_mktsegment").agg(*[F.round(f("spent"), 2).alias(n) for n, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])


@query("select c_mktsegment, count(*) as n_customers from customer group by 1 having count(*) > 295")
def having_agg(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n_customers")).filter("n_customers > 295")


@query("select o_orderpriority, round(sum(o_totalprice), 2) as total from orders group by 1 having round(sum(o_totalprice), 2) > 1000000")
def having_alias(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).filter("total > 1000000")


@query("select c_custkey, c_acctbal from customer where c_acctbal > (select avg(c_acctbal) from customer)")
def scalar_subquery(t: Tables) -> DataFrame:
    """The average is one row, met by every customer."""
    mean = t.customer.agg(F.avg("c_acctbal").alias("mean"))
    return t.customer.crossJoin(F.broadcast(mean)).filter("c_acctbal > mean").select("c_custkey", "c_acctbal")


@query("""with b as (select p_brand, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem join part on l_partkey = p_partkey group by 1)
          select p_brand, round(revenue, 2) as revenue from b where revenue > (select avg(revenue) from b)""")
def above_average_groups(t: Tables) -> DataFrame:
    brands = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(revenue().alias("revenue"))
    mean = F.avg("revenue").over(Window.partitionBy())  # one row for each brand
    return brands.withColumn("mean", mean).filter("revenue > mean").select("p_brand", F.round("revenue", 2).alias("revenue"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def exists_subquery(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""select c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) as q1, round(quantile_cont(c_acctbal, 0.5), 4) as median, round(quantile_cont(c_acctbal, 0.75), 4) as q3 from customer group by 1""")
def quantiles(t: Tables) -> DataFrame:
    found = transforms.quantiles(t.customer, "c_acctbal", ["c_mktsegment"], (0.25, 0.5, 0.75))
    return found.select("c_mktsegment", *[F.round(f"q{i}", 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


@query("""select extract(year from o_orderdate) as year, o_orderstatus, count(*) as n_orders from orders group by extract(year from o_orderdate), o_orderstatus""")
def group_by_expression(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus").agg(F.count("*").alias("n_orders"))


GROUPS = "from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def _placed(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))


@query(f"select r_name, n_name, count(*) as n_customers, grouping(r_name) + grouping(n_name) as level {GROUPS} group by rollup (r_name, n_name)")
def rollup(t: Tables) -> DataFrame:
    return _placed(t).rollup("r_name", "n_name").agg(F.count("*").alias("n_customers"), (F.grouping("r_name") + F.grouping("n_name")).cast("long").alias("level"))


@query(f"select r_name, c_mktsegment, count(*) as n_customers {GROUPS} group by cube (r_name, c_mktsegment)")
def cube(t: Tables) -> DataFrame:
    return _placed(t).cube("r_name", "c_mktsegment").agg(F.count("*").alias("n_customers"))


@query(f"select r_name, c_mktsegment, count(*) as n_customers {GROUPS} group by grouping sets ((r_name), (c_mktsegment), ())")
def grouping_sets(t: Tables) -> DataFrame:
    sets = [[F.col("r_name")], [F.col("c_mktsegment")], []]
    return _placed(t).groupingSets(sets, "r_name", "c_mktsegment").agg(F.count("*").alias("n_customers"))


@query("""select p_brand, count(*) filter (l_returnflag = 'R') as n_returned, round(count(*) filter (l_returnflag = 'R') / count(*), 6) as return_rate,
          sum(l_extendedprice) / nullif(sum(case when l_quantity < 0 then 1 else 0 end), 0) as undefined from lineitem join part on l_partkey = p_partkey group by 1""")
def ratio_safe_divide(t: Tables) -> DataFrame:
    """Ratios that are null, not an error, where they divide by zero."""
    returned = F.count_if(F.col("l_returnflag") == "R")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand")
    return lines.agg(returned.alias("n_returned"), F.round(F.try_divide(returned, F.count("*")), 6).alias("return_rate"), F.try_divide(F.sum("l_extendedprice"), F.count_if(F.col("l_quantity") < 0)).alias("undefined"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
          join nation on c_nationkey = n_nationkey group by n_name order by revenue desc, n_name limit 5""")
def topn_measure(t: Tables) -> DataFrame:
    """Lines are summed by customer before the dimension joins, so those meet one row per customer."""
    spent = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(revenue().alias("spent"))
    by = spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return by.groupBy("n_name").agg(F.round(F.sum("spent"), 2).alias("revenue")).orderBy(F.desc("revenue"), "n_name").limit(5)

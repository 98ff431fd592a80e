"""Joins. Sides are left to the optimiser: it broadcasts what its statistics prove small and sorts and merges the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightcask.operators.registry import Tables, query
from brightcask.plans.intervals import micros, overlapping, sums_within


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey")
def join_two(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("""select r_name, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
          from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
          join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
def join_multihop(t: Tables) -> DataFrame:
    """Lines are summed by order, orders by customer and customers by nation, each before the join to the next table."""
    sums = [F.sum("n_lines").alias("n_lines"), F.sum("revenue").alias("revenue")]
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    per_customer = per_order.join(t.orders, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*sums)
    per_nation = per_customer.join(t.customer, "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(*sums)
    places = per_nation.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return places.groupBy("r_name").agg(F.sum("n_lines").alias("n_lines"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by c_custkey")
def join_left_zero(t: Tables) -> DataFrame:
    """Customers without orders count zero. Orders are counted before the join, so it meets one row per customer."""
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"))


@query("""select p_brand, count(distinct l_suppkey) as n_suppliers from part join lineitem on p_partkey = l_partkey group by p_brand""")
def count_distinct_m2n(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("""with o as (select o_custkey, round(sum(o_totalprice), 2) as spent from orders group by o_custkey)
          select c_name, c_mktsegment, spent from o join customer on o_custkey = c_custkey""")
def join_cte_back(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "c_mktsegment", "spent")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_semi(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 200000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select r_name, flag from region cross join (values ('A'), ('N'), ('R')) v(flag)")
def join_cross(t: Tables) -> DataFrame:
    """Five regions and three flags: both sides are of a fixed size."""
    flags = t.spark.createDataFrame([("A",), ("N",), ("R",)], "flag string")
    return t.region.select("r_name").crossJoin(flags)


@query("""with c as (select c_nationkey as k, count(*) as n_customers from customer where c_acctbal > 9000 group by 1),
          s as (select s_nationkey as k, count(*) as n_suppliers from supplier group by 1)
          select coalesce(c.k, s.k) as nationkey, coalesce(n_customers, 0) as n_customers, coalesce(n_suppliers, 0) as n_suppliers from c full join s on c.k = s.k""")
def join_full(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nationkey", "full").fillna(0, ["n_customers", "n_suppliers"])


@query("select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 8000")
def join_right(t: Tables) -> DataFrame:
    return t.supplier.filter("s_acctbal > 8000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


BANDS = [("low", 0.0, 1000.0), ("middle", 1000.0, 1500.0), ("high", 1500.0, 1e12)]


@query("""select band, count(*) as n_parts from part join (values ('low', 0.0, 1000.0), ('middle', 1000.0, 1500.0), ('high', 1500.0, 1e12)) b(band, lo, hi)
          on p_retailprice >= lo and p_retailprice < hi group by band""")
def join_theta_range(t: Tables) -> DataFrame:
    """Parts by price band; the three bands are the broadcast side of the inequality."""
    bands = t.spark.createDataFrame(BANDS, "band string, lo double, hi double")
    return t.part.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).groupBy("band").agg(F.count("*").alias("n_parts"))


@query("""select a.o_custkey as custkey, a.o_orderkey as first_order, b.o_orderkey as second_order from orders a join orders b
          on a.o_custkey = b.o_custkey and date_trunc('month', a.o_orderdate) = date_trunc('month', b.o_orderdate) and a.o_orderkey < b.o_orderkey""")
def join_self(t: Tables) -> DataFrame:
    """Orders of one customer in one month: a key of few rows each."""
    of = lambda name: t.orders.select(F.col("o_custkey").alias("custkey"), F.date_trunc("month", "o_orderdate").alias("month"), F.col("o_orderkey").alias(name))
    return of("first_order").join(of("second_order"), ["custkey", "month"]).filter("first_order < second_order").drop("month")


@query("select vec_id, pos - 1 as pos, x from (select vec_id, unnest(range(1, 5)) as pos, unnest(embedding[1:4]) as x from embeddings)")
def lateral_unnest(t: Tables) -> DataFrame:
    """Array elements with their position."""
    return t.embeddings.select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), "x")


@query("""select e.event_id, e.user_id, (select max(p.ts) from events p where p.user_id = e.user_id and p.event_type = 'view' and p.ts <= e.ts) as last_view
          from events e where e.event_type = 'purchase'""")
def join_as_of(t: Tables) -> DataFrame:
    """The user's last view at or before each purchase: a window over both kinds, so no pairs are made."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w)
    return t.events.filter("event_type in ('view', 'purchase')").select("event_id", "user_id", "event_type", seen.alias("last_view")).filter("event_type = 'purchase'").drop("event_type")


HALF_HOUR = 30 * 60 * 1_000_000


@query("""select p.event_id as purchase_id, count(*) as n_near, count(*) filter (e.user_id = p.user_id) as n_own, round(sum(e.value), 4) as total from events p join events e
          on e.ts between p.ts - interval 30 minutes and p.ts + interval 30 minutes where p.event_type = 'purchase' group by 1""")
def join_interval(t: Tables) -> DataFrame:
    """What happened within half an hour of each purchase, anywhere: two large tables with no key in common. Pairs grow with the square of the
    events of an hour, so none are made: counts and sums are found for each time and joined to the purchases. Values are summed exactly, up to
    10^16 each; those that are no finite numbers are counted."""
    x = F.col("value")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    events = t.events.select(
        "event_id", "user_id", "event_type", micros(F.col("ts")).alias("at"), F.lit(1).alias("n_near"), F.lit(1).alias("n_own"), F.when(finite, x.cast("decimal(30,14)")).alias("total"), x.isNotNull().cast("int").alias("held"),
        *[F.coalesce(is_one.cast("int"), F.lit(0)).alias(c) for c, is_one in (("none", F.isnan(x)), ("above", x == float("inf")), ("below", x == float("-inf")))],
    )
    sums = ["n_near", "total", "held", "none", "above", "below"]
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "at")
    near = sums_within(purchases, events, "at", HALF_HOUR, sums)
    own = sums_within(purchases, events, "at", HALF_HOUR, ["n_own"], ["user_id"])
    met = purchases.join(near, "at").join(own, ["user_id", "at"], "left").groupBy(F.col("event_id").alias("purchase_id")).agg(*[F.sum(c).alias(c) for c in sums], F.coalesce(F.sum("n_own"), F.lit(0)).alias("n_own"))
    odd = F.when((F.col("none") > 0) | (F.col("above") > 0) & (F.col("below") > 0), float("nan")).when(F.col("above") > 0, float("inf")).when(F.col("below") > 0, float("-inf"))
    return met.select("purchase_id", "n_near", "n_own", F.when(F.col("held") > 0, F.coalesce(odd, F.round(F.col("total").cast("double"), 4))).alias("total"))


@query("""with o as (select o_orderkey, o_custkey, o_orderdate as opened, max(l_shipdate) as closed from orders join lineitem on l_orderkey = o_orderkey group by all)
          select a.o_custkey as custkey, count(*) as n_pairs, count(distinct a.o_orderkey) as n_orders from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.opened <= b.closed and b.opened <= a.closed and a.opened <= a.closed and b.opened <= b.closed group by 1""")
def join_overlapping_periods(t: Tables) -> DataFrame:
    """Orders of one customer that were open at once, from the order to the last shipment: intervals of any length, with a key."""
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    o = t.orders.join(shipped, "o_orderkey").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("opened"), micros(F.col("closed")).alias("closed"))
    span = (F.col("opened"), F.col("closed"))
    met = overlapping(o, o, span, span, 7 * 24 * 2 * HALF_HOUR, [("o_custkey", "o_custkey")]).filter("l.o_orderkey < r.o_orderkey")
    return met.groupBy(F.col("l.o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("l.o_orderkey").alias("n_orders"))

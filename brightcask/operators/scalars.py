"""Scalar functions: dates, strings, numbers, arrays, JSON, casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.operators.registry import Tables, query


@query("select date_trunc('month', o_orderdate)::timestamp as month, count(*) as n_orders from orders group by 1")
def time_series_month(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n_orders"))


@query("select date_trunc('quarter', o_orderdate)::timestamp as quarter, date_trunc('week', o_orderdate)::timestamp as week, date_trunc('day', o_orderdate)::timestamp as day, count(*) as n from orders group by all")
def time_series_grains(t: Tables) -> DataFrame:
    return t.orders.groupBy(*[F.date_trunc(g, "o_orderdate").cast("timestamp_ntz").alias(g) for g in ("quarter", "week", "day")]).agg(F.count("*").alias("n"))


@query("select make_date(year(o_orderdate), month(o_orderdate), 1) as period, count(*) as n_orders from orders group by 1")
def year_month_period(t: Tables) -> DataFrame:
    """Year and month columns as one date axis."""
    return t.orders.groupBy(F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).alias("period")).agg(F.count("*").alias("n_orders"))


@query("select (floor(year(o_orderdate) / 10) * 10)::bigint as decade, count(*) as n_orders from orders group by 1")
def decade_bucket(t: Tables) -> DataFrame:
    return t.orders.groupBy((F.floor(F.year("o_orderdate") / 10) * 10).cast("long").alias("decade")).agg(F.count("*").alias("n_orders"))


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as n_orders from orders group by 1")
def month_text(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_orders"))


@query("select o_orderkey, year(o_orderdate)::bigint as y, month(o_orderdate)::bigint as m, day(o_orderdate)::bigint as d, date_diff('day', o_orderdate, timestamp '2000-01-01')::bigint as days_left, (o_orderdate + interval 1 month)::timestamp as next_month from orders")
def date_parts(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.day(d).cast("long").alias("d"), F.date_diff(F.lit("2000-01-01").cast("date"), d).cast("long").alias("days_left"), F.expr("o_orderdate + interval 1 month").alias("next_month"))


@query("""select o_orderkey, case when o_totalprice > 200000 then 'large' when o_totalprice > 100000 then 'medium' else 'small' end as size_class from orders""")
def case_when(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 200000, "large").when(p > 100000, "medium").otherwise("small").alias("size_class"))


@query("select s_suppkey, coalesce(nullif(s_nationkey, 0), -1) as nation_or_none, coalesce(case when s_acctbal > 0 then s_name end, 'in debt') as who from supplier")
def coalesce_nulls(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.coalesce(F.nullif("s_nationkey", F.lit(0)), F.lit(-1)).alias("nation_or_none"), F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_name")), F.lit("in debt")).alias("who"))


@query("""select c_custkey, c_acctbal::bigint as whole, cast(c_custkey as varchar) as key_text, try_cast(c_mktsegment as integer) as bad_number, cast(c_acctbal as decimal(12, 1))::double as tenths from customer""")
def cast_types(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.expr("cast(bround(c_acctbal) as long)").alias("whole"), F.col("c_custkey").cast("string").alias("key_text"), F.expr("try_cast(c_mktsegment as int)").alias("bad_number"), F.col("c_acctbal").cast("decimal(12,1)").cast("double").alias("tenths"))


@query("""select p_partkey, lower(p_name) as low, upper(p_type) as up, p_name || '/' || p_brand as joined, replace(p_name, 'ring', 'band') as replaced, length(p_name) as n, substr(p_name, 1, 4) as head, trim('  ' || p_brand || ' ') as trimmed, split_part(p_brand, '#', 2) as brand_no, strpos(p_name, ' ') as gap, lpad(p_size::varchar, 4, '0') as padded from part""")
def string_ops(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", F.lower(n).alias("low"), F.upper("p_type").alias("up"), F.concat(n, F.lit("/"), F.col("p_brand")).alias("joined"), F.replace(n, F.lit("ring"), F.lit("band")).alias("replaced"), F.length(n).cast("long").alias("n"), F.substring(n, 1, 4).alias("head"),
        F.trim(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))).alias("trimmed"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"), F.instr(n, " ").cast("long").alias("gap"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
    )


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity as unit, abs(l_discount - 0.05) < 0.011 as near_mean, floor(l_extendedprice)::bigint as low, ceil(l_extendedprice)::bigint as high, l_partkey % 7 as rest, round(sqrt(l_quantity), 6) as root, greatest(l_discount, l_tax) as larger, sign(l_tax - l_discount)::double as side from lineitem""")
def math_ops(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.try_divide(c("l_extendedprice"), c("l_quantity")).alias("unit"), (F.abs(c("l_discount") - 0.05) < 0.011).alias("near_mean"), F.floor("l_extendedprice").alias("low"), F.ceil("l_extendedprice").alias("high"), (c("l_partkey") % 7).alias("rest"), F.round(F.sqrt("l_quantity"), 6).alias("root"), F.greatest("l_discount", "l_tax").alias("larger"), F.signum(c("l_tax") - c("l_discount")).alias("side"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as missing from events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("select label, count(*) as n, round(sum(x), 3) as total from (select label, unnest(embedding) as x from embeddings) group by label")
def posexplode_sum(t: Tables) -> DataFrame:
    return t.embeddings.select("label", F.explode("embedding").alias("x")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 3).alias("total"))


@query("select vec_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) as norm2, round(list_max(embedding)::double, 6) as most, list_contains([1, 2], label) as small from embeddings")
def array_ops(t: Tables) -> DataFrame:
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(sq, 5).alias("norm2"), F.round(F.array_max("embedding").cast("double"), 6).alias("most"), F.array_contains(F.array(F.lit(1), F.lit(2)), F.col("label")).alias("small"))


@query("select o_orderkey, o_orderstatus || ':' || o_orderpriority as of_struct, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as of_map from orders")
def struct_map(t: Tables) -> DataFrame:
    s = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    m = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    return t.orders.withColumn("s", s).select("o_orderkey", F.concat_ws(":", "s.status", "s.priority").alias("of_struct"), F.coalesce(F.try_element_at(m, F.col("o_orderstatus")), F.lit("other")).alias("of_map"))

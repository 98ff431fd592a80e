"""Projections, filters, distinct, order, limit and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightcask.operators.registry import Tables, query


@query("select p_partkey as part_id, p_name as part_name, p_retailprice as price from part")
def project_alias(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("part_name"), F.col("p_retailprice").alias("price"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_extendedprice * (1 - l_discount) as amount from lineitem")
def project_expression(t: Tables) -> DataFrame:
    amount = F.col("l_quantity") * F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount.alias("amount"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def project_first_columns(t: Tables) -> DataFrame:
    orders = t.orders
    return orders.select(*orders.columns[:5])


@query("select 1 as dummy")
def constant_row(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("dummy"))


@query("select o_orderkey, 1 as one, 'orders' as origin, true as kept, null::double as discount, date '1998-08-02' as until, o_orderdate <= date '1998-08-02' as in_time from orders")
def constants_beside_rows(t: Tables) -> DataFrame:
    """Constants of every kind, an unknown one and one that is compared with each row."""
    until = F.lit("1998-08-02").cast("date")
    return t.orders.select("o_orderkey", F.lit(1).alias("one"), F.lit("orders").alias("origin"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("discount"), until.alias("until"), (F.col("o_orderdate") <= until).alias("in_time"))


@query("select * from orders where o_orderstatus = 'F'")
def filter_equal(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus") == "F")


@query("select * from customer where c_acctbal > 5000 and c_acctbal <= 9000")
def filter_compare(t: Tables) -> DataFrame:
    return t.customer.filter((F.col("c_acctbal") > 5000) & (F.col("c_acctbal") <= 9000))


@query("select * from part where p_type is not null and p_size is not null")
def filter_not_null(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type").isNotNull() & F.col("p_size").isNotNull())


@query("select * from part where p_name ilike '%RING%'")
def filter_ilike(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%RING%"))


@query("select * from part where p_name like 's%' and p_type not like 'E%'")
def filter_like(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").like("s%") & ~F.col("p_type").like("E%"))


@query("select * from orders where o_orderpriority in ('1-URGENT', '5-LOW') and o_orderstatus not in ('P')")
def filter_in(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & ~F.col("o_orderstatus").isin("P"))


@query("select vec_id, label from embeddings where label = any([1, 3, 5])")
def filter_any_of_array(t: Tables) -> DataFrame:
    return t.embeddings.filter(F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), F.col("label"))).select("vec_id", "label")


@query("select * from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01'")
def filter_year(t: Tables) -> DataFrame:
    """A range, not year(), so that the scan can skip row groups."""
    return t.orders.filter("o_orderdate >= timestamp_ntz '1998-01-01' and o_orderdate < timestamp_ntz '1999-01-01'")


@query("select * from lineitem where (l_returnflag = 'R' or l_discount > 0.05) and not (l_linestatus = 'O') and l_quantity <> 10")
def filter_compound(t: Tables) -> DataFrame:
    return t.lineitem.filter(((F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.05)) & ~(F.col("l_linestatus") == "O") & (F.col("l_quantity") != 10))


@query("select distinct c_mktsegment, c_nationkey from customer")
def distinct_rows(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


@query("select * from (select p_brand, p_size, p_partkey, row_number() over (order by p_size desc nulls last, p_brand asc nulls first, p_partkey) as place from part) where place <= 100")
def order_multi_nulls(t: Tables) -> DataFrame:
    """Sorting with spelled-out null order; place makes the order part of the result, after the limit has cut the rows down."""
    first = t.part.select("p_brand", "p_size", "p_partkey").orderBy(F.desc_nulls_last("p_size"), F.asc_nulls_first("p_brand"), "p_partkey").limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("p_size"), F.asc_nulls_first("p_brand"), "p_partkey")).cast("long"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10")
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("select p_partkey, p_name, p_retailprice from part order by p_retailprice desc, p_partkey limit 10")
def topn_raw(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("select c_nationkey as nationkey from customer union all select s_nationkey from supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nationkey")))


@query("select c_nationkey as nationkey from customer union select s_nationkey from supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nationkey"))).distinct()


@query("select c_nationkey as nationkey from customer intersect select s_nationkey from supplier")
def intersect_rows(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).intersect(t.supplier.select(F.col("s_nationkey").alias("nationkey")))


@query("select n_nationkey as nationkey from nation except select s_nationkey from supplier where s_acctbal > 5000")
def except_rows(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("nationkey")).subtract(t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")))


@query("select c_nationkey as nationkey from customer except all select s_nationkey from supplier")
def except_all_rows(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).exceptAll(t.supplier.select(F.col("s_nationkey").alias("nationkey")))

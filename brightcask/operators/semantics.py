"""Questions over the sales schema, keys and columns of the source, profiles, intents, corrections and admission."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.functions import dictionary
from brightcask.functions.intent import AXIS, WORDS, intent
from brightcask.functions.nearest import nearest_values
from brightcask.operators.registry import Tables, query
from brightcask.functions.wording import several_statistics
from brightcask.plans import admission, answers, charts, guesses, profile, sketches
from brightcask.plans.questions import Measure, Question, ask, grained
from brightcask.plans.reply import chart_of, reply
from brightcask.sources import catalog
from brightcask.sources.catalog import ForeignKey
from brightcask.sources.staging import shared_folder
from brightcask.streaming import events

SALES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
KEYS = [
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_partkey", "part", "p_partkey"), ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"), ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
]
REVENUE = Measure("revenue", "lineitem", "l_extendedprice * (1 - l_discount)", "sum")
LINES = "from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def _ask(t: Tables, q: Question) -> DataFrame:
    return ask(t.spark, catalog.folder("sales", t.folder, SALES), KEYS, q)


@query(f"select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {LINES} group by 1 order by revenue desc, n_name limit 5")
def ask_top_nations_by_revenue(t: Tables) -> DataFrame:
    return _ask(t, Question([REVENUE], by=[("nation", "n_name")], top=5))


@query("select count(1) as n_orders from orders where o_orderstatus = 'F'")
def ask_count_of_finished(t: Tables) -> DataFrame:
    return _ask(t, Question([Measure("n_orders", "orders")], filters=[("orders", "o_orderstatus = 'F'")]))


@query("select date_trunc('month', o_orderdate)::timestamp as month, round(sum(o_totalprice), 2) as total from orders where o_orderdate >= timestamp '1998-01-01' group by 1")
def ask_monthly_total(t: Tables) -> DataFrame:
    return _ask(t, Question([Measure("total", "orders", "o_totalprice", "sum")], filters=[("orders", "o_orderdate >= timestamp_ntz '1998-01-01'")], grain=("orders", "o_orderdate", "month")))


@query(f"select r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {LINES} group by 1, 2")
def ask_revenue_by_segment_and_region(t: Tables) -> DataFrame:
    return _ask(t, Question([REVENUE], by=[("region", "r_name"), ("customer", "c_mktsegment")]))


@query("select p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join part on l_partkey = p_partkey group by 1 having round(sum(l_extendedprice * (1 - l_discount)), 2) > 50000000")
def ask_brands_above_a_limit(t: Tables) -> DataFrame:
    return _ask(t, Question([REVENUE], by=[("part", "p_brand")], having="revenue > 50000000"))


@query("with b as (select p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join part on l_partkey = p_partkey group by 1) select * from b where revenue > (select avg(revenue) from b)")
def ask_brands_above_average(t: Tables) -> DataFrame:
    return _ask(t, Question([REVENUE], by=[("part", "p_brand")], above_average=True))


@query("select c_mktsegment, min(o_totalprice) as least, round(avg(o_totalprice), 2) as mean, max(o_totalprice) as most from orders join customer on o_custkey = c_custkey group by 1")
def ask_spread_of_orders(t: Tables) -> DataFrame:
    return _ask(t, Question([Measure("least", "orders", "o_totalprice", "min"), Measure("mean", "orders", "o_totalprice", "avg"), Measure("most", "orders", "o_totalprice", "max")], by=[("customer", "c_mktsegment")]))


@query("select table_name, column_name, column_index::int as position from duckdb_columns() where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')".replace("column_index::int", "(column_index - 1)::int"))
def schema_catalog(t: Tables) -> DataFrame:
    return catalog.columns(t.spark, catalog.folder("sales", t.folder, SALES)).drop("data_type")


@query("""select * from (values ('lineitem', 'l_orderkey', 'orders', 'o_orderkey', 0::bigint), ('lineitem', 'l_partkey', 'part', 'p_partkey', 0), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey', 0), ('orders', 'o_custkey', 'customer', 'c_custkey', 0),
          ('customer', 'c_nationkey', 'nation', 'n_nationkey', 0), ('supplier', 's_nationkey', 'nation', 'n_nationkey', 0), ('nation', 'n_regionkey', 'region', 'r_regionkey', 0)) v(table_name, column_name, parent, parent_column, orphans)""")
def fk_graph(t: Tables) -> DataFrame:
    """Foreign keys found in the data: by names and as inclusions. Two facts of one parent are no pair."""
    source = catalog.folder("sales", t.folder, SALES)
    return catalog.foreign_keys(t.spark, source).select("table_name", "column_name", "parent", "parent_column", F.lit(0).cast("long").alias("orphans"))


@query("select r_regionkey, r_name from region order by r_regionkey limit 3")
def sample_values(t: Tables) -> DataFrame:
    return t.region.orderBy("r_regionkey").limit(3)


@query("""select 'c_custkey' as name, count(*) as n_rows, count(c_custkey) as n_values, count(distinct c_custkey) as n_distinct, min(c_custkey)::varchar as least, max(c_custkey)::varchar as most from customer
          union all select 'c_name', count(*), count(c_name), count(distinct c_name), min(c_name), max(c_name) from customer
          union all select 'c_nationkey', count(*), count(c_nationkey), count(distinct c_nationkey), min(c_nationkey)::varchar, max(c_nationkey)::varchar from customer
          union all select 'c_mktsegment', count(*), count(c_mktsegment), count(distinct c_mktsegment), min(c_mktsegment), max(c_mktsegment) from customer""")
def result_profile(t: Tables) -> DataFrame:
    return profile.statistics(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("""select * from (values ('o_orderkey', 'number', 'id', null, 'count'), ('o_custkey', 'number', 'id', null, 'count'), ('o_orderstatus', 'string', 'dimension', null, 'count'), ('o_totalprice', 'number', 'measure', null, 'sum'),
          ('o_orderdate', 'datetime', 'time', null, 'none'), ('o_orderpriority', 'string', 'dimension', null, 'count'), ('update_count', 'number', 'measure', null, 'none'), ('order_year', 'number', 'time', 'year', 'none')) v(name, kind, role, periodicity, default_aggregation)""")
def role_inference(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("update_count", F.lit(1)).withColumn("order_year", F.year("o_orderdate"))
    rows = [(p.name, p.kind, p.role, p.periodicity, p.default) for p in profile.profiles(orders)]
    return t.spark.createDataFrame(rows, "name string, kind string, role string, periodicity string, default_aggregation string")


@query("""select * from (values ('month', 'date'), ('stamp', 'datetime'), ('status', 'string'), ('amount', 'number')) v(name, kind)""")
def type_sniffing(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    text = t.orders.select(F.date_format(d, "yyyy-MM").alias("month"), d.cast("string").alias("stamp"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("string").alias("amount"))
    return profile.sniffed(text)


QUESTIONS = [
    ("Show a heatmap of sales by weekday and hour", "heatmap"), ("Correlation of size and price", "correlation"), ("Boxplot of balances", "boxplot"), ("Построй гистограмму цен", "histogram"), ("Share of each segment", "part_to_whole"), ("Stacked bars by status", "composition"),
    ("Area chart of revenue", "area"), ("Monthly revenue in 1998", "trend"), ("Динамика заказов", "trend"), ("Top 5 nations by revenue", "top_n"), ("Сравни сегменты", "comparison"), ("Distribution of balances", "distribution"), ("List all customers", "table"), ("Продажи за август", "unknown"), ("How many orders?", "unknown"), (None, "unknown"),
]


@query("select * from (values " + ", ".join(f"({'null' if q is None else repr(q)}, '{i}')" for q, i in QUESTIONS) + ") v(question, intent)")
def intent_cases(t: Tables) -> DataFrame:
    questions = t.spark.createDataFrame([(q,) for q, _ in QUESTIONS], "question string")
    return questions.select("question", intent(F.col("question")).alias("intent"))


@query("""with w(word) as (values ('BULDING'), ('automobil'), ('FURNITUR'), ('nothing')), v as (select distinct c_mktsegment as meant from customer),
          n as (select word, meant, levenshtein(lower(word), lower(meant)) as distance from w, v where levenshtein(lower(word), lower(meant)) <= 2)
          select word, min(meant) as meant, distance from n where (word, distance) in (select word, min(distance) from n group by word) group by word, distance having count(*) = 1""")
def value_correction(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([("BULDING",), ("automobil",), ("FURNITUR",), ("nothing",)], "word string")
    return nearest_values(words, t.customer, "c_mktsegment")


@query("""with w(word) as (values ('BUIDLING'), ('MACHNIERY'), ('HOUSEHODL'), ('NOTHING')), v as (select distinct c_mktsegment as meant from customer)
          select word, meant, damerau_levenshtein(lower(word), lower(meant)) as distance from w, v where damerau_levenshtein(lower(word), lower(meant)) <= 2""")
def value_correction_of_swaps(t: Tables) -> DataFrame:
    """Swapped neighbours are one edit."""
    return nearest_values(t.spark.createDataFrame([("BUIDLING",), ("MACHNIERY",), ("HOUSEHODL",), ("NOTHING",)], "word string"), t.customer, "c_mktsegment")


@query("""select * from (values ('o_totlprice', 'o_totalprice', 1::bigint), ('o_custky', 'o_custkey', 1)) v(word, meant, distance)""")
def column_correction(t: Tables) -> DataFrame:
    """Mistyped columns of orders against the catalog."""
    words = t.spark.createDataFrame([("o_totlprice",), ("o_custky",), ("elsewhere",)], "word string")
    columns = catalog.columns(t.spark, catalog.folder("sales", t.folder, ["orders"]))
    return nearest_values(words, columns, "column_name")


STATEMENTS = [
    ("select 1", True), ("with x as (select 1 a) select * from x", True), ("select replace(a, 'update', 'b') from t", True), ("select 'drop table t; --' as s", True), ("select 1;", True),
    ("drop table t", False), ("select 1; delete from t", False), ("with x as (select 1) insert into t select * from x", False), ("select reflect('java.lang.System', 'exit')", False), ("", False), ("values (1)", False), ("-- note\nselect 1", True), ("/* a */ update t set a = 1", False),
    ("select `reflect`('java.lang.System', 'getProperty', 'user.home')", False), ("select * from text.`/etc/hostname`", False), ("select * from `text`.`/etc/hostname`", False), ("select system.builtin.reflect('a', 'b')", False), ("select `a b`, `update` from t", True),
]


@query("select * from (values " + ", ".join("('" + s.replace("'", "''") + f"', {str(ok).lower()})" for s, ok in STATEMENTS) + ") v(statement, admitted)")
def guard_cases(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(s, admission.check(s).ok) for s, _ in STATEMENTS], "statement string, admitted boolean")


@query("""with d as (select source, text from documents) select 'in a literal' as form, source, count(*) as n, count(*) as n_admitted from d group by source
          union all select 'in a raw literal', source, count(*), count(*) from d where not contains(text, '''') group by source
          union all select 'after a comment', source, count(*), 0 from d where not contains(text, chr(10)) group by source
          union all select 'behind a quoted name', source, count(*), 0 from d group by source""")
def admitted_statements(t: Tables) -> DataFrame:
    """Statements around the documents' texts: whatever a text says inside of a literal, it is admitted; what follows a comment's or a literal's end is not."""
    text, call = F.coalesce("text", F.lit("")), "reflect('java.lang.System', 'getProperty', 'user.home')"
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    forms = [
        ("in a literal", F.lit(True), F.concat(F.lit("select '"), escaped, F.lit("' as x from documents"))),
        ("in a raw literal", ~F.contains(text, F.lit("'")), F.concat(F.lit("select r'"), text, F.lit("\\' as x from documents"))),
        ("after a comment", ~F.contains(text, F.lit("\n")), F.concat(F.lit("select 1 --"), text, F.lit(f"\r, {call}"))),
        ("behind a quoted name", F.lit(True), F.concat(F.lit("select '"), escaped, F.lit(f"', x as `it's`, {call}, x as `it's too`"))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), on.alias("on"), s.alias("statement")) for n, on, s in forms])).alias("f")
    asked = t.documents.select("source", each).filter("f.on").select("source", "f.form", admission.admitted(F.col("f.statement")).alias("ok"))
    return asked.groupBy("form", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_admitted"))


@query("select event_type, count(*) as n_events, round(sum(value), 4) as total from events where value is not null and event_type = 'view' group by 1")
def ask_with_a_mistyped_column_among_words_of_sql(t: Tables) -> DataFrame:
    """event_typ is no column; is, not and null are no columns either, and stay, as do the names in a literal."""
    source = catalog.folder("events", t.folder, ["events"])
    q = Question([Measure("n_events", "events"), Measure("total", "events", "value", "sum")], by=[("events", "event_typ")], filters=[("events", "value is not null and event_typ = 'view' and 'event_typ' <> ''")], digits=4)
    return ask(t.spark, source, [], answers.with_columns(t.spark, source, q)[0])


@query("select date_trunc('hour', ts)::timestamp as window_start, event_type, count(*) as n_events, round(sum(value), 4) as total from events group by 1, 2")
def windowed_event_counts(t: Tables) -> DataFrame:
    """The streaming query on the batch table."""
    return events.windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
          s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as no from g)
          select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n_events from s group by user_id, no""")
def event_sessions(t: Tables) -> DataFrame:
    out = events.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("select c_mktsegment, c_acctbal from customer where c_acctbal > 0")
def ask_raw_values_for_a_distribution(t: Tables) -> DataFrame:
    """A distribution asks for the values themselves: the summing question is taken back to its rows."""
    q = Question([Measure("c_acctbal", "customer", "c_acctbal", "sum")], by=[("customer", "c_mktsegment")], filters=[("customer", "c_acctbal > 0")])
    return _ask(t, grained(q, "boxplot"))


@query("select o_orderpriority, round(sum(o_totalprice), 2) as total from orders where o_orderstatus = 'F' group by 1")
def ask_with_mistyped_columns(t: Tables) -> DataFrame:
    """o_totlprice, o_orderpriorty and o_ordrstatus are no columns: the nearest ones are asked for."""
    q = Question([Measure("total", "orders", "o_totlprice", "sum")], by=[("orders", "o_orderpriorty")], filters=[("orders", "o_ordrstatus = 'F'")])
    return _ask(t, answers.with_columns(t.spark, catalog.folder("sales", t.folder, SALES), q)[0])


@query("select count(1) as n_customers, round(avg(c_acctbal), 2) as mean from customer where c_mktsegment = 'MACHINERY'")
def ask_with_a_mistyped_value(t: Tables) -> DataFrame:
    """No segment is called MACHNIERY: the nearest value is asked for."""
    q = Question([Measure("n_customers", "customer"), Measure("mean", "customer", "c_acctbal", "avg")], filters=[("customer", "c_mktsegment = 'MACHNIERY'")])
    return _ask(t, answers.with_values(t.spark, catalog.folder("sales", t.folder, SALES), q)[0])


@query("""with r as (select 'regions' as result, count(*) as n_rows from region union all select 'orders', count(*) from orders union all select 'free orders', count(*) from orders where o_totalprice < 0)
          select result, n_rows, least(n_rows, 100) as shown, case when n_rows = 0 then 'failed' when n_rows > 100 then 'partial_success' else 'success' end as status,
                 case when n_rows = 0 then 'empty_result' when n_rows > 100 then 'row_limit_exceeded' end as code from r""")
def result_statuses(t: Tables) -> DataFrame:
    """Whole, cut and empty results."""
    return answers.statuses({"regions": t.region, "orders": t.orders, "free orders": t.orders.filter("o_totalprice < 0")})


@query("""select table_name, column_name, case when regexp_matches(column_name, '(^|_)(id|uuid)$|^(id|uuid)_|key$') then 'id'
                 when data_type in ('DATE', 'TIMESTAMP', 'TIMESTAMP WITH TIME ZONE') then 'time'
                 when data_type in ('BIGINT', 'INTEGER', 'SMALLINT', 'DOUBLE', 'FLOAT') then 'measure'
                 when regexp_matches(column_name, '(^|_)(description|comment|note)') then 'text' else 'dimension' end as role
          from duckdb_columns() where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')""")
def column_roles(t: Tables) -> DataFrame:
    """The role of every column of the source, from its schema."""
    source = catalog.folder("sales", t.folder, [*SALES, "events"])
    rows = [(name, f.name, f.role) for name in source.visible() for f in profile.profiles(source.table(t.spark, name))]
    return t.spark.createDataFrame(rows, "table_name string, column_name string, role string")


@query("""with q as (select distinct 'least and most ' || p_brand || ' price' as question from part union all select distinct 'average size of ' || p_type from part)
          select question, (regexp_matches(question, '\\b(least|lowest|min)')::int + regexp_matches(question, '\\b(most|highest|max)')::int + regexp_matches(question, '\\b(average|avg|mean)')::int) >= 2 as several from q""")
def questions_for_several_statistics(t: Tables) -> DataFrame:
    least = t.part.select(F.concat(F.lit("least and most "), "p_brand", F.lit(" price")).alias("question")).distinct()
    mean = t.part.select(F.concat(F.lit("average size of "), "p_type").alias("question")).distinct()
    return least.unionByName(mean).select("question", several_statistics(F.col("question")).alias("several"))


@query("""select o_orderkey, o_totalprice::double as o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000') as o_orderdate, (o_totalprice::decimal(18, 2))::double as rounded from orders where o_orderstatus = 'P'""")
def values_at_the_edge(t: Tables) -> DataFrame:
    """Decimals and times as callers outside of Spark take them."""
    rows = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_totalprice").cast("decimal(18, 2)").alias("rounded"))
    return admission.edge(rows)


@query("select o_orderpriority, round(sum(o_totalprice), 2) as o_totalprice from orders group by 1 order by 2 desc, 1 limit 10")
def guess_of_a_ranking(t: Tables) -> DataFrame:
    return guesses.guess(t.spark, catalog.folder("sales", t.folder, SALES), "Top priorities of orders by total price")


@query("select date_trunc('month', o_orderdate)::timestamp as month, count(1) as n_rows from orders group by 1")
def guess_of_a_trend(t: Tables) -> DataFrame:
    return guesses.guess(t.spark, catalog.folder("sales", t.folder, SALES), "How many orders, by month of the order date")


@query("select count(*) filter (o_orderdate < now()) as before_now, current_database() is not null as in_a_database, current_user is not null as as_a_user from orders")
def system_functions(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_orderdate").cast("timestamp") < F.current_timestamp()).alias("before_now")).select("before_now", F.current_database().isNotNull().alias("in_a_database"), F.current_user().isNotNull().alias("as_a_user"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]


@query("""select name, n_rows, n_values, least, most, true as distinct_is_near, case when kind = 'number' then true end as quartiles_are_near from (
          """ + " union all ".join(f"select '{c}' as name, 'number' as kind, count(*) as n_rows, count({c}) as n_values, min({c})::double + 0.0 as least, max({c})::double + 0.0 as most from lineitem" for c in NUMBERS)
    + " union all select 'l_returnflag', 'text', count(*), count(l_returnflag), null, null from lineitem)")
def merged_profile(t: Tables) -> DataFrame:
    """The profile of all lines from those of the months, held against the exact values: distinct values within 3 %, quartiles within 2 % of the rows."""
    lines = t.lineitem.select(*NUMBERS, "l_returnflag", "l_shipdate")
    months = sketches.sketched(lines, [F.date_trunc("month", "l_shipdate").alias("month")]).filter("name <> 'l_shipdate'")
    found = sketches.merged(months)
    exact = profile.statistics(lines.drop("l_shipdate")).select("name", F.col("n_distinct").alias("really"))
    values = lines.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in NUMBERS])))
    at = values.join(F.broadcast(found.select("name", "q1", "median", "q3")), "name").groupBy("name").agg(*[F.avg(F.expr(f"cast(value {op} {q} as double)")).alias(f"{q}{k}") for q in ("q1", "median", "q3") for k, op in (("below", "<"), ("upto", "<="))])
    near = lambda q, p: (F.col(f"{q}below") <= p + 0.02) & (F.col(f"{q}upto") >= p - 0.02)
    met = found.join(exact, "name").join(at, "name", "left")
    number = lambda c: F.when(F.col("name") != "l_returnflag", F.col(c).cast("double")).alias(c)
    return met.select("name", "n_rows", "n_values", number("least"), number("most"), (F.abs(F.col("n_distinct") - F.col("really")) <= 0.03 * F.col("really")).alias("distinct_is_near"), (near("q1", 0.25) & near("median", 0.5) & near("q3", 0.75)).alias("quartiles_are_near"))


DICTIONARY = [("part", "p_type"), ("part", "p_name"), ("nation", "n_name"), ("customer", "c_mktsegment"), ("supplier", "s_name")]
VALUES = " union all ".join(f"select distinct '{t}' as table_name, '{c}' as column_name, {c} as value from {t}" for t, c in DICTIONARY)


def _dictionary(t: Tables) -> dictionary.Dictionary:
    path = f"{shared_folder(t.spark)}/dictionary-{uuid.uuid4().hex}"
    dictionary.build(dictionary.values_of(t.spark, catalog.folder("sales", t.folder, SALES), DICTIONARY), path)
    return dictionary.load(t.spark, path)


@query(f"""with v as ({VALUES}), w as (select distinct table_name, column_name, value[:2] || value[4:] as word from v where length(value) > 5 union select table_name, column_name, value[:1] || value[3] || value[2] || value[4:] from v where length(value) > 5),
          n as (select w.table_name, w.column_name, word, value as meant, damerau_levenshtein(lower(word), lower(value)) as distance from w join v on w.table_name = v.table_name and w.column_name = v.column_name and abs(length(word) - length(value)) <= 2 where damerau_levenshtein(lower(word), lower(value)) <= case when length(word) <= 4 then 1 else 2 end),
          b as (select *, min(distance) over (partition by table_name, column_name, word) as least from n)
          select table_name, column_name, word, min(meant) as meant, distance from b where distance = least group by all having count(*) = 1""")
def dictionary_corrections(t: Tables) -> DataFrame:
    """Every value with a letter left out, and with two letters swapped, looked up in the stored index."""
    held, v, at = _dictionary(t), F.col("value"), lambda a, n: F.substring(F.col("value"), a, n)
    values = dictionary.values_of(t.spark, catalog.folder("sales", t.folder, SALES), DICTIONARY).filter(F.length(v) > 5)
    words = values.withColumn("word", F.explode(F.array(F.concat(at(1, 2), at(4, 1000)), F.concat(at(1, 1), at(3, 1), at(2, 1), at(4, 1000))))).select("table_name", "column_name", "word")
    return dictionary.nearest(words, held)


@query(f"""with v as ({VALUES}), w as (select distinct table_name, column_name, lower(value[length(value) - 3:]) as word from v where length(value) > 5 union select table_name, column_name, 'no such' from v)
          select v.table_name, v.column_name, word, value from w join v using (table_name, column_name) where contains(lower(value), word)""")
def dictionary_containment(t: Tables) -> DataFrame:
    """The values that hold the last four letters of any value of their column."""
    held, v = _dictionary(t), F.col("value")
    values = dictionary.values_of(t.spark, catalog.folder("sales", t.folder, SALES), DICTIONARY)
    ends = values.filter(F.length(v) > 5).select("table_name", "column_name", F.lower(F.substring(v, -4, 4)).alias("word"))
    return dictionary.containing(ends.union(values.select("table_name", "column_name", F.lit("no such"))), held)


@query(f"select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {LINES} group by 1")
def chart_of_a_sum_by_any_name(t: Tables) -> DataFrame:
    """The bars of a question's result: that revenue is a sum already is noted with the column, for its name does not say so."""
    asked = _ask(t, Question([REVENUE], by=[("nation", "n_name")]))
    return charts.marks(asked, charts.choose(asked, "comparison")[0])


@query("""with m as (select year(o_orderdate) as y, month(o_orderdate) as mo, count(*) as n_orders from orders group by 1, 2) select 'line' as mark, make_date(y::int, mo::int, 1) as period, n_orders, row_number() over (order by y, mo) as place from m""")
def chart_by_year_and_month(t: Tables) -> DataFrame:
    """Year and month as one axis of a line, all of it and in order."""
    months = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("order_year"), F.month("o_orderdate").cast("long").alias("order_month")).agg(F.count("*").alias("n_orders"))
    spec, _ = chart_of(months, "trend")
    return t.spark.createDataFrame([(spec["mark"], v["period"], v["n_orders"], i) for i, v in enumerate(spec["values"], 1)], "mark string, period date, n_orders long, place long")


@query("""with s as (select c_mktsegment, min(c_acctbal) as least_balance, round(avg(c_acctbal), 2) as mean_balance, max(c_acctbal) as most_balance from customer group by 1) select 'table' as mark, * from s""")
def chart_of_several_statistics(t: Tables) -> DataFrame:
    """Least, mean and most at once are a table, not bars."""
    m = [Measure(f"{n}_balance", "customer", "c_acctbal", how) for n, how in (("least", "min"), ("mean", "avg"), ("most", "max"))]
    got = reply(t.spark, catalog.folder("sales", t.folder, SALES), KEYS, Question(m, by=[("customer", "c_mktsegment")]), "Compare the minimum, average and maximum balance of each segment")
    return t.spark.createDataFrame([(got.chart["mark"], *v.values()) for v in got.chart["values"]], "mark string, c_mktsegment string, least_balance double, mean_balance double, most_balance double")


@query(f"""with r as (select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {LINES} group by 1 order by revenue desc, n_name limit 5)
          select 'top_n' as intent, 'bar' as mark, n_name, revenue, row_number() over (order by revenue desc, n_name) as place from r""")
def reply_with_a_chart(t: Tables) -> DataFrame:
    """A question in words and its terms, answered by bars, the largest first."""
    got = reply(t.spark, catalog.folder("sales", t.folder, SALES), KEYS, Question([REVENUE], by=[("nation", "n_name")], top=5), "Top 5 nations by revenue")
    return t.spark.createDataFrame([(got.intent, got.chart["mark"], v["n_name"], v["revenue"], i) for i, v in enumerate(got.chart["values"], 1)], "intent string, mark string, n_name string, revenue double, place long")


@query("select p_name, count(1) as n_parts from part where contains(lower(p_name), 'widget') group by 1")
def ask_with_a_part_of_a_value(t: Tables) -> DataFrame:
    """No part is called Widget: the names that hold the word are asked for, as the stored index has them."""
    q = Question([Measure("n_parts", "part")], by=[("part", "p_name")], filters=[("part", "p_name = 'Widget'")])
    return _ask(t, answers.with_values(t.spark, catalog.folder("sales", t.folder, SALES), q, _dictionary(t))[0])


def _intent_sql(text: str) -> str:
    starts = {n: "|".join([*ws, AXIS] if n == "correlation" else ws) for n, ws in WORDS}
    return "case " + " ".join(rf"when regexp_matches(lower({text}), '(^|[^\p{{L}}\p{{N}}])(?:{s})') then '{n}'" for n, s in starts.items()) + " else 'unknown' end"


FORMS = ["Top parts like %s", "Share of %s in sales", "monthly revenue of %s", "The Table for %s, x-axis: size", "Сравни %s", "what is a stop, %s?"]


@query(f"""with q as (select text as question from conversations union all select replace({FORMS!r}[p_size % 6 + 1], '%s', p_name) from part)
           select coalesce({_intent_sql("question")}, 'unknown') as intent, count(*) as n_questions, count(distinct question) as n_different from q group by 1""")
def intents_of_questions(t: Tables) -> DataFrame:
    """What the turns of conversations, and questions about every part, ask for."""
    forms = F.array(*map(F.lit, FORMS))
    asked = t.conversations.select(F.col("text").alias("question")).union(t.part.select(F.replace(F.get(forms, F.col("p_size") % 6), F.lit("%s"), F.col("p_name"))))
    return asked.groupBy(intent(F.col("question")).alias("intent")).agg(F.count(F.lit(1)).alias("n_questions"), F.count_distinct("question").alias("n_different"))

"""Keys found in the data: inclusions of columns in one another, and the foreign keys among them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brightcask.operators.registry import Tables, query
from brightcask.sources import catalog, restore
from brightcask.sources.catalog import Source

#: Every table but those whose columns are long texts or vectors, and their columns that can be keys.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey", "part": "p_partkey p_name p_brand p_type p_size",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus", "labels": "doc_id quality toxic", "events": "event_id user_id event_type props",
}
NUMBERS = "regionkey nationkey custkey suppkey partkey orderkey linenumber p_size doc_id quality toxic event_id user_id"


def _values(t: str, c: str) -> str:
    kind = "n" if any(c.endswith(n) for n in NUMBERS.split()) else "t"
    return f"select '{t}' as t, '{c}' as c, '{kind}' as kind, {c}::varchar as v from {t} where {c} is not null"


COUNTED = f"""u as ({' union all '.join(_values(t, c) for t, cs in COLUMNS.items() for c in cs.split())}),
    d as (select t, c, kind, v, count(*) as n from u group by all), s as (select t, c, count(*) as n_distinct, max(n) as most from d group by all),
    i as (select a.t, a.c, b.t as p, b.c as pc, count(*) as shared from d a join d b using (kind, v) where (a.t, a.c) <> (b.t, b.c) group by all)"""


@query(f"""with {COUNTED} select i.t as table_name, i.c as column_name, p as parent, pc as parent_column, a.n_distinct, round(a.n_distinct / b.n_distinct, 9) as coverage
           from i join s a on a.t = i.t and a.c = i.c join s b on b.t = p and b.c = pc where shared = a.n_distinct and b.most = 1""")
def inclusion_dependencies(t: Tables) -> DataFrame:
    """Columns all of whose values are in a column of unique values, meant or by chance."""
    found = catalog.inclusions(t.spark, catalog.folder("all", t.folder, list(COLUMNS)))
    return found.selectExpr("table_name", "column_name", "parent", "parent_column", "n_distinct", "round(coverage, 9) as coverage")


KEYS = "l_orderkey orders o_orderkey, l_partkey part p_partkey, l_suppkey supplier s_suppkey, o_custkey customer c_custkey, c_nationkey nation n_nationkey, s_nationkey nation n_nationkey, n_regionkey region r_regionkey, doc_id documents doc_id"
CHILD = {"l": "lineitem", "o": "orders", "c": "customer", "s": "supplier", "n": "nation", "d": "labels"}


def _key(child: str, column: str, parent: str, parent_column: str, of: str = "", to: str = "") -> str:
    return f"""select '{child}' as table_name, '{column}' as column_name, '{parent}' as parent, '{parent_column}' as parent_column, count(distinct a) as n_distinct, round(count(distinct a) / (select count(distinct {parent_column}) from {to or parent}), 9) as coverage
               from (select {column} as a from {of or child}) having count(*) filter (a is not null and a not in (select {parent_column} from {to or parent})) = 0"""


@query(" union all ".join(_key(CHILD[c.split()[0][0]], *c.split()) for c in KEYS.split(", ")))
def key_discovery(t: Tables) -> DataFrame:
    """The foreign keys of all tables: one for each column that refers to another table."""
    source = catalog.folder("all", t.folder, [*COLUMNS, "documents", "benchmark", "conversations", "embeddings", "pages"])
    return catalog.foreign_keys(t.spark, source).selectExpr("table_name", "column_name", "parent", "parent_column", "n_distinct", "round(coverage, 9) as coverage")


STORE, MEMBER, SALE = "(select s_suppkey as store_id, s_name as store_name from supplier)", "(select c_custkey as member_id, c_name as full_name from customer)", "(select o_orderkey as sale_id, o_custkey % 10 + 1 as store_id, o_custkey as link_to_member, o_totalprice as amount from orders)"


@query(f"{_key('sale', 'store_id', 'stores', 'store_id', SALE, STORE)} union all {_key('sale', 'link_to_member', 'member_data', 'member_id', SALE, MEMBER)}")
def key_discovery_by_other_names(t: Tables) -> DataFrame:
    """Small whole numbers include each other by chance; only what the names say and the data bear out is a key."""
    t.supplier.selectExpr("s_suppkey as store_id", "s_name as store_name").createOrReplaceTempView("found_stores")
    t.customer.selectExpr("c_custkey as member_id", "c_name as full_name").createOrReplaceTempView("found_member")
    t.orders.selectExpr("o_orderkey as sale_id", "o_custkey % 10 + 1 as store_id", "o_custkey as link_to_member", "o_totalprice as amount").createOrReplaceTempView("found_sale")
    source = Source("shop", {n: ("view", {"name": v}) for n, v in (("stores", "found_stores"), ("member_data", "found_member"), ("sale", "found_sale"))})
    return catalog.foreign_keys(t.spark, source).selectExpr("table_name", "column_name", "parent", "parent_column", "n_distinct", "round(coverage, 9) as coverage")


def _shuffled(df: DataFrame) -> DataFrame:
    """df in another order, in three parts for each that it is read in, so a part stays as large as it is however large the table."""
    return df.repartition(3 * max(1, df.rdd.getNumPartitions()))


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows, true as same_in_another_order, true as other_without_a_row from {t}" for t in ("nation", "customer", "orders", "events", "documents")))
def content_fingerprints(t: Tables) -> DataFrame:
    """Fingerprints of whole tables: the same for the rows in another order, another one if a row comes twice."""
    rows = []
    for name in ("nation", "customer", "orders", "events", "documents"):
        df = getattr(t, name)
        print_ = restore.fingerprint(df)
        rows.append((name, int(print_.rsplit("|", 3)[1]), restore.fingerprint(_shuffled(df)) == print_, restore.fingerprint(df.unionByName(df.limit(1))) != print_))
    return t.spark.createDataFrame(rows, "table_name string, n_rows long, same_in_another_order boolean, other_without_a_row boolean")

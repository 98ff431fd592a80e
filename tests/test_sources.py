import sqlite3

import duckdb
import pytest

from brightcask.sources import catalog, readers
from brightcask.sources.catalog import ForeignKey


def test_sqlite_reads_types_nulls_and_names(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('create table "заказы" ("номер" integer primary key, "цена" numeric(12,2), name text, done boolean)')
        db.executemany('insert into "заказы" values (?, ?, ?, ?)', [(i, None if i == 3 else i / 2, None if i == 4 else f"n{i}", i % 2) for i in range(1, 12)])
    df = readers.read(spark, "sqlite", path=path, table="заказы", partitions="3")
    rows = {r["номер"]: r for r in df.collect()}
    assert len(rows) == 11 and rows[3]["цена"] is None and rows[4]["name"] is None and rows[5]["done"] is True and rows[2]["цена"] == 1.0


def test_sqlite_empty_table(spark, tmp_path):
    path = str(tmp_path / "b.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table t (a int, b text)")
    assert readers.read(spark, "sqlite", path=path, table="t").count() == 0


def test_duckdb_reads_in_parts(spark, tmp_path):
    path = str(tmp_path / "c.duckdb")
    with duckdb.connect(path) as db:
        db.execute("create table t as select i::bigint as i, 'x' || i as s, timestamp '2024-01-01' + to_days(i::int) as ts from range(100) r(i)")
    df = readers.read(spark, "duckdb", path=path, table="t", partitions="4")
    assert df.count() == 100 and df.agg({"i": "sum"}).first()[0] == 4950
    assert dict(df.dtypes)["ts"] == "timestamp_ntz"


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "line\nbreak", 2.5), (3, "", 1.0)], "id long, s string, x double")
    path = str(tmp_path / kind)
    readers.write(df, kind, path)
    options = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "emptyValue": ""} if kind == "csv" else {}
    back = readers.read(spark, kind, path=path, schema="id long, s string, x double", **options)
    expected = [(i, None if kind == "csv" and t == "" else t, x) for i, t, x in df.collect()]  # CSV has one form for null and empty
    assert sorted(map(tuple, back.collect())) == sorted(expected)


def test_unknown_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read(spark, "telepathy", path="x")
    with pytest.raises(ValueError):
        readers.write(spark.range(1), "telepathy", str(tmp_path / "x"))


def test_repaired_types(spark):
    df = spark.createDataFrame([("1", "x"), ("two", "y")], "a string, b string")
    assert [r.a for r in readers.repaired(df, {"a": "int"}).collect()] == [1, None]


def test_join_path_and_hidden_tables():
    keys = [ForeignKey("expense", "budget_id", "budget", "id"), ForeignKey("budget", "event_id", "event", "id")]
    assert [k.parent for k in catalog.join_path(keys, "expense", "event")] == ["budget", "event"]
    assert catalog.join_path(keys, "event", "expense") is None
    assert catalog.folder("s", "/x", ["a", "stg_b", "c_tmp", "int_d"]).visible() == ["a"]


def test_registry_of_sources(spark, tmp_path):
    import json

    from brightcask.sources.registry import Registry, UnknownSource, fixed

    spark.range(3).write.parquet(f"{tmp_path}/root/found/t.parquet")
    entries = {"_about": "notes", "sales": {"engine": "parquet", "tables": {"nation": "/root/testdata/sf0.001/nation.parquet"}, "keys": [["nation", "n_regionkey", "region", "r_regionkey"]]}, "gone": {"engine": "parquet", "tables": {"t": f"{tmp_path}/nowhere"}}, "off": {"engine": "parquet", "disabled": True}}
    (tmp_path / "sources.json").write_text(json.dumps(entries))
    registry = Registry.read(f"{tmp_path}/sources.json", f"{tmp_path}/root")
    assert registry.get("sales").keys[0].parent == "region" and registry.get("found").table(spark, "t").count() == 3
    for name in ("off", "none", "_about"):
        with pytest.raises(UnknownSource):
            registry.get(name)
    states = {r.source_id: r for r in registry.states(spark).collect()}
    assert states["sales"].state == "ready" and states["sales"]["columns"] > 0 and states["gone"].state == "PATH_NOT_FOUND" and states["off"].state == "disabled"
    assert fixed(spark, {"tiny": ("a int", [(1,)])})["tiny"].first().a == 1 and spark.table("tiny").count() == 1


def test_artifacts_and_exports(spark, tmp_path):
    from brightcask.sources import artifacts

    kept = artifacts.Artifacts(f"{tmp_path}/kept")
    df = spark.createDataFrame([(1, 'a "b"', None), (2, "x,y", 1.5)], "id int, name string, x double")
    table, spec = kept.save("r1", "table", df), kept.save("r1", "chart_spec", {"mark": "bar"})
    assert kept.load(spark, table).count() == 2 and kept.load(spark, spec) == {"mark": "bar"} and spec.startswith("r1-chart_spec-")
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            kept.load(spark, bad)
    text = artifacts.csv_text(df, {"name": "Имя", "x": "id"})
    assert text == artifacts.MARK + 'id,Имя,id 2\n1,"a ""b""",\n2,"x,y",1.5\n'
    import json

    assert json.loads(artifacts.json_text(df, {"name": "Имя"}))["columns"][1] == {"id": "name", "label": "Имя"}


def test_sqlite_keys(spark, tmp_path):
    import sqlite3

    from brightcask.sources import readers

    with sqlite3.connect(tmp_path / "k.db") as db:
        db.execute("create table parent (id integer primary key, name text)")
        db.execute("create table child (a int, b int, parent_id int references parent(id), primary key (a, b))")
    assert readers.sqlite_keys(f"{tmp_path}/k.db") == ({"parent": ["id"], "child": ["a", "b"]}, [("child", "parent_id", "parent", "id")])


def shop(spark, tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(f"shop_{name}")
    return catalog.Source("shop", {n: ("view", {"name": f"shop_{n}"}) for n in tables})


def found(spark, source):
    return {(r.table_name, r.column_name, r.parent, r.parent_column) for r in catalog.foreign_keys(spark, source).collect()}


def test_small_numbers_are_no_keys_by_themselves(spark):
    tables = {
        "store": ("store_id int, label string", [(i, f"s{i}") for i in range(1, 4)]),
        "customer": ("customer_id long, full_name string", [(i, f"c{i}") for i in range(1, 9)]),
        "sale": ("sale_id int, store_id int, customer_id int, amount double", [(i, i % 3 + 1, i % 7 + 1, 1.0) for i in range(1, 30)] + [(30, None, None, None)]),
    }
    assert found(spark, shop(spark, tables)) == {("sale", "store_id", "store", "store_id"), ("sale", "customer_id", "customer", "customer_id")}


def test_keys_by_a_tables_name_and_dangling_ones(spark):
    tables = {
        "event": ("id string, name string", [("e1", "a"), ("e2", "b")]),
        "categories": ("id int, title string", [(1, "x"), (2, "y")]),
        "member_data": ("member_id string, zip string", [("m1", "1"), ("m2", None)]),
        "attendance": ("link_to_event string, link_to_member string, category_id int, lost_id int", [("e1", "m1", 1, 5), ("e2", "m9", 2, 6)]),
        "twice": ("event_id string", [("e1",), ("e1",)]),
        "nothing": ("event_id string, category_id int", []),
    }
    assert found(spark, shop(spark, tables)) == {("attendance", "link_to_event", "event", "id"), ("attendance", "category_id", "categories", "id"), ("twice", "event_id", "event", "id")}


def test_inclusions_of_many_columns(spark):
    """More columns than one number has bits for, of two types, with nulls and long texts."""
    schema = "k int, " + ", ".join(f"a{i} int" for i in range(70)) + ", t string"
    rows = [(k, *[(k * (i + 1)) % 40 if (k + i) % 11 else None for i in range(70)], "x" * 100 + str(k)) for k in range(40)]
    tables = {"big": (schema, rows), "texts": ("t string, n long", [("x" * 100 + str(k), None) for k in range(3)])}
    source = shop(spark, tables)
    cols = {("big", n): [r[i] for r in rows] for i, n in enumerate(["k", *[f"a{i}" for i in range(70)], "t"])} | {("texts", "t"): [r[0] for r in tables["texts"][1]], ("texts", "n"): [None]}
    held = {c: {v for v in vs if v is not None} for c, vs in cols.items()}
    unique = {c for c, vs in cols.items() if len(held[c]) == sum(v is not None for v in vs) > 0}
    want = {(*a, *b, len(held[a]), len(held[a]) / len(held[b])) for a in held for b in unique if a != b and held[a] and held[a] <= held[b]}
    assert set(map(tuple, catalog.inclusions(spark, source).collect())) == want and len(want) > 60


def test_names_of_keys():
    assert [catalog.thing(c) for c in ("id", "store_id", "storeid", "link_to_member", "uuid", "name", "fk_store")] == ["", "store", "store", "member", "", None, "store"]
    assert catalog.thing("o_custkey", catalog.own_prefix(["o_orderkey", "o_custkey"])) == "cust" and catalog.own_prefix(["a_b", "c"]) == ""
    assert [catalog.names_table("category", t) for t in ("categories", "category_data", "category_map", "cat")] == [3, 2, 1, 0]


@pytest.mark.parametrize("kind", ["sqlite", "duckdb"])
def test_a_database_file_is_a_source_with_its_declared_keys(spark, tmp_path, kind):
    from brightcask.sources.registry import Registry

    path = f"{tmp_path}/shop.{kind}"
    script = ["create table store (id integer primary key, label text)", "create table sale (id integer primary key, store_id integer references store(id), stg_x integer)", "insert into store values (1, 'a'), (2, 'b')", "insert into sale values (1, 1, 0), (2, 1, 0)"]
    with (sqlite3 if kind == "sqlite" else duckdb).connect(path) as db:
        for s in script:
            db.execute(s)
    source = Registry({}, str(tmp_path)).get("shop")
    assert source.keys == [ForeignKey("sale", "store_id", "store", "id")] and source.primary == {"store": ["id"], "sale": ["id"]}
    assert catalog.keys_of(spark, source) == source.keys and source.table(spark, "sale").count() == 2
    undeclared = catalog.Source("shop", source.tables)
    assert catalog.keys_of(spark, undeclared) == source.keys
    marked = {(r.table_name, r.column_name): (r.primary_key, r.refers_to) for r in catalog.columns(spark, source, marks=True).collect()}
    assert marked["store", "id"] == (True, None) and marked["sale", "store_id"] == (False, "store.id")


def test_fingerprints_of_another_order_take_more_tasks_for_larger_tables(spark, tmp_path):
    from brightcask.operators.keys import _shuffled

    spark.range(4000).selectExpr("id", "repeat(uuid(), 20) as text").repartition(6).write.parquet(f"{tmp_path}/t")
    df, before = spark.read.parquet(f"{tmp_path}/t"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        counts = []
        for size in ("1g", "100k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            parts = _shuffled(spark.read.parquet(f"{tmp_path}/t")).rdd.glom().map(len).collect()
            counts.append(len(parts))
            assert sum(parts) == 4000 and max(parts) < 4000 / 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert counts[0] < counts[1] and df.count() == 4000

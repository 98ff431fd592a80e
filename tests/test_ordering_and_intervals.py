"""Interval joins and whole-table windows against plain loops, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from brightcask.operators import registry
from brightcask.plans.intervals import overlapping
from brightcask.plans.ordering import numbered, ranked, tile

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1.0, 7.5])
def test_overlaps_are_those_of_all_pairs(spark, width):
    draw = random.Random(1)
    span = lambda: (a := draw.uniform(-300, 300), a + draw.choice([0, 0, 0.5, 1, 3, 20, 63, 64, 65, 400, -1]))
    left, right = ([(i % 3, i, *span()) for i in range(n)] for n in (160, 140))
    left += [left[5], (1, 900, None, 3.0), (1, 901, 0.0, None), (None, 902, -1000.0, 1000.0)]
    schema = "k int, id int, a double, b double"
    x, y = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema)
    whole = lambda p, q: None not in (p[2], p[3]) and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]
    sides = (F.col("a"), F.col("b"))
    for on in ([], [("k", "k")]):
        got = overlapping(x, y, sides, sides, width, on)
        want = sorted((p[1], q[1]) for p in left for q in right if whole(p, q) and (not on or p[0] == q[0]))
        assert sorted((r.l.id, r.r.id) for r in got.collect()) == want and len(want) > 100
    assert overlapping(x, y.filter("false"), sides, sides, width).count() == 0


def test_interval_joins_compare_no_table_with_every_row_of_another(spark):
    for name in ("join_interval", "join_overlapping_periods"):
        text = plan(registry.queries()[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text + "SortMergeJoin" * ("HashJoin" in text)


def sortable(v, up):
    return (v is None, 0 if v is None else v if up else -v)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbers_and_sums_of_a_whole_table(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice([None, 1, 2, 3, 3, 3]), i, draw.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, id int, v int").repartition(5)
    for up in (True, False):
        got = {r.id: r for r in numbered(df, [("k", up), ("id", True)], "no", {"tile": 7, "more": 300}, {"upto": "v"}, parts).collect()}
        total = None
        for n, (_, i, v) in enumerate(sorted(rows, key=lambda r: (sortable(r[0], up), r[1])), 1):
            total = total if v is None else v + (total or 0)
            assert (got[i].no, got[i].upto) == (n, total)
        tiles = [got[i].tile for _, i, _ in sorted(rows, key=lambda r: (sortable(r[0], up), r[1]))]
        assert tiles == sorted(tiles) and [tiles.count(t) for t in range(1, 8)] == [29, 29, 29, 29, 28, 28, 28] and {r.more for r in got.values()} == set(range(1, 201))
    assert numbered(df.filter("false"), [("k", True)], "no", sums={"upto": "v"}, parts=parts).collect() == []


def test_ranks_of_a_whole_table(spark):
    draw = random.Random(9)
    keys = [(draw.choice([None, 1.5, 2.5]), draw.choice(["a", "b", None])) for _ in range(90)] + [(2.5, "hot")] * 60
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "id int, x double, s string").repartition(4)
    order = sorted(keys, key=lambda k: (sortable(k[0], False), k[1] is None, k[1] or ""))
    levels = list(dict.fromkeys(order))
    for r in ranked(df, [("x", False), ("s", True)], "rank", "dense", "pct", "cume", parts=6).collect():
        k = (r.x, r.s)
        first, last = order.index(k), len(order) - order[::-1].index(k)
        assert (r["rank"], r.dense, round(r.pct, 9), round(r.cume, 9)) == (first + 1, levels.index(k) + 1, round(first / 149, 9), round(last / 150, 9))
    assert ranked(df.filter("false"), [("x", True)], "rank").collect() == []
    assert [r.pct for r in ranked(df.limit(1), [("x", True)], percent_rank="pct").collect()] == [0.0]


def test_whole_table_windows_have_no_single_task(spark):
    for name in ("window_numbers_of_all", "window_ranks_of_all", "window_running_sum_of_all"):
        assert "SinglePartition" not in plan(registry.queries()[name](spark, SF))


def test_tiles_are_as_sql_has_them(spark):
    for total, tiles in ((10, 3), (3, 10), (12, 4), (1, 1)):
        got = [r[0] for r in spark.range(1, total + 1).select(tile(F.col("id"), total, tiles)).collect()]
        spark.range(total).createOrReplaceTempView("tiled")
        assert got == [r[0] for r in spark.sql(f"select ntile({tiles}) over (order by id) from tiled order by id").collect()]


def test_sums_near_purchases_make_no_pairs(spark, tmp_path):
    from datetime import datetime, timedelta

    draw = random.Random(4)
    start, half = datetime(2024, 1, 1), timedelta(minutes=30)
    when = lambda: None if draw.random() < 0.02 else start + timedelta(minutes=draw.choice([0, 30, 30, 60, draw.randint(0, 2000)]))
    rows = [(i if i % 9 else 9, when(), draw.choice([None, 1, 2, 3]), draw.choice(["purchase", "view", None]), draw.choice([None, 0.1, 1e9, -2.25, 7.03])) for i in range(400)]
    late = start + timedelta(days=3)
    rows += [(1000, late, 1, "purchase", None), (1001, late + timedelta(days=1), 1, "purchase", float("nan")), (1002, late + timedelta(days=2), None, "purchase", float("inf"))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for i, ts, user, kind, _ in rows:
        for _, at, other, _, value in rows if kind == "purchase" and ts else ():
            if at and ts - half <= at <= ts + half:
                got = want.setdefault(i, [0, 0, None])
                got[:2] = got[0] + 1, got[1] + (user is not None and user == other)
                got[2] = got[2] if value is None else value + (got[2] or 0)
    df = registry.queries()["join_interval"](spark, str(tmp_path))
    have = {r.purchase_id: [r.n_near, r.n_own, r.total] for r in df.collect()}
    same = lambda a, b: a is b if a is None or b is None else repr(a) == repr(b) or abs(a - b) <= 1e-4 + 1e-12 * abs(b)
    assert have.keys() == want.keys() and all(have[i][:2] == want[i][:2] and same(have[i][2], want[i][2]) for i in want), [(have[i], want[i]) for i in want][:5]
    assert "bin#" not in plan(df) and len(want) > 50

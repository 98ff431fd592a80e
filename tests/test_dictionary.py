"""The stored index of values against all pairs, and its plans."""

import random

import pytest
from pyspark.sql import functions as F

from brightcask.functions import dictionary

COLUMN = ("t", "c")


def distance(a, b):
    """Edits, of which one may be a swap of neighbours."""

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    swaps = [1 + plain(a[:i] + a[i + 1] + a[i] + a[i + 2 :], b) for i in range(len(a) - 1)]
    return min([plain(a, b), *swaps])


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abcDé ") for _ in range(n))
    values = {word(draw.randint(0, 14)) for _ in range(150)} | {"Machinery", "machine", "BUILDING", "x" * 300, "", "aaaa"} | {f"Customer number {i:09d} of the north" for i in range(120)} | {word(n) for n in range(20, 30)}
    edited = []
    for v in sorted(v for v in values if len(v) < 50)[::2]:
        for _ in range(draw.randint(1, 3)):
            at = draw.randrange(len(v) + 1)
            v = draw.choice([v[:at] + v[at + 1 :], v[:at] + "b" + v[at:], v[:at] + v[at + 1 : at + 2] + v[at : at + 1] + v[at + 2 :]])
        edited.append(v)
    return sorted(values), sorted({*edited[::3], "MACHNIERY", "nothing at all", "", "ab"})


@pytest.fixture(scope="module")
def held(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dictionary") / "d")
    dictionary.build(spark.createDataFrame([(*COLUMN, v) for v in corpus[0] if len(v) <= dictionary.MOST], "table_name string, column_name string, value string"), path)
    return dictionary.load(spark, path)


def asked(spark, words):
    return spark.createDataFrame([(*COLUMN, w) for w in words], "table_name string, column_name string, word string")


def test_nearest_values_are_those_of_all_pairs(spark, corpus, held):
    values, words = corpus
    want = {}
    for w in words:
        near = [(d, v) for v in values if len(v) < 50 and abs(len(v) - len(w)) <= 2 and (d := distance(w.lower(), v.lower())) <= (1 if len(w) <= 4 else 2)]
        if near and sum(d == min(near)[0] for d, _ in near) == 1:
            want[w] = min(near)[::-1]
    got = {r.word: (r.meant, r.distance) for r in dictionary.nearest(asked(spark, words), held).collect()}
    assert got == want and len(want) > 20 and got["MACHNIERY"] == ("Machinery", 1)


def test_containing_values_are_those_of_all_pairs(spark, corpus, held):
    words = ["abc", "MACHIN", "cD", "uildin", "zzz", "aaa", "é a"]
    want = sorted((w, v) for w in words if len(w) >= 3 for v in corpus[0] if w.lower() in v.lower() and len(v) <= dictionary.MOST)
    assert sorted((r.word, r.value) for r in dictionary.containing(asked(spark, words), held).collect()) == want and len(want) > 5


def test_lookups_read_the_index_and_no_column(spark, held):
    df = dictionary.nearest(asked(spark, ["MACHNIERY"]), held)
    assert all("/d/near/" in f for f in df.inputFiles()) and df.count() == 1
    df = dictionary.containing(asked(spark, ["chine"]), held)
    assert all("/d/" in f for f in df.inputFiles()) and {r.value for r in df.collect()} == {"Machinery", "machine"}


def test_keys_of_short_texts(spark):
    hashed = lambda *texts: F.sort_array(F.array(*[F.xxhash64(F.lit(t)) for t in texts]))
    got = spark.range(1).select(F.sort_array(dictionary.near_keys(F.lit("Abc"))) == hashed("a", "ab", "abc", "ac", "b", "bc", "c"), dictionary.near_keys(F.lit("")) == hashed(""), dictionary.runs(F.lit("ab")), dictionary.runs(F.lit("abAB"))).first()
    assert list(got) == [True, True, [], ["aba", "bab"]]


def test_answers_look_values_up_in_the_index(spark, tmp_path):
    from brightcask.plans.answers import answer, with_values
    from brightcask.plans.questions import Measure, Question
    from brightcask.sources import catalog

    source = catalog.folder("s", "/root/testdata/sf0.001", ["customer"])
    dictionary.build(dictionary.values_of(spark, source, [("customer", "c_mktsegment")]), f"{tmp_path}/d")
    held = dictionary.load(spark, f"{tmp_path}/d")
    ask = lambda word: Question([Measure("n", "customer")], by=[("customer", "c_mktsegment")], filters=[("customer", f"c_mktsegment = '{word}'")])
    assert with_values(spark, source, ask("MACHNIERY"), held)[0].filters == [("customer", "c_mktsegment = 'MACHINERY'")]
    assert with_values(spark, source, ask("mob"), held)[1] == [("mob", "AUTOMOBILE")]
    q, done = with_values(spark, source, ask("IL"), held)
    assert (q.filters, done) == ([("customer", "c_mktsegment = 'IL'")], [])
    assert with_values(spark, source, ask("o''Neil"), held)[1] == []
    got = answer(spark, source, [], ask("house"), held=held)
    assert got.status == "success" and got.corrections == [("house", "HOUSEHOLD")] and len(got.rows) == 1


def test_the_keys_of_many_words_are_not_broadcast(spark, corpus, held, monkeypatch):
    few = sorted((r.word, r.meant) for r in dictionary.nearest(asked(spark, corpus[1]), held).collect())
    monkeypatch.setattr(dictionary, "FEW_WORDS", len(corpus[1]) - 1)
    df = dictionary.nearest(asked(spark, corpus[1]), held)
    assert sorted((r.word, r.meant) for r in df.collect()) == few
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

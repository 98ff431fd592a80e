"""The near-dedup stage against all pairs of 5-word shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from brightcask.llm import shingle_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest(rows):
    """The smallest id of each group linked by similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                root[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), i), i)
    return sorted(first.values())


def corpus():
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    line = [word() for _ in range(46)]
    texts = [None, "", "one", "One  two", "one two", "a b c d e f"]
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(60, 300)))]
        for c in range(24 if g == 0 else 6):
            copy = list(base)
            for at in rng.choice(len(base), int(rng.integers(0, len(base) // 25 + 1)), replace=False):
                copy[at] = word()
            texts.append(" ".join(copy[: len(copy) - int(rng.integers(0, 12))]))
    texts += [" ".join([*line, *[word() for _ in range(int(rng.integers(4, 40)))]]) for _ in range(40)]
    order = rng.permutation(len(texts))
    return [(int(i), t) for i, t in zip(order, texts, strict=True)]


@pytest.mark.parametrize("few", [64, 4])
def test_groups_are_those_of_all_pairs(spark, few):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3).cache()
    got = shingle_join.keep_one(docs, few=few)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == smallest(rows)
    if few == 64:
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == smallest(rows)
        assert shingle_join.keep_one(docs.filter("false")).count() == 0


def test_hot_order_keeps_the_groups(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    frequent = shingle_join.frequent
    monkeypatch.setattr(shingle_join, "frequent", lambda slim: frequent(slim, above=3))
    assert sorted(r.doc_id for r in shingle_join.keep_one(docs, few=4).collect()) == smallest(rows)


def test_fine_sketches_differ_in_no_more_classes_than_sets():
    rng = np.random.default_rng(12)
    for n, m in ((3, 3), (40, 44), (900, 1100), (5000, 4100), (0, 2)):
        pool = rng.integers(-(1 << 62), 1 << 62, n + m)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n // 2], pool[n:]]))
        differ = len(np.setxor1d(a, b))
        got = shingle_join.apart(shingle_join.fine_sketch(a), shingle_join.fine_sketch(b))
        assert got <= differ and got >= 0.4 * differ - 8 and shingle_join.apart(shingle_join.fine_sketch(a), shingle_join.fine_sketch(a)) == 0


def test_fingerprints_link_near_copies_before_shingles_are_joined(spark, monkeypatch):
    """With the join of shingles finding nothing, covering tables and the exact check still drop copies whose fingerprints are near, and no others."""
    rows = corpus()

    def nothing(few):
        def run(batches):
            import pyarrow

            for _ in batches:
                pass
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array([], pyarrow.int64())] * 5, names=["node", "other", "token", "n", "place"])

        return run

    monkeypatch.setattr(shingle_join, "_small", nothing)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert set(smallest(rows)) <= kept and len(kept) < len({frozenset(shingles(t)) for _, t in rows})

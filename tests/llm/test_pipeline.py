"""Each stage of the pipeline against brute force on what it was given, on documents and on the edges: nulls, empty and very long texts,
ties, repeated rows, empty tables and columns with clashing names."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from brightcask.llm import packing, toxicity
from brightcask.llm.common import documents, staged

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def spaced(t):
    out, blank = bytearray(), False
    for c in (t or "").encode():
        if c == 32 or 9 <= c <= 13:
            if not blank:
                out.append(32)
            blank = True
        else:
            out.append(c)
            blank = False
    return bytes(out)


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def order(i):
    return (i is None, i or 0)


def kept_of_groups(rows, alike):
    """The smallest id of each group of rows linked by alike."""
    root = list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if alike(a, b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for a, r in enumerate(rows):
        least[top(a)] = min(least.get(top(a), (True, 0)), order(r.doc_id))
    return Counter(least.values())


def check(spark, docs, labels_dir, run):
    """Runs all stages, and holds each one's rows against what it should keep of its input."""
    columns = docs.columns
    assert list(STAGES) == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, labels_dir), name)
        assert docs.columns == columns
        kept[name] = (before, before.collect(), docs.collect())

    before, rows, after = kept["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{labels_dir}/labels.parquet"))

    def score(text):
        z = sum(float(model.weights[toxicity.parts(w)].sum()) for w in toxicity.words_of(text)) + model.bias
        return 1 / (1 + np.exp(-z))

    clean = [r for r in rows if model is None or score(r.text) < 0.5]
    assert Counter(map(repr, after)) == Counter(map(repr, clean))

    _, rows, after = kept["exact_dedup"]
    first = {}
    for r in rows:
        first[spaced(r.text)] = min(first.get(spaced(r.text), (True, 0)), order(r.doc_id))
    assert Counter(order(r.doc_id) for r in after) == Counter(first.values())
    assert {spaced(r.text) for r in after} == first.keys() and len(after) == len(first)

    _, rows, after = kept["near_dedup"]
    sets = [shingles(r.text) for r in rows]
    alike = lambda a, b: sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0
    assert Counter(order(r.doc_id) for r in after) == kept_of_groups(rows, alike)

    _, rows, after = kept["mix_sources"]
    size = lambda r: len((r.text or "").encode().split())
    held, taken = Counter(), Counter()
    for r in rows:
        held[r.source] += size(r)
    for r in after:
        taken[r.source] += size(r)
    assert {order(r.doc_id) for r in after} <= {order(r.doc_id) for r in rows}
    assert all(n <= 3 for n in Counter(map(repr, after)).values()) and not any(size(r) == 0 for r in after)
    weights = dict(zip(sorted(held, key=lambda s: (s is None, (s or "").encode())), (1, 2, 3) * len(held), strict=False))
    full = set()
    while True:
        rest = sum(held.values()) - sum(3 * held[s] for s in full)
        open_ = sum(weights[s] for s in held if s not in full)
        target = {s: 3 * held[s] if s in full else rest * weights[s] / open_ for s in held}
        if not (over := {s for s in held if s not in full and target[s] > 3 * held[s]}):
            break
        full |= over
    longest = max(map(size, rows), default=0)
    for s in held:  # whole documents and whole blocks: a few of each off at most
        assert abs(taken[s] - target[s]) <= 0.1 * target[s] + 6 * longest, (s, taken[s], target[s])

    pieces = STAGES["pack"](spark, docs, labels_dir).collect()
    whole = packing.encodings(packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))[0]
    want = Counter()
    for r in after:
        ids = np.array([*whole.encode(r.text or "", allowed_special="all"), 0], "<u4")
        want.update((order(r.doc_id), k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), packing.CAPACITY)))
    assert Counter((order(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= packing.CAPACITY
    if run:
        assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, labels_dir).collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_stages_on_documents(spark):
    check(spark, documents(spark, SF), SF, run=True)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdef"), 3)) for _ in range(n))


@pytest.fixture(scope="module")
def edges(spark):
    texts = [None, "", " \n ", "one", "One  two", "one two", prose(1, 200), prose(1, 200), prose(1, 199) + " zz", prose(2, 30000), "y" * 20000, prose(3, 60), prose(4, 60) + "\n" + prose(5, 80)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], 0) for i, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "a", 0), (6, texts[6], "en", "a", 0), (None, texts[11], None, None, None), (None, None, None, None, None), (None, prose(9, 50), None, "c", None)]
    rows += [(i, prose(20 + k, 60), None, "c", None) for k, i in enumerate((None, None, None, 7, 7, 8))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "row", "key", "times", "digest", "maybe", "first", "id", "component_id", "_share", "tag"):
        df = df.selectExpr("*", f"'x' as {c}")
    return df.repartition(3).cache()


def test_stages_on_edges(spark, edges):
    check(spark, edges, SF, run=False)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_an_empty_table(spark, edges, name):
    out = STAGES[name](spark, edges.filter("false"), SF)
    assert out.count() == 0 and (name == "pack" or out.columns == edges.columns)


def test_stages_without_labels(spark, edges, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert STAGES["toxicity"](spark, edges, str(tmp_path)).count() == edges.count()

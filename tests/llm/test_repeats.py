"""Removal of repeats from real documents, dealt over several partitions and in small blocks, against brute force."""

import functools
import hashlib

import numpy as np
import pytest

from brightcask.llm import relative_lz, repeats, suffix_sort
from brightcask.llm.common import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = documents(spark, SF)
    # A passage that a third of all documents have, with words of their own on both sides, and a hot group of copies.
    passage = " ".join(f"p{i}" for i in range(90))
    more = spark.range(60).selectExpr("id + 100000 as doc_id", f"concat('a', id, ' b', id, ' {passage} c', id, ' d', id * 7) as text")
    copies = spark.range(40).selectExpr("id + 200000 as doc_id", f"'{passage} the end of it' as text")
    long = spark.createDataFrame([(300000, " ".join(f"w{i % 977}" for i in range(6000)))], "doc_id long, text string")
    return base.select("doc_id", "text").unionByName(more).unionByName(copies).unionByName(long).repartition(7).cache()


@pytest.mark.parametrize("least", [20, 1])
def test_relative_lz_on_documents(docs, monkeypatch, least):
    monkeypatch.setattr(relative_lz, "frequent", functools.partial(repeats.frequent, least=least))
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    first = {}
    for i, w in rows:
        for a in range(len(w) - 12):
            key = b" ".join(w[a : a + 13])
            first[key] = min(first.get(key, i), i)
    want = {}
    for i, w in rows:
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - 12):
            if first[b" ".join(w[a : a + 13])] < i:
                gone[a : a + 13] = True
        want[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in relative_lz.remove_repeats(docs, block_rows=40).collect()}
    assert got == want


@pytest.mark.parametrize("least", [20, 1])
def test_suffix_sort_on_documents(docs, monkeypatch, least):
    monkeypatch.setattr(suffix_sort, "frequent", functools.partial(repeats.frequent, least=least))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = {}
    for _, b in rows:
        for a in range(len(b) - 399):
            h = hash(b[a : a + 400])
            seen[h] = seen.get(h, 0) + 1
    want = {}
    for i, b in rows:
        gone = np.zeros(len(b) + 2, np.int8)
        for a in range(len(b) - 399):
            if seen[hash(b[a : a + 400])] > 1:
                gone[a + 1 : a + 401] = 1
        kept = np.frombuffer(b, np.uint8)[gone[1:-1] == 0].tobytes()
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_sort.remove_repeats(docs, run_rows=50, bucket_rows=60).collect()}
    assert got == want


def test_factors_are_the_longest_in_smaller_documents():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    bodies = [b" ".join(rng.choice([b"a", b"b", b"c"], int(rng.integers(1, 30)))) for _ in range(60)]
    ids = rng.integers(0, 20, len(bodies))
    block = relative_lz.Block(pa.array(bodies, pa.binary()), 4)
    block.index(ids)
    got = block.factors(np.arange(len(block.piece)))
    words = [b.split() for b in bodies]
    at = 0
    for w, i in zip(words, ids.tolist(), strict=True):
        for a in range(len(w)):
            most = 0
            for v, j in zip(words, ids.tolist(), strict=True):
                if j < i:
                    for b in range(len(v)):
                        n = 0
                        while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                            n += 1
                        most = max(most, n)
            assert got[at] == (most if most >= 4 else 0)
            at += 1
    assert (block.parse(ids) == (got > 0)).all()


def test_parsing_searches_only_at_factors_and_their_ends(monkeypatch):
    import pyarrow as pa

    text = [b"%d" % i for i in range(40)]
    bodies = [b" ".join(text), b" ".join([b"x", *text[:25], *text[3:20]]), b" ".join(text[2:30])]
    block = relative_lz.Block(pa.array(bodies, pa.binary()), 5)
    asked, plain = [], relative_lz.Block.factors
    monkeypatch.setattr(relative_lz.Block, "factors", lambda self, places: asked.extend(places.tolist()) or plain(self, places))
    gone = block.parse(np.array([1, 2, 3]))
    start = block.start
    # The first piece has no smaller one: each of its 36 windows is asked for. The second: its x, two factors, and four windows across.
    assert sorted(a - start[1] for a in asked if start[1] <= a < start[2]) == [0, 1, 22, 23, 24, 25, 26]
    assert [a - start[2] for a in asked if a >= start[2]] == [0]
    assert np.flatnonzero(gone[start[1] : start[2]]).tolist() == [*range(1, 22), *range(26, 39)]
    assert np.flatnonzero(gone[start[2] :]).tolist() == list(range(24)) and not gone[: start[1]].any()


@pytest.mark.parametrize("block_rows", [3, 50_000])
def test_pieces_of_hot_anchors_meet_by_their_windows(spark, block_rows):
    """With three pieces to a block nearly every anchor is too hot for one task."""
    rng = np.random.default_rng(2)
    shared = [f"s{i}" for i in range(30)]
    texts = []
    for _ in range(120):
        own = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(0, 40)))]
        a = int(rng.integers(0, 30))
        texts.append(" ".join([*own, *shared[a : a + int(rng.integers(10, 30))], *own[:5]]))
    rows = [*enumerate(texts), (None, texts[0]), (5, texts[5]), (500, None), (501, "")]
    first: dict[tuple, int] = {}
    last = (1 << 63) - 1
    for i, t in rows:
        words = (t or "").split()
        for a in range(len(words) - 12):
            key = tuple(words[a : a + 13])
            first[key] = min(first.get(key, last), last if i is None else i)
    want = []
    for i, t in rows:
        words = (t or "").split()
        gone = {b for a in range(len(words) - 12) if first[tuple(words[a : a + 13])] < (last if i is None else i) for b in range(a, a + 13)}
        want.append((i, len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in relative_lz.remove_repeats(docs, block_rows=block_rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[2] for w in want)


def test_sweep_is_every_pair_of_an_anchor():
    rng = np.random.default_rng(9)
    for _ in range(30):
        pieces = []
        for p in range(int(rng.integers(2, 25))):
            before = bytes(rng.choice(list(b"xy"), int(rng.integers(0, 8))).tolist())
            pieces.append((b"AAAA" + bytes(rng.choice(list(b"pq"), 12).tolist()), before, p))
        pieces.sort()
        window = 10
        group = [(suffix_sort.common(pieces[k - 1][0], s) if k else 0, s, b, p, 0, 0, len(b) + 1) for k, (s, b, p) in enumerate(pieces)]
        want = set()
        for s, b, p in pieces:
            for o in range(len(b) + 1):
                piece = b[len(b) - o :] + s[: window - o]
                if any(q != p and len(c) >= o and c[len(c) - o :] + t[: window - o] == piece for t, c, q in pieces):
                    want.add((p, len(b) - o))
        got = [(p, w) for p, _, start, n in suffix_sort.repeated(group, window) for w in range(start, start + n)]
        assert len(got) == len(set(got)) and set(got) == want

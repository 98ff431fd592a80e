"""Every operator on nulls, empty and repeated rows, clashing columns and empty tables, against brute force on small rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from brightcask.llm import exact_dedup, line_quality, mixing, ngram_lm, packing, pii, relative_lz, shingle_join, simhash, suffix_sort, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["digest", "kept", "score", "fp", "size", "tag", "row", "key", "id"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdef"), 3)) for _ in range(n))


PASSAGE = prose(1, 60)
TEXTS = [
    None, "", " \t\n ", "one", "One  two\nthree", "One two three", prose(2, 120), prose(2, 120), prose(3, 40) + " " + PASSAGE + " " + prose(4, 30), PASSAGE, PASSAGE + " x", "aa " * 700,
    prose(5, 300) + "\n" + PASSAGE, "Écrivez à a.b@mail.example.com, +1 (375) 555-4393 ou 10.0.0.1.", "password=abcd1234abcd1234ab 4111 1111 1111 1111", prose(2, 119) + " zzz", "y" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ("a", "b", None)[i % 3], 0) for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "en", "a", 0), (None, TEXTS[6], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as {c}")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words(t):
    return (t or "").encode().split()


def order(i):
    return (i is None, i if i is not None else 0)


def test_mix(docs, none, rows):
    got = mixing.mix(docs, block_words=8, shard_rows=5).collect()
    assert sorted((order(r.doc_id), r["size"]) for r in got) == sorted((order(i), len(words(t))) for i, t in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    total, of = sum(r["size"] for r in got), {}
    for r in docs.collect():
        of[r.source] = of.get(r.source, 0) + len(words(r.text))
    weight = dict(zip(sorted(of, key=lambda s: (s is None, s or "")), (1, 2, 3), strict=True))
    target, full = {}, set()
    while True:
        rest = total - sum(3 * of[s] for s in full)
        target = {s: 3 * of[s] if s in full else rest * weight[s] / sum(weight[x] for x in of if x not in full) for s in of}
        over = {s for s in of if s not in full and target[s] > 3 * of[s]}
        if not over:
            break
        full |= over
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in target.values()}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, block_words=8, shard_rows=5).collect()), key=str)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mixed_rows(none).count() == 0


@pytest.mark.parametrize("alike", [False, True])
def test_mixed_rows_of_null_and_repeated_ids(spark, alike):
    """Rows without ids, or with one id, are drawn each for itself, also where their texts are all the same."""
    rng = np.random.default_rng(8)
    text = lambda i: "w " * 100 if alike else " ".join(["w"] * int(rng.integers(50, 150))) + f" t{i}"
    rows = [(None if i % 2 else 7, text(i), "en", "abc"[i % 3], 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    held, taken = dict.fromkeys("abc", 0), dict.fromkeys("abc", 0)
    for r in rows:
        held[r[3]] += len(words(r[1]))
    for r in mixing.mixed_rows(docs, shard_rows=100).collect():
        taken[r.source] += len(words(r.text))
    target = {s: sum(held.values()) * (k + 1) / 6 for k, s in enumerate("abc")}
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in "abc"), (taken, target)


@pytest.mark.parametrize("keep", [simhash.keep_one, shingle_join.keep_one])
def test_rows_of_unlinked_texts_stay_whatever_their_ids(spark, keep):
    own = [(None, prose(60 + i, 80)) for i in range(3)] + [(7, prose(70, 80)), (7, prose(71, 80)), (8, prose(72, 80))]
    copies = [(None, own[0][1]), (7, own[3][1]), (9, own[5][1])]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in own + copies], SCHEMA).repartition(3)
    assert sorted(map(str, ((r.doc_id, r.text) for r in keep(docs).collect()))) == sorted(map(str, own))


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(4)
    for n, seats in [(1, 5), (4, 0), (7, 3), (9, 250), (30, 11)]:
        votes = rng.integers(1, 500, n).tolist()
        won = [0] * n
        for _ in range(seats):
            k = max(range(n), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[k] += 1
        df = spark.createDataFrame([(0, i, float(v), seats) for i, v in enumerate(votes)], "g int, p int, votes double, seats long")
        assert [r.won for r in mixing.apportion(df, ["g"], "p", "votes", "seats").orderBy("p").collect()] == won


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_exact_dedup(docs, none, rows, bits):
    norm = lambda t: b" ".join((b"\0" + (t or "").encode().replace(b"\0", b"") + b"\0").split())
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = exact_dedup.exact_duplicates(docs, slice_bits=bits).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    assert Counter(r.group_size for r in got) == Counter(len(v) for v in groups.values() for _ in v)
    assert Counter(map(order, (r.keep_id for r in got))) == Counter(min(map(order, v)) for v in groups.values() for _ in v)
    kept = exact_dedup.keep_first(docs, slice_bits=bits)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_language_model(docs, none, rows):
    got = ngram_lm.score(docs, batch_bytes=2000).collect()
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if fold(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(toks(t)), sum(c[w] > 0 for w in toks(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6), fold(i) == 0) for i, t in rows)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    assert ngram_lm.score(none).count() == 0


def test_language_model_batches_agree(docs):
    one = {(r.doc_id, r.n_tokens): r.score for r in ngram_lm.score(docs).collect()}
    many = {(r.doc_id, r.n_tokens): r.score for r in ngram_lm.score(docs, batch_bytes=500).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_weights_sum_to_one_and_find_the_mixture():
    rng = np.random.default_rng(2)
    p2, p1 = rng.random(4000), rng.random(4000) * 0.1
    w = ngram_lm.learn_weights(np.full(4000, 3), np.ones(4000), p2, p1, 1e-4)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > w[3, 1] and w[0, 0] == 0


def test_quality(docs, none, rows):
    got = line_quality.judge(docs).collect()
    assert sorted(r.n_words for r in got) == sorted(len(words(t)) for _, t in rows)
    assert all(r.base_failed for r in got if r.n_words < 50) and not any(r.kept for r in got if r.base_failed)
    assert line_quality.judge(none).count() == 0
    assert line_quality.repeat_words(b"a b c a b c d".split()) == 6
    assert line_quality.measures("a\n\nb\na #$") == (4, 5, 2, 0, 0)


def test_boilerplate_lines_go(spark):
    body = [(i, f"{prose(100 + i, 60)}\nfooter of the host", "en", "h", 0) for i in range(30)] + [(99, "footer of the host\n" * 60, "en", "h", 0), (100, None, "en", "h", 0)]
    df = spark.createDataFrame(body, SCHEMA)
    got = {r.doc_id: r for r in line_quality.judge(df).collect()}
    assert got[0].n_lost_words == 4 and got[0].kept
    profiles = line_quality.profile(df, "doc_id", "text", "source")
    clean = {r.doc_id: r.text for r in line_quality.without_boilerplate(df, line_quality.boilerplate(profiles)).collect()}
    assert "footer" not in clean[3] and clean[3] == body[3][1].split("\n")[0] and clean[100] is None


def test_personal_data(docs, none, rows):
    got = {r.doc_id: r for r in pii.find(docs).collect() if r.doc_id is not None}
    assert (got[13].n_email, got[13].n_ip, got[13].n_phone, got[14].n_card) == (1, 1, 1, 1)
    text = TEXTS[13]
    base = [f"{k}:{text.index(x)}:{text.index(x) + len(x)}" for k, x in (("email", "a.b@mail.example.com"), ("ip", "10.0.0.1"), ("phone", "+1 (375) 555-4393"))]
    assert got[13].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert "secret:9:27" in got[14].spans and got[0].spans == "" and got[6].spans == ""
    assert pii.find(none).count() == 0
    assert pii.redacted(docs.filter("doc_id in (0, 13)")).count() == 2


def test_field_on_held_out_lines_and_viterbi():
    model = pii.fresh(pii.train(pii.labelled_table(300), steps=80))
    table = pii.labelled_table(150, seed=77)
    lines = [[model.kind(w.encode()) for w, _ in line] for line in table]
    paths = pii.viterbi(model, lines)
    right = [pii.LABELS[p] == y for line, path in zip(table, paths, strict=True) for (_, y), p in zip(line, path, strict=True)]
    assert np.mean(right) > 0.98
    from itertools import product

    for kinds, path in list(zip(lines, paths, strict=True))[:40]:
        if len(kinds) > 3:
            continue
        e = [model.score[k][1] + (model.score[kinds[t - 1]][0] if t else model.score[0][0] * 0) + (model.score[kinds[t + 1]][2] if t + 1 < len(kinds) else model.score[0][2] * 0) for t, k in enumerate(kinds)]
        value = lambda ys: sum(e[t][y] for t, y in enumerate(ys)) + sum(model.pairs[a, b] for a, b in zip(ys, ys[1:], strict=False))
        assert abs(value(list(path)) - max(value(ys) for ys in product(range(len(pii.LABELS)), repeat=len(kinds)))) < 1e-9


def test_toxicity(spark, docs, none):
    bad = [(1000 + i, f"{prose(500 + i, 40)} scumbag {prose(900 + i, 5)}" if i % 4 == 0 else prose(700 + i, 45), "en", "a", 0) for i in range(400)]
    corpus = spark.createDataFrame(bad, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int("scumbag" in t)) for i, t, *_ in bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(corpus, labels).collect()}
    held = [(got[i].predicted, int("scumbag" in t)) for i, t, *_ in bad if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9
    same = toxicity.judge(docs, labels.filter("false")).collect()
    assert len(same) == docs.count() and all(r.score == 0 and r.predicted == 0 for r in same)
    model = toxicity.train(corpus, labels)
    scored = toxicity.score(docs.drop("score"), model)
    assert scored.columns == [*docs.drop("score").columns, "score"] and all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.judge(none, labels).count() == 0


def test_relative_lz(docs, none, rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, (True, 0)), order(i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {a + o for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < order(i) for o in range(13)}
        want.append((order(i), len(w), len(gone), hashlib.sha256(b" ".join(x for a, x in enumerate(w) if a not in gone)).hexdigest()))
    got = [(order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in relative_lz.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert relative_lz.remove_repeats(none).count() == 0


def test_suffix_sort(docs, none, rows):
    for window in (400, 70):
        seen = Counter(b[a : a + window] for _, t in rows for b in [(t or "").encode()] for a in range(len(b) - window + 1))
        want = []
        for i, t in rows:
            b = (t or "").encode()
            gone = np.zeros(len(b) + 2, int)
            for a in range(len(b) - window + 1):
                if seen[b[a : a + window]] > 1:
                    gone[a + 1 : a + 1 + window] = 1
            want.append((order(i), len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)).hexdigest()))
        got = [(order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_sort.remove_repeats(docs, window=window, bucket_rows=3).collect()]
        assert sorted(got) == sorted(want)
    assert suffix_sort.remove_repeats(none).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(3)
    texts = sorted(bytes(rng.integers(97, 99, rng.integers(0, 12))) for _ in range(300))
    runs = [sorted(texts[k::7]) for k in range(7)]
    coded = [[(suffix_sort.common(r[j - 1], x) if j else 0, x) for j, x in enumerate(r)] for r in runs]
    out = list(suffix_sort.LoserTree(coded))
    assert [x for _, x in out] == texts
    assert all(n == suffix_sort.common(a[1], b[1]) for a, b in zip(out, out[1:], strict=False) for n in [b[0]])


def test_packing(docs, none, rows):
    got = packing.pack(docs, lane_rows=7, capacity=256).collect()
    full = packing.encodings(packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))[0]
    want = []
    for i, t in rows:
        ids = np.array([*full.encode(t or "", allowed_special="all"), 0], "<u4")
        want += [(order(i), k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 256))]
    assert sorted((order(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(none).count() == 0


def test_token_ids_are_the_tokenizers(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    path = packing.public_tokenizers.path("byte_bpe_50k.tiktoken")
    for x in [*(t or "" for _, t in rows), "a  b", "it's <|endoftext|> x", "tab\t x  y \n z", "Ünïcode 日本語 123abc", " lead", "trail ", "\r\n\r\n"]:
        assert packing.token_ids(x, path).tolist() == t.encode(x, add_special_tokens=False).ids


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 5, 3])  # best fit opens 4 bins of 10 where 3 are enough
    bins = packing.best_fit(lengths, 10)
    better = packing.improve(lengths, [list(b) for b in bins], 10)
    assert len(better) <= len(bins) and sorted(i for b in better for i in b) == list(range(6))
    assert all(lengths[b].sum() <= 10 for b in better)
    rng = np.random.default_rng(0)
    sizes = rng.integers(300, 900, 400)
    start = packing.best_fit(sizes, 2048)
    done = packing.improve(sizes, [list(b) for b in start], 2048)
    assert len(done) <= len(start) and all(sizes[b].sum() <= 2048 for b in done) and sorted(i for b in done for i in b) == list(range(400))


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("max_bucket", [20_000, 2])
def test_simhash(docs, none, rows, max_bucket):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    ids = {}
    for (i, _), r in zip(rows, root, strict=True):
        ids[r] = min(ids.get(r, (True, 0)), order(i))
    got = simhash.near_groups(docs, max_bucket=max_bucket).collect()
    assert sorted((order(r.doc_id), r.fingerprint, order(r.component_id)) for r in got) == sorted((order(i), f"{f:016x}", ids[r]) for (i, _), f, r in zip(rows, fps, root, strict=True))
    kept = simhash.keep_one(docs, max_bucket=max_bucket)
    assert kept.columns == docs.columns and kept.count() == len(ids)
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    from itertools import combinations

    rng = np.random.default_rng(6)
    every = simhash.masks(radius)
    assert len(every) == (2 << radius) - 1
    for _ in range(3000):
        flip = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(m & flip == 0 for m in every)
    assert all(any(m >> a & 1 == 0 and m >> b & 1 == 0 for m in every) for a, b in combinations(range(64), 2))


def test_dense_cluster_is_one_component(spark):
    rng = np.random.default_rng(8)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(i) for i in rng.choice(60, int(rng.integers(0, 4)), replace=False)) for _ in range(300)}
    fps |= {int(x) for x in rng.integers(1 << 62, size=200)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from brightcask.llm.components import components

    for most in (20_000, 8):
        tied = components(simhash.links(df, 4, most)).collect()
        assert len({r.v for r in tied if (r.u ^ base).bit_count() <= 3 or (r.v ^ base).bit_count() <= 3}) == 1


def test_toxicity_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    rows = [(7, f"{prose(k, 20)} scumbag") for k in range(40)] + [(8, prose(1000 + k, 20)) for k in range(60)] + [(100 + k, prose(2000 + k, 20)) for k in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (9, 0), (None, 1), (100, None)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda p, u, *_: seen.update(p=len(p), u=len(u)))
    toxicity.train(corpus, labels, max_positive=10, max_unlabelled=30)
    assert 0 < seen["p"] <= 10 and 0 < seen["u"] <= 30


def test_packing_ties_and_many_short_documents(spark):
    docs = spark.createDataFrame([(k % 50, "a b c" if k % 3 else None) for k in range(3000)], "doc_id long, text string").repartition(2).cache()
    got, again = (sorted(map(tuple, packing.pack(docs, lane_rows=500, capacity=64).collect())) for _ in range(2))
    assert got == again and len(got) == 3000
    fills = Counter()
    for _, _, _, n, _, sequence, _ in got:
        fills[sequence] += n
    tokens = sum(fills.values())
    assert max(fills.values()) <= 64 and len(fills) <= -(-tokens // 64) + 6  # a bin for each lane


def test_improve_leaves_no_step():
    rng = np.random.default_rng(12)
    for _ in range(20):
        lengths = rng.integers(1, 40, int(rng.integers(5, 60)))
        bins = packing.improve(lengths, packing.best_fit(lengths, 64), 64)
        fill = [int(lengths[b].sum()) for b in bins]
        if len(bins) <= -(-int(lengths.sum()) // 64):
            continue
        for a, low in enumerate(bins):
            for b, other in enumerate(bins):
                if a == b or fill[b] < fill[a] or fill[b] == 64:
                    continue
                room = 64 - fill[b]
                assert all(lengths[i] > room for i in low)
                outs = [int(lengths[i]) for i in low] + [int(lengths[i] + lengths[j]) for k, i in enumerate(low) for j in low[k + 1 :]]
                assert not any(0 < o - int(lengths[j]) <= room for o in outs for j in other)


def test_patterns_of_personal_data_are_those_of_the_plain_expressions():
    import random
    import re

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = random.Random(3)
    for _ in range(30_000):
        text = "".join(draw.choice("ab1.2@-_% é") for _ in range(draw.randint(0, 24)))
        got = pii.pattern_spans(text)
        assert [s[1:] for s in got["email"]] == [m.span() for m in email.finditer(text)]
        assert [s[1:] for s in got["ip"]] == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + " b@c", "1." * 500_000, "a@b." * 250_000, "+1" + " " * 1_000_000])
def test_patterns_of_personal_data_in_a_megabyte(text):
    import time

    began = time.perf_counter()
    pii.pattern_spans(text)
    assert time.perf_counter() - began < 5


def test_found_spans_are_added_where_they_overlap_none():
    import random

    draw = random.Random(4)
    for _ in range(2000):
        spans = lambda n: [(draw.choice(pii.KINDS), a := draw.randrange(60), a + draw.randint(1, 8)) for _ in range(n)]
        base, found = spans(draw.randint(0, 6)), spans(draw.randint(0, 8))
        want, taken = list(base), [s[1:] for s in base]
        for k, a, b in found:
            if all(b <= x or y <= a for x, y in taken):
                want.append((k, a, b))
                taken.append((a, b))
        assert pii._add(base, found) == sorted(want, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))

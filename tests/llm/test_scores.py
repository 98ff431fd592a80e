"""What SQL cannot state of op1 and op3, against plain loops: the words that the mix takes, and the language model's scores."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightcask.llm import mixing, ngram_lm
from brightcask.llm.common import documents

SF = "/root/testdata/sf0.001"


def seats(votes, n):
    """Sainte-Lague one seat at a time; ties to the smaller party."""
    won = dict.fromkeys(votes, 0)
    for _ in range(n if sum(votes.values()) else 0):
        won[max(sorted(votes), key=lambda p: (votes[p] / (2 * won[p] + 1)))] += 1
    return won


@pytest.mark.parametrize("block, rows_in, wing", [(16, 20, 3), (128, 2000, 1024)])
def test_the_mix_takes_what_the_apportionment_says(spark, block, rows_in, wing):
    docs = documents(spark, SF)
    got = {r.doc_id: r for r in mixing.mix(docs, block_words=block, shard_rows=rows_in, wing_shards=wing).collect()}
    shards = -(-docs.count() // rows_in)
    size = F.lit(0) + mixing.word_count(F.col("text"))
    drawn = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", mixing.text_mark(F.col("text")), F.lit(7)).alias("draw"))
    rows = drawn.withColumn("shard", F.pmod(F.xxhash64("draw", F.col("size").cast("long")), F.lit(shards))).collect()
    turns = {(r.key, r.shard): r.turn for r in spark.createDataFrame([(k, s) for k in {f"s{r.source}" if r.source is not None else "n" for r in rows} for s in range(shards)], "key string, shard long").select("key", "shard", F.xxhash64("key", "shard", F.lit(7)).alias("turn")).collect()}

    key = lambda r: "n" if r.source is None else f"s{r.source}"
    held = defaultdict(Counter)
    for r in rows:
        held[key(r)][r.shard] += r["size"]
    target = {key(r): got[r.doc_id].target for r in rows}
    blocks = seats(target, math.floor(sum(target.values()) / block + 0.5))
    wanted = {}
    for k, of in held.items():
        wings = Counter()
        for s, n in of.items():
            wings[s // wing] += n
        for w, n in seats(wings, blocks[k]).items():
            for s, won in seats({s: m for s, m in of.items() if s // wing == w}, n).items():
                wanted[k, s] = won
    taken = Counter()
    for (k, s), won in wanted.items():
        words = held[k][s]
        full = words // block
        quota = min(won, 3 * words // block)
        passes = 0 if not words else min(3, math.floor(won * block / words + 0.5)) if not full else quota * block // words
        drawn_blocks = 0 if not full or passes >= 3 else min(full, math.floor((quota * block - passes * words) / block + 0.5))
        turn = turns[k, s] % max(full, 1)
        at = 0
        for r in sorted((r for r in rows if (key(r), r.shard) == (k, s)), key=lambda r: (r.draw, r.doc_id)):
            for word in range(at, at + r["size"]):
                b = word // block
                taken[r.doc_id] += passes + (b < full and (b * mixing.STEP + turn) % full < drawn_blocks)
            at += r["size"]
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: taken[r.doc_id] for r in rows}
    for k in held:
        of = sum(got[r.doc_id].taken for r in rows if key(r) == k)
        assert abs(of - target[k]) <= block * (len(held[k]) + 1)


def test_scores_are_those_of_a_plain_expectation_maximisation(spark):
    docs = documents(spark, SF)
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    dev = {i for i in train if zlib.crc32(str(i).encode()) % 20 == 1}
    start = object()

    def counts(ids):
        one, two, begun = Counter(), Counter(), Counter()
        for i in ids:
            tokens = [*texts[i], None]
            one.update(tokens)
            two.update(zip([start, *texts[i]], tokens, strict=True))
            begun[start] += 1
        return one, two, one + begun

    fit_one, fit_two, fit_context = counts(train - dev)
    one, two, context = counts(train)
    types, fit_tokens, total = len(one), sum(fit_one.values()), sum(one.values())
    bucket = lambda n: 0 if n == 0 else n.bit_length()

    rows = []
    for i in dev:
        for h, w in zip([start, *texts[i]], [*texts[i], None], strict=True):
            n = fit_context[h]
            rows.append((bucket(n), fit_two[h, w] / n if n else 0.0, fit_one[w] / fit_tokens))
    b, p2, p1 = (np.array(c) for c in zip(*rows, strict=True))
    p = np.stack([p2, p1, np.full(len(b), 1 / (types + 1))])

    def em(of, start_at, prior):
        w = start_at
        for _ in range(200):
            part = w[:, None] * p[:, of]
            part = (part / part.sum(0)).sum(1) + prior
            w = part / part.sum()
        return w

    every = em(np.ones(len(b), bool), np.full(3, 1 / 3), np.zeros(3))
    weights = defaultdict(lambda: every)
    low = np.array([0.0, every[1] + 1e-9, every[2] + 1e-9])
    weights[0] = low / low.sum()
    for k in np.unique(b).tolist():
        weights[k] = em(b == k, weights[k], 20.0 * weights[k])

    got = {r.doc_id: r for r in ngram_lm.score(docs, batch_bytes=100_000).collect()}
    for i, words in texts.items():
        want = 0.0
        for h, w in zip([start, *words], [*words, None], strict=True):
            n = context[h]
            l2, l1, l0 = weights[bucket(n)]
            want += math.log10(l2 * (two[h, w] / n if n else 0.0) + l1 * one[w] / total + l0 / (types + 1))
        assert abs(got[i].score - want) <= 0.002 * abs(want), (i, got[i].score, want)

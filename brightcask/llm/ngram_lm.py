"""Language-model scoring by deleted interpolation.

p(w | h) = l2(b) * c(h, w) / c(h) + l1(b) * c(w) / N + l0(b) / (V + 1): bigram and unigram maximum likelihood and the uniform
distribution over the known words and one unknown, mixed by weights for b, the bucket of the context's frequency c(h) (a power
of two). The weights are learned by expectation-maximisation on tokens of held-out training documents, with counts from the others
alone ("deleted"); the model itself then counts all training documents. A text starts in a context of its own and ends with an end token.

How the counts get to the texts without a row for each token: documents are dealt into batches of about batch_bytes. A batch asks for
its distinct words and bigrams once, by 64-bit keys in arrays, from the buckets that the keys are hashed to; a bucket adds up
what all batches have counted and answers every batch in the order of its question. Batches and buckets grow in number with
the corpus, not in size; a word or bigram in a third of all texts reaches its bucket once for each batch. Held-out documents have batches
of their own. What the driver sees is a table of at most some 100,000 cells (bucket, rounded probabilities) for the weights.

The rows of questions and answers are batches times buckets, but never more than the keys asked for. Trigrams are left out: on the larger
check table (134 million tokens) they are about 110 million more keys to ask for, 0.9 GB besides the 0.7 GB of bigrams, which the limit of
disk does not allow.

Null text counts as empty: one end token. A null id is in the fold of the empty text. Rows that repeat count and are scored each; batches
are dealt by id and text, so only rows alike in both share one. A very long text is a batch's larger part. Without training documents
every count is 0. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import crc_fold, staged

FOLDS = 10
DEV_FOLDS = 20  # fold 1 of so many is held out from the training documents for the weights
OTHER, FIT, DEV = 0, 1, 2
START = np.int64(0x5851F42D4C957F2D | 1)
END = np.int64(0x14057B7EF767814E)
STEPS = 4  # cells of the table have probabilities within a factor of 2^(1/STEPS)


def fold(id_col: str) -> Column:
    """Whether a document is outside the training (OTHER), counts for the weights' model (FIT) or for the weights (DEV)."""
    return F.when(crc_fold(id_col, FOLDS) == 0, OTHER).when(crc_fold(id_col, DEV_FOLDS) == 1, DEV).otherwise(FIT)


@dataclass
class Batch:
    """Tokens of a batch of texts, and its question: distinct keys in the order of bucket and key. Word keys are even, others odd."""

    lengths: np.ndarray  # tokens of each text
    word: np.ndarray  # by token: place of its word in the question
    context: np.ndarray  # by token: place of its context
    pair: np.ndarray  # by token: place of its bigram
    keys: np.ndarray
    bucket: np.ndarray


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def read(texts: list[str | None], buckets: int) -> Batch:
    known: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        got = np.fromiter((known.setdefault(w, len(known) + 2) for w in words), np.int64, len(words))
        ids += [got, np.array([1])]
        lengths.append(len(words) + 1)
    tokens = np.concatenate([np.empty(0, np.int64), *ids])
    context = np.append(0, tokens[:-1]) if len(tokens) else tokens
    context[tokens_start(lengths)] = 0
    word_key = np.concatenate([[START, END], np.fromiter((xxhash.xxh64_intdigest(w) & ~1 for w in known), np.uint64, len(known)).view(np.int64)])
    pairs, pair = np.unique(context << 32 | tokens, return_inverse=True)
    h, w = word_key[pairs >> 32].view(np.uint64), word_key[pairs & 0xFFFFFFFF].view(np.uint64)
    pair_key = (_mix(h * np.uint64(3) + _mix(w)) | np.uint64(1)).view(np.int64)
    keys = np.concatenate([word_key, pair_key])
    bucket = (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return Batch(np.array(lengths, np.int64), place[tokens], place[context], place[len(word_key) + pair], keys[order], bucket[order].astype(np.int64))


def tokens_start(lengths: list[int]) -> np.ndarray:
    return np.cumsum([0, *lengths[:-1]]) if lengths else np.empty(0, np.int64)


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def planes(keys: np.ndarray) -> bytes:
    """The keys' first bytes, then their second bytes and so on: sorted keys share high bytes, which the shuffle's compression finds so."""
    return keys.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _ask(buckets: int):
    """A batch's question, a row for each bucket: keys, and how often the batch's training documents have them."""

    def run(table: pa.Table) -> pa.Table:
        b = read(table.column("text").to_pylist(), buckets)
        train = table.column("fold").to_numpy() != OTHER
        of = np.repeat(train, b.lengths)
        n = np.bincount(b.word[of], minlength=len(b.keys)) + np.bincount(b.pair[of], minlength=len(b.keys))
        n[b.context[tokens_start(b.lengths.tolist())]] = train.sum()  # a text starts once
        cuts = np.append(np.flatnonzero(np.append(True, b.bucket[1:] != b.bucket[:-1])), len(b.keys))
        at = b.bucket[cuts[:-1]]
        keys = [planes(b.keys[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"bucket": pa.array(at, pa.int32()), "batch": pa.array(np.full(len(at), table.column("batch")[0].as_py()), pa.int32()), "keys": pa.array(keys, pa.binary()), "n": _lists(n, cuts, pa.int32())})

    return run


def _answer(batches: int):
    """A bucket's answers: the counts of all batches for the keys of each question, in its order, and to held-out batches also those of the
    fitting documents; on one row, the training words and tokens counted here."""

    def run(table: pa.Table) -> pa.Table:
        asked = [from_planes(x.as_buffer()) for x in table.column("keys")]
        lengths = np.array([len(x) for x in asked])
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = table.column("n").combine_chunks().values.to_numpy()
        is_dev = table.column("batch").to_numpy() >= batches
        dev_key = np.repeat(is_dev, lengths)
        total = np.bincount(at, n, len(keys)).astype(np.int64)
        fit = np.bincount(at[~dev_key], n[~dev_key], len(keys)).astype(np.int64)
        cuts, dev_cuts = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(lengths * is_dev))
        words = (keys % 2 == 0) & (total > 0)
        once = np.zeros(table.num_rows, np.int64)
        once[0] = 1
        sums = {k: pa.array(once * int(v)) for k, v in (("types", words.sum()), ("tokens", total[words].sum()), ("fit_tokens", fit[words].sum()))}
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "total": _lists(total[at], cuts, pa.int64()), "fit": _lists(fit[at[dev_key]], dev_cuts, pa.int64()), **sums})

    return run


def _answered(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(x.values.to_numpy() for x in table.sort_by("bucket").column(name))])


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 and the power of two of its frequency."""
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


def _ratio(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return a / np.maximum(b, 1)


def _cells(buckets: int, fit_tokens: int):
    """(b, q2, q1, n, p2, p1): held-out tokens by context bucket and rounded probabilities, with the sums of those."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if docs.num_rows:
            b, c = read(docs.column("text").to_pylist(), buckets), _answered(answers, "fit")
            p2, p1 = _ratio(c[b.pair], c[b.context]), _ratio(c[b.word], fit_tokens)
            q2, q1 = (np.where(p > 0, np.rint(-STEPS * np.log2(np.where(p > 0, p, 1))), -1).astype(np.int64) for p in (p2, p1))
            cell, at = np.unique((bucket_of(c[b.context]) * 1024 + q2 + 1) * 1024 + q1 + 1, return_inverse=True)
        else:
            cell, at, p2, p1 = (np.empty(0, np.int64) for _ in range(4))
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(np.bincount(at, minlength=len(cell)), pa.int64()), "p2": pa.array(np.bincount(at, p2, len(cell)), pa.float64()), "p1": pa.array(np.bincount(at, p1, len(cell)), pa.float64())})

    return run


def learn_weights(b: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, steps: int = 200, pseudo: float = 20.0) -> np.ndarray:
    """bucket x (l2, l1, l0) by expectation-maximisation. A bucket has, besides its tokens, pseudo tokens shared as the weights of all buckets are."""
    p = np.stack([p2, p1, np.full(len(b), p0)])
    shared = np.full(3, 1 / 3)
    for _ in range(steps if len(b) else 0):
        part = shared[:, None] * p
        part = (part / part.sum(0) * n).sum(1)
        shared = part / part.sum()
    weights = np.tile(shared, (65, 1))
    rest = shared[1:] + 1e-9
    weights[0] = [0.0, *(rest / rest.sum())]
    for bucket in np.unique(b):
        of = b == bucket
        prior = weights[bucket].copy()
        for _ in range(steps):
            part = weights[bucket][:, None] * p[:, of]
            part = (part / part.sum(0) * n[of]).sum(1) + pseudo * prior
            weights[bucket] = part / part.sum()
    return weights


def _score(buckets: int, weights: np.ndarray, tokens: int, types: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b, c = read(docs.column("text").to_pylist(), buckets), _answered(answers, "total")
        known = c[b.word]
        w = weights[bucket_of(c[b.context])]
        p = w[:, 0] * _ratio(c[b.pair], c[b.context]) + w[:, 1] * _ratio(known, tokens) + w[:, 2] / (types + 1)
        base = np.log10((known + 0.1) / (tokens + 0.1 * (types + 1)))
        of = np.repeat(np.arange(len(b.lengths)), b.lengths)
        sums = lambda x: np.bincount(of, x, len(b.lengths))
        return pa.table({"id": docs.column("id"), "held_out": pa.array(docs.column("fold").to_numpy() == OTHER), "n_tokens": pa.array(b.lengths), "n_known": pa.array(sums(known > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(b.lengths), tokens, np.int64)), "base_score": pa.array(sums(base)), "score": pa.array(sums(np.log10(p)))})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, batch_bytes: int = 12 << 20) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("fold", fold("id"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    held_out = max(1, -(-batches // DEV_FOLDS))
    buckets = 2 * batches
    draw = F.xxhash64("id", "text")
    rows = rows.withColumn("batch", F.when(F.col("fold") == DEV, batches + F.pmod(draw, F.lit(held_out))).otherwise(F.pmod(draw, F.lit(batches))).cast("int"))

    asked = rows.groupBy("batch").applyInArrow(_ask(buckets), "bucket int, batch int, keys binary, n array<int>")
    answers = staged(asked.groupBy("bucket").applyInArrow(_answer(batches), "batch int, bucket int, total array<long>, fit array<long>, types long, tokens long, fit_tokens long"), "counts")
    types, tokens, fit_tokens = (x or 0 for x in answers.agg(F.sum("types"), F.sum("tokens"), F.sum("fit_tokens")).first())

    dev = rows.filter(F.col("fold") == DEV).groupBy("batch").cogroup(answers.filter(F.col("batch") >= batches).select("batch", "bucket", "fit").groupBy("batch"))
    cells = dev.applyInArrow(_cells(buckets, fit_tokens), "cell long, n long, p2 double, p1 double").groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("n", "p2", "p1")]).toArrow()
    cell, n, p2, p1 = (cells.column(x).to_numpy() for x in ("cell", "n", "p2", "p1"))
    weights = learn_weights(cell >> 20, n, p2 / np.maximum(n, 1), p1 / np.maximum(n, 1), 1 / (types + 1))

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.groupBy("batch").cogroup(answers.select("batch", "bucket", "total").groupBy("batch")).applyInArrow(_score(buckets, weights, tokens, types), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)

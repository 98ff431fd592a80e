"""Toxicity by non-negative positive-unlabelled learning.

A linear model over a text's distinct words, each taken as itself and its five- and six-letter parts, hashed, is trained in numpy from two samples: confirmed toxic documents (positives) and plain
documents without a label (unlabelled). With the class prior p, the risk of calling an unlabelled document toxic is corrected for the
toxic ones among them: R = p * R_p(+) + max(0, R_u(-) - p * R_p(-)); where the second part falls below zero, the step goes the
other way, so the model can't fit its positives by driving that part negative.

Only the fit uses a sample, of at most max_positive and max_unlabelled documents, drawn by a hash of their ids. Scoring reads every
whole text. Only labels outside the held-out fold are read, and of those only which documents are toxic and, for the
prior, their share. Id, language and source are never features.

Null and empty texts get the score of a text without words. A null id belongs to a fold like any other and has no label. Without a
confirmed toxic document nothing is known about toxicity, and every score is 0. Rows that repeat score alike; of ids that repeat, all
rows may be drawn, up to the same bounds. Very long texts are read whole. Empty tables give empty results; columns of docs stay as they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import crc_fold

BITS = 18
EDGES = ".,;:!?\"'()[]{}*#$%&|<>"
SAMPLE_BITS = 30


@dataclass
class Model:
    weights: np.ndarray  # 2^BITS
    bias: float


def words_of(text: str | None) -> set[str]:
    """Distinct words of the text, lower case, without punctuation at their edges."""
    return {w.strip(EDGES) for w in (text or "").lower().split()}


def parts(word: str) -> list[int]:
    """Hashes of the word and of its five- and six-letter parts; its ends count as letters."""
    held = f"<{word}>"
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in {held, *(held[i : i + n] for n in (5, 6) for i in range(len(held) - n + 1))}]


def features(text: str | None) -> np.ndarray:
    return np.array([x for w in words_of(text) for x in parts(w)], np.int64)


def telling(positive: np.ndarray, unlabelled: np.ndarray, positives: int, others: int, least_z: float = 5.0, least_docs: int = 3) -> np.ndarray:
    """Features that significantly more positives have than unlabelled documents do, from the documents with each feature; the model leaves out the rest."""
    p_rate, u_rate = positive / positives, (unlabelled + 1) / (others + 2)
    z = (p_rate - u_rate) / np.sqrt(u_rate * (1 - u_rate) * (1 / positives + 1 / others))
    return np.flatnonzero((positive >= least_docs) & (z > least_z))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, *, steps: int = 500, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Adam on the non-negative risk of the whole sample, with the logistic loss. Rows hold indexes into chosen."""

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.empty(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), [len(x) for x in rows])

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    (p_col, p_doc), (u_col, u_doc), k = matrix(positive), matrix(unlabelled), len(chosen)
    w = np.zeros(k + 1)  # the last is the bias
    w[k] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp = np.bincount(p_doc, w[p_col], len(positive)) + w[k]
        zu = np.bincount(u_doc, w[u_col], len(unlabelled)) + w[k]
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        hit, miss, gu = -prior * sigmoid(-zp) / len(positive), -prior * sigmoid(zp) / len(positive), sigmoid(zu) / len(unlabelled)
        gp, gu = (hit + miss, gu) if rest >= 0 else (-miss, -gu)
        g = np.append(np.bincount(p_col, gp[p_doc], k) + np.bincount(u_col, gu[u_doc], k) + decay * w[:k], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w[:k]
    return Model(weights, float(w[k]))


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents with it, unlabelled ones with it) of each batch; feature 2^BITS counts all documents."""
    for batch in batches:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[0 if toxic else 1][np.append(np.unique(features(text.as_py())), 1 << BITS)] += 1
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["feature", "p", "u"])


def _columns(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << BITS, -1)
        column[chosen] = np.arange(len(chosen))
        for batch in batches:
            cols = [column[features(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([c[c >= 0] for c in cols], pa.list_(pa.int32()))], names=["place", "at"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, folds: int = 5, max_positive: int = 4000, max_unlabelled: int = 16000) -> Model | None:
    """A model from the labels outside fold 0; None if they confirm no toxic document."""
    seen = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (crc_fold("id", folds) != 0))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << SAMPLE_BITS))
    n, toxic = seen.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    if not toxic:
        return None
    few = lambda rows, of: F.lit(min(1.0, rows / max(of, 1)) * (1 << SAMPLE_BITS))
    chosen = seen.filter(F.col("toxic") & (draw < few(0.95 * max_positive, toxic))).select("id").distinct()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    confirmed = slim.join(F.broadcast(chosen), "id")  # at most about max_positive ids
    plain = slim.filter((crc_fold("id", folds) != 0) & (draw < few(0.95 * max_unlabelled, docs.count())))
    sample = confirmed.select("text", F.lit(True).alias("toxic")).unionByName(plain.select("text", F.lit(False).alias("toxic")))
    held = sample.mapInArrow(_holders, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    counts = np.zeros((2, (1 << BITS) + 1), np.int64)
    counts[:, held.column("feature").to_numpy()] = held.column("p").to_numpy(), held.column("u").to_numpy()
    (positives, others), counts = counts[:, -1], counts[:, :-1]
    if not positives or not others:
        return None
    chosen = telling(*counts, positives, others)

    def drawn(rows: DataFrame, most: int) -> list[np.ndarray]:
        """The features of at most so many rows, in an order of their own whatever task they come from, so that the same rows make the same model."""
        placed = rows.select(F.xxhash64("id", "text").alias("place"), "text").mapInArrow(_columns(chosen), "place long, at array<int>")
        few = placed.orderBy("place", "at").limit(most).toArrow()
        return [np.asarray(x.values, np.int64) for x in few.column("at")]

    return fit(drawn(confirmed, max_positive), drawn(plain, max_unlabelled), chosen, min(max(toxic / n, 1e-3), 1 - 1e-3))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out, which it must not have yet."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, worth = shared.value, {}
        for batch in batches:
            z = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                words = words_of(text.as_py())
                if len(worth) > 200_000:
                    worth.clear()
                worth.update((w, float(model.weights[parts(w)].sum())) for w in words if w not in worth)
                z[i] = math.fsum(worth[w] for w in words) + model.bias
            arrays = [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    kept = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept))
    scored = renamed.mapInArrow(run, f"{schema}, c{len(kept)} double")
    return scored.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate([*kept, out])])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, folds=folds)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, (crc_fold(id_col, folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

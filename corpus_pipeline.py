"""The corpus pipeline: toxicity, exact dedup, near-dedup by shingles, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of docs.

- toxicity: documents scored 0.5 or more go.
- exact_dedup: of equal texts the smallest doc_id stays.
- near_dedup: of a group linked by 5-word shingles of Jaccard similarity 0.8 or more the smallest doc_id stays. Links come from op10's method
  (SimHash fingerprints, covering tables) with an exact check, and from a join of shingles for pairs whose fingerprints are further apart.
- mix_sources: a document comes as often as the mix takes it, or not at all; a share of one is drawn by a seeded hash.
- pack: one row per piece, as op8 returns it.

Every stage takes nulls in any column: null text is the empty text, a null id no label and, in near_dedup, no smallest id where its group
has any other; rows with null or repeated ids are rows of their own all the same. A null source is a source of its own. Empty texts score
like texts without words, are copies of each other, and the mix never takes them, as it counts words. Very long texts are read whole and
cut only by pack. Of ties and repeated rows one stays in the two dedup stages; afterwards a document comes as often as the mix takes it.
Empty tables pass through as empty ones. All columns stay, whatever their names, up to pack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightcask.llm import exact_dedup, mixing, packing, shingle_join, toxicity
from brightcask.llm.common import documents, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return toxicity.score(docs, model, out=name).filter(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("pack", pack)]

#: Learning, components and packing are not SQL's; tests/llm/test_pipeline.py holds each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

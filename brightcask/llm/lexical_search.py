"""Ranked lexical search over postings in Spark tables.

1. index(): one pass over the texts counts each document's terms and keeps those that any item may have: a set of bits, of fixed size, at
   the hashes of the items' terms, goes to the tasks. The postings of a document are one row, its terms in the order of their buckets.
2. search(): postings (term, tf, n) meet the item terms, every match is scored in whole numbers, the scores of an item and a document are
   summed up, and a window ranks each item's documents.

Postings are dealt out by slices of documents and not by terms. A document's matches then meet in one task: their sums need no shuffle,
where postings dealt by term would send nearly every match on as a sum of its own (46 million matches for 51,282 documents and 200 items); and a term in every document is spread over all tasks. Item terms are broadcast in blocks of whole items, about so many terms at
once; more items are more blocks. Every match is scored; only an item's best documents of each task go on to the window.

Null texts have no terms: such documents are not counted, such items have no rows. Documents with null ids are ranked after those with ids
of equal score. Repeated rows are documents, or items, of their own. Very long texts are read whole. Without documents or items there are
no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightcask.llm.common import staged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Byte by byte: A-Z in lower case, everything that separates terms as a space.
FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Bits for the items' terms (2 MB), buckets of terms, documents of a slice, and item terms that are broadcast at once.
FILTER_BITS, TERM_BUCKETS, SLICE_DOCS, BLOCK_TERMS = 1 << 24, 64, 4096, 20_000


@dataclass
class Index:
    """postings: (tag, id, n, terms, tfs), a row per document; docs, words: documents with a term, and all their terms."""

    postings: DataFrame
    docs: int
    words: int


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, times): an item is a row of items; times counts a term's repeats."""
    text = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), text.alias("text"))
    each = numbered.select("item", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("term"))
    return staged(each.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times")), "item-terms")


def _bits(terms: DataFrame) -> bytes:
    """FILTER_BITS bits, set at the CRC-32 of every term: at most as many bytes as that reach the driver and the tasks."""
    at = terms.select((F.crc32(F.col("term").cast("binary")) % FILTER_BITS).alias("at")).distinct()
    cells = at.groupBy(F.shiftright("at", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 5, "<u4")
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.tobytes()


def _counted(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, crc = FILTER_BITS - 1, zlib.crc32
        for b in batches:
            n, terms, tfs, at = [], [], [], [0]
            for text in b.column("text"):
                words = (text.as_py() or "").encode().translate(FOLD).split()
                kept = []
                for term, tf in Counter(words).items():
                    h = crc(term) & last
                    if bits[h >> 3] >> (h & 7) & 1:
                        kept.append((h % TERM_BUCKETS, term, tf))
                kept.sort()
                terms += [k[1] for k in kept]
                tfs += [k[2] for k in kept]
                n.append(len(words))
                at.append(len(terms))
            ends = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tag"), pa.array(n, pa.int64()), *lists], names=["id", "tag", "n", "terms", "tfs"])

    return run


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of the documents for all terms (column term) that may be asked for."""
    slim = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tag"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    postings = staged(slim.mapInArrow(_counted(_bits(terms)), f"id {kind}, tag long, n long, terms array<string>, tfs array<long>"), "postings")
    return Index(postings, *postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first())


def match_score(docs: int, words: int) -> Column:
    """What an occurrence of a term in an item adds for a document, for each unit of the term's weight, in whole numbers."""
    m = f"(75L + (25L * n * {docs}L) div {max(words, 1)}L)"
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * {m})")


def weight(docs: int, df: Column) -> Column:
    return F.floor(F.lit(1000) * F.log(F.lit(float(2 * docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def search(found: Index, terms: DataFrame, top: int = 20, *, slice_docs: int = SLICE_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents. terms: (item, item_id, term, times), as item_terms makes them."""
    df = found.postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(df, "term").select("item", "item_id", "term", (F.col("times") * weight(found.docs, F.col("df"))).alias("gain"))
    weighed = staged(weighed.filter("gain > 0"), "weighed-terms")
    slices = max(1, -(-found.docs // slice_docs))
    single = found.postings.repartition(slices, "tag").select("tag", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("at"))
    single = single.select("tag", "id", F.col("at.terms").alias("term"), F.col("at.tfs").alias("tf"), "n").select("tag", "id", "term", match_score(found.docs, found.words).alias("part"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "tag")
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-weighed.count() // block_terms))))
    ranked = []
    for k, n in weighed.groupBy(block).count().toArrow().to_pandas().itertuples(index=False):  # a row per block
        asked = weighed.filter(block == k).select("item", "term", "gain")
        asked = F.broadcast(asked) if n <= 4 * block_terms else asked  # above: an item of very many terms, which Spark joins as it sees fit
        scored = single.join(asked, "term").groupBy("item", "tag", "id").agg(F.sum(F.col("gain") * F.col("part")).alias("score")).filter("score > 0")
        ranked.append(staged(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), "ranked"))
    names = weighed.select("item", "item_id").distinct()
    if not ranked:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(found.postings.schema["id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).filter("false")
    return functools.reduce(DataFrame.unionByName, ranked).join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, top: int = 20, **options) -> DataFrame:
    """Each item's `top` best documents: item_id, rank, doc_id, score."""
    terms = item_terms(items)
    return search(index(docs, terms), terms, top, **options)

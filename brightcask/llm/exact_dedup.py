"""Exact dedup with a two-pass Bloom filter, in DataFrame functions alone.

First pass: every text's hash sets its positions in a fixed number of bits, and the filter keeps the bits that were set
twice or more. Second pass: a row with a position outside the filter has a text of its own and passes straight through;
only the others, possibly repeated, are shuffled and grouped by their full SHA-256. The filter has `slice_bits` bits for each
of its hashes, so what is broadcast is bounded by the parameter (2 x 2^25 bits: at most 2^20 rows of two longs).
When there are far more rows than bits, the filter lets more rows through to the shuffle; results stay exact.

Null text counts as the empty text. Of equal texts the smallest id stays, a null id last; of rows with equal text and equal id,
exactly one stays. Very long texts are hashed whole. Empty tables give empty results. Other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import SPACES, staged, whole_row

SLICE_BITS = 1 << 25
HASHES = 2


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with every run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary"), 256))


def _position(digest: Column, i: int, slice_bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(slice_bits)) + F.lit(i * slice_bits)


def repeat_filter(digests: DataFrame, slice_bits: int = SLICE_BITS, hashes: int = HASHES) -> DataFrame:
    """(cell, bits): the 64-bit cells of the filter that have a bit set by two rows or more. digests has the column digest."""
    at = F.explode(F.array(*[_position(F.col("digest"), i, slice_bits) for i in range(hashes)])).alias("at")
    twice = digests.select(at).groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return twice.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))


def mark_repeats(df: DataFrame, filt: DataFrame, slice_bits: int = SLICE_BITS, hashes: int = HASHES) -> DataFrame:
    """df (with the column digest) and maybe: whether all positions of its digest are in the filter."""
    maybe = F.lit(True)
    for i in range(hashes):
        cells = filt.select(F.col("cell").alias(f"cell{i}"), F.col("bits").alias(f"bits{i}"))
        df = df.withColumn(f"at{i}", _position(F.col("digest"), i, slice_bits)).withColumn(f"cell{i}", F.shiftright(f"at{i}", 6))
        df = df.join(F.broadcast(cells), f"cell{i}", "left")  # bounded by slice_bits * hashes / 64 rows
        maybe = maybe & (F.expr(f"coalesce(bits{i}, 0L) & shiftleft(1L, cast(at{i} % 64 as int))") != 0)
    return df.withColumn("maybe", maybe).drop(*[f"{k}{i}" for i in range(hashes) for k in ("at", "cell", "bits")])


def duplicate_groups(marked: DataFrame) -> DataFrame:
    """(digest, first, group_size) of every text that two rows or more have; marked has digest, maybe, id and tag."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("tag").alias("tag")))
    return marked.filter("maybe").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bits: int = SLICE_BITS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    slim = staged(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tag"), text_digest(F.col(text_col)).alias("digest")), "digests")
    filt = staged(repeat_filter(slim, slice_bits), "repeat-filter")
    marked = mark_repeats(slim, filt, slice_bits)
    groups = staged(duplicate_groups(marked), "duplicate-groups")
    alone = marked.filter("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    met = marked.filter("maybe").join(groups, "digest", "left")
    met = met.select("id", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("first.tag") == F.col("tag"), F.lit(True)).alias("kept"), "digest")
    return alone.unionByName(met).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bits: int = SLICE_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows outside the filter are never shuffled."""
    slim = staged(docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("tag"), text_digest(F.col(text_col)).alias("digest")), "digests")
    filt = staged(repeat_filter(slim, slice_bits), "repeat-filter")
    groups = staged(duplicate_groups(mark_repeats(slim, filt, slice_bits)), "duplicate-groups")
    marked = mark_repeats(whole_row(docs, id=docs[id_col], digest=text_digest(docs[text_col])), filt, slice_bits)
    alone = marked.filter("not maybe").select("row")
    met = marked.filter("maybe").join(groups.select("digest", "first"), "digest", "left")
    single = met.filter("first is null").select("row")
    first = met.filter("first is not null and id <=> first.id").dropDuplicates(["digest"]).select("row")
    return alone.unionByName(single).unionByName(first).select("row.*")

"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of its bit in the hashes of the text's shingles. For radius r every bit position gets a
non-zero vector of r + 1 bits, and each of the 2^(r+1) - 1 masks keeps the positions whose vector has an odd product with the
mask's own. Whatever r positions two fingerprints differ in, some mask is orthogonal to all r vectors and keeps none of them, so
the pair is sure to collide in that mask's table: no link is missed.

Documents with one fingerprint are one node. A bucket's members are searched from a start through all that are within the radius,
each member once, and leave only links to the smallest member of what was reached, never all pairs. Buckets above
max_bucket are taken apart by the midpoints of their members: two members are within the radius exactly if flipping up to half
of it on either side meets in one value; that takes a fixed number of rows per member and no comparison of pairs.

Null text and text without words have fingerprint zero and are linked like any other. A null id takes part; a component whose ids
are all null has a null id. Rows that repeat have one fingerprint and so one component. Very long texts are read whole, their hashes
counted part by part. Empty tables give empty results; other columns are not read, and keep_one leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import only_rows, row_order, staged, text_mark
from brightcask.llm.components import components

BITS = 64


def shingle_hashes(text: str | None, words_in: int = 4) -> np.ndarray:
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= words_in:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    start = np.cumsum([0, *(len(w) + 1 for w in words)])
    ends = start[words_in:] - 1
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[: len(ends)].tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))


def fingerprint(text: str | None, words_in: int = 4) -> int:
    """Signed, as Spark's long."""
    return majority(shingle_hashes(text, words_in))


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(words_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array([fingerprint(t.as_py(), words_in) for t in b.column("text")], pa.int64())], names=["id", "mark", "fp"])

    return run


def masks(radius: int) -> list[int]:
    """Signed bit masks, one for each table."""
    vectors = [i % ((2 << radius) - 1) + 1 for i in range(BITS)]
    kept = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 << radius)]
    return [k - (1 << BITS) if k >> (BITS - 1) else k for k in kept]


def reach(fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest member that each can reach by steps within the radius. fps are sorted."""
    root, bits = np.arange(len(fps)), fps.view(np.uint64)
    rest = root.copy()
    while len(rest):
        start, rest = rest[0], rest[1:]
        front = np.array([start])
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(bits[front[at : at + 256], None] ^ bits[rest][None, :]) <= radius).any(0)
            front, rest = rest[near], rest[~near]
            root[front] = start
    return fps[root]


def _bucket_links(radius: int, max_bucket: int):
    """Sorted (place, key, fp) in; (fp, root) of linked members out, or (fp, null) for the members of a bucket above max_bucket."""

    def links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = reach(fps, radius)
        moved = root != fps
        return fps[moved], root[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_at, large = np.empty(0, np.int64), None, False

        def out(us: list, vs: list, many: list) -> pa.RecordBatch:
            u, v, m = (np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs, many))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, m])), pa.concat_arrays([pa.array(v), pa.nulls(len(m), pa.int64())])], names=["fp", "root"])

        def close(fps: np.ndarray, us: list, vs: list, many: list) -> None:
            if large:
                many.append(fps)
            elif len(fps) > 1:
                u, v = links(fps)
                us.append(u)
                vs.append(v)

        for b in batches:
            place, key, fp = (b.column(i).to_numpy() for i in range(3))
            us, vs, many = [], [], []
            cut = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            runs = list(zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True))
            if held_at is not None and len(fp) and (place[0], key[0]) != held_at:
                close(held, us, vs, many)
                held, large = held[:0], False
            for a, z in runs[:-1] if len(fp) else []:
                if a == 0 and len(held):
                    close(np.concatenate([held, fp[a:z]]), us, vs, many)
                    held, large = held[:0], False
                elif z - a > 1 or large:
                    large = large or z - a > max_bucket
                    close(fp[a:z], us, vs, many)
                    large = False
                elif a == 0:
                    large = False
            if len(fp):
                a = runs[-1][0]
                held, held_at = np.concatenate([held, fp[a:]]) if a == 0 else fp[a:], (place[-1], key[-1])
                if a > 0:
                    large = False
                if len(held) > max_bucket or large:
                    many.append(held)
                    held, large = held[:0], True
            yield out(us, vs, many)
        us, vs, many = [], [], []
        close(held, us, vs, many)
        yield out(us, vs, many)

    return run


def links(fps: DataFrame, radius: int = 4, max_bucket: int = 20_000) -> DataFrame:
    """fps: distinct (fp). Returns (u, v): links whose components are those of all pairs within the radius."""
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])).alias("at")
    buckets = fps.select("fp", spread).select("at.place", "at.key", "fp").repartition("place", "key").sortWithinPartitions("place", "key", "fp")
    found = staged(buckets.mapInArrow(_bucket_links(radius, max_bucket), "fp long, root long"), "bucket-links")
    near = found.filter("root is not null").select(F.col("fp").alias("u"), F.col("root").alias("v"))
    if radius % 2:
        raise ValueError("the radius must be even: midpoints need half of it")
    if not (members := found.filter("root is null").select("fp").distinct()).head(1):
        return near
    flips = [sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(range(BITS), n)]
    flips = [f - (1 << BITS) if f >> (BITS - 1) else f for f in flips]
    flip = members.sparkSession.createDataFrame([(f,) for f in flips], "flip long")
    mids = staged(members.crossJoin(F.broadcast(flip)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")), "midpoints")  # a fixed number of flips
    least = staged(mids.groupBy("mid").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mid", "least"), "least")
    return near.unionByName(mids.join(least, "mid").filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")))


def grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, words_in: int, max_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(rows, of): rows (id, fp) of docs, and of (fp, first): the row (none, id, mark) that comes first in the fingerprint's component."""
    slim = docs.select(F.col(id_col).alias("id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    rows = staged(slim.mapInArrow(_fingerprints(words_in), f"id {docs.schema[id_col].dataType.simpleString()}, mark long, fp long"), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min(row_order("id", "mark")).alias("first")), "nodes")
    tied = components(links(nodes.select("fp"), radius, max_bucket))
    placed = staged(nodes.join(tied.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root")), "placed")
    ids = staged(placed.groupBy("root").agg(F.min("first").alias("first")), "component-firsts")
    return rows, staged(placed.drop("first").join(ids, "root").select("fp", "first"), "components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 4, words_in: int = 4, max_bucket: int = 20_000) -> DataFrame:
    """One row per row of docs: id_col, fingerprint, component_id."""
    rows, of = grouped(docs, id_col, text_col, radius, words_in, max_bucket)
    return rows.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 4, words_in: int = 4, max_bucket: int = 20_000) -> DataFrame:
    """Of each component of docs the row that comes first: by id, null last, then by the text's hash. Rows of other components stay, whatever ids they share."""
    _, of = grouped(docs, id_col, text_col, radius, words_in, max_bucket)
    return only_rows(docs, of.select("first.id", "first.mark").distinct(), id_col, text_col)

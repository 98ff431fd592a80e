"""Best-fit packing of token sequences, improved by swap-based local search.

A document is its token ids and an end id. Only a document longer than the capacity is cut, into full pieces after a first piece
that holds the odd rest; full pieces are sequences already. The others are dealt at random over lanes of about lane_rows pieces. In
each lane, best fit in decreasing order opens the bins; then the emptiest bins are dissolved: their documents move to fuller bins,
or change places with one shorter document there, or two of them with one, so that the sum of squared fills grows with every step,
until no step is left or as few bins remain as the lane's tokens need. Nothing else ends the search, and all documents of a bin and all
pairs of them are tried. Lanes bound what a task holds; each ends with at most one bin that could not be filled from another lane.

Token ids come from the rank file of the byte-level BPE. White space that is never doubled needs no look-ahead in the splitting
pattern, which then runs about twice as fast; texts with doubled white space take the full pattern.

Null text counts as empty: one piece of the end id alone. Null ids are packed like others. Rows that repeat are packed as often as they
come. Of documents with equal lengths the one that was dealt first comes first. Very long texts are tokenised whole and cut. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightcask.llm.common import staged

CAPACITY = 2048
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
#: public_tokenizers.PATTERN for texts without doubled white space.
SINGLE_SPACED = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
DOUBLED = re.compile(r"[\s\x85][\s\x85]")

_encodings: dict[str, tuple[tiktoken.Encoding, tiktoken.Encoding]] = {}


def encodings(ranks_path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """(for any text, for texts without doubled white space); made once for each Python worker."""
    if ranks_path not in _encodings:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks_path] = tuple(tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens=SPECIAL) for n, p in (("any", public_tokenizers.PATTERN), ("single", SINGLE_SPACED)))
    return _encodings[ranks_path]


def token_ids(text: str | None, ranks_path: str) -> np.ndarray:
    """The ids of a text, little-endian unsigned 32-bit, without the end id."""
    whole, single = encodings(ranks_path)
    return (whole if DOUBLED.search(text or "") else single).encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece."""
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, draw): a row per piece; draw is a number to deal the pieces by."""
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = ["piece", "start", "length", "ids_crc32", "draw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), 0, np.array([END_ID], "<u4")
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate([token_ids(text.as_py(), ranks_path), end])
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    out.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes()), zlib.crc32(b"%d,%d" % (part, seen))))
                    seen += 1
            cols = np.array(out, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, draw long")
    return out.withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes; the longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left: the bins
    left: list[int] = []  # the rooms that some bin has, sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(left, n)
        if at == len(left):
            bins.append([])
            b, r = len(bins) - 1, capacity
        else:
            r = left[at]
            b = room[r].pop()
            if not room[r]:
                left.pop(at)
        bins[b].append(i)
        r -= n
        if r:
            if not room[r]:
                insort(left, r)
            room[r].append(b)
    return bins


def improve(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins: out of the emptiest into fuller ones, until no bin has a step left.

    Every step makes the sum of squared fills larger, so it ends. As few bins as the tokens need are not improved on.
    """
    fewest = -(-int(lengths.sum()) // capacity)
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    where = np.empty(len(lengths), np.int64)
    for b, members in enumerate(bins):
        where[members] = b
    alive, moved = len(bins), True
    while moved and alive > fewest:
        moved = False
        heap = [(int(fill[b]), int(b)) for b in np.flatnonzero((fill > 0) & (fill < capacity))]
        heapify(heap)
        while heap and alive > fewest:
            had, low = heappop(heap)
            if had != fill[low] or (into := _step(low, lengths, bins, fill, where, capacity)) is None:
                continue
            moved = True
            alive -= int(fill[low] == 0)
            for b in (low, into):
                if 0 < fill[b] < capacity:
                    heappush(heap, (int(fill[b]), b))
    return [b for b in bins if b]


def _step(low: int, lengths: np.ndarray, bins: list[list[int]], fill: np.ndarray, where: np.ndarray, capacity: int) -> int | None:
    """One move out of bin low, or the exchange of one or two of its documents for a shorter one that leaves it emptiest. The other bin is as full at least; None if there is no step."""
    free = capacity - fill
    mine: dict[int, list[int]] = {}
    for i in bins[low]:
        mine.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(mine, reverse=True)  # few: distinct lengths of one bin add up to its capacity at most

    def shift(out: list[int], back: list[int], b: int) -> int:
        for i, a, z in [*((i, low, b) for i in out), *((i, b, low) for i in back)]:
            bins[a].remove(i)
            bins[z].append(i)
            where[i] = z
        gain = int(lengths[out].sum()) - int(lengths[back].sum())
        fill[low] -= gain
        fill[b] += gain
        return int(b)

    fuller = (fill >= fill[low]) & (free > 0)
    fuller[low] = False
    other = np.flatnonzero(fuller)
    for n in sizes:  # move: the longest that fits, to the fullest bin with room
        fits = other[free[other] >= n]
        if len(fits):
            return shift(mine[n][:1], [], fits[np.argmin(free[fits])])
    theirs = np.flatnonzero(fuller[where])
    if not len(theirs):
        return None
    theirs = theirs[np.argsort(lengths[theirs], kind="stable")]
    size = lengths[theirs]
    most = np.maximum.accumulate(size + free[where[theirs]])  # what may take the place of one of the documents up to here
    out = {n: mine[n][:1] for n in sizes}
    for k, n in enumerate(sizes):
        for m in sizes[k:]:
            if n + m not in out and (n != m or len(mine[n]) > 1):
                out[n + m] = [mine[n][0], mine[m][-1]]
    sums = np.fromiter(out, np.int64, len(out))
    at = np.searchsorted(most, sums)  # for each, the shortest document whose place it may take
    gain = np.where(at < len(size), sums - size[np.minimum(at, len(size) - 1)], 0)
    k = int(np.argmax(gain))
    return shift(out[int(sums[k])], [int(theirs[at[k]])], where[theirs[at[k]]]) if gain[k] > 0 else None


def pack_lane(lane: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Adds bin and offset to the pieces of a lane."""
    lane = lane.sort_values("draw", kind="stable").reset_index(drop=True)
    lengths = lane["length"].to_numpy(np.int64)
    bin_of, offset = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    full = np.flatnonzero(lengths >= capacity)
    bin_of[full] = np.arange(len(full))
    short = np.flatnonzero(lengths < capacity)
    for b, members in enumerate(improve(lengths[short], best_fit(lengths[short], capacity), capacity) if len(short) else []):
        of = short[members]
        bin_of[of] = len(full) + b
        offset[of] = np.cumsum(lengths[of]) - lengths[of]
    return lane.assign(bin=bin_of, offset=offset)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, lane_rows: int = 4096, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = staged(pieces(docs, id_col, text_col, capacity, ranks_path).withColumnRenamed(id_col, "id"), "pieces")
    lanes = max(1, cut_up.count() // lane_rows)
    dealt = cut_up.withColumn("lane", F.pmod(F.xxhash64("draw"), F.lit(lanes)))
    schema = T.StructType([*dealt.schema, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType())])
    packed = dealt.groupBy("lane").applyInPandas(lambda lane: pack_lane(lane, capacity), schema)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.shiftleft("lane", 32) + F.col("bin")).alias("sequence_id"), "offset")

"""What the two substring operators share: finding the windows of a corpus that may repeat, and taking repeats out.

A window is so many consecutive units (words or bytes) of one document. Its anchor is the k-gram with the smallest hash among those
inside it, so equal windows have equal anchors at the same place, and neighbouring windows mostly share theirs. Only windows whose
anchor occurs twice can repeat. The windows of one occurrence of an anchor are a piece.

Anchors are counted by a shuffle of (anchor, document) and the repeated ones go back to their documents by a join, so nothing that grows
with the corpus is broadcast and texts without a repeated anchor end there.

k-grams that are frequent in a sample of documents are anchors only of windows that have no others. A passage of a third of all documents
then has pieces of its own text alone, equal in all of them, and windows that reach beyond it have an anchor that is rare. The sample
decides only where the work is done: windows that are equal have equal anchors whatever it holds.

Null and empty texts have no windows. Texts are read whole, however long: windows in segments that overlap by a window. Rows that
repeat, with or without an id, are rows of their own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import dropped, staged

NO_ID = (1 << 63) - 1  # a null id comes after all others
POS_BITS = 28
PIECE_WINDOWS = 32  # of words, at most
CELL_BITS = 22  # classes of k-grams whose frequency is kept: 512 KB of flags
RANGES = "id long, th long, start int, n int"


@dataclass(frozen=True)
class Units:
    """words: whether units are words or bytes; window and k in units, k a power of two."""

    words: bool
    window: int
    k: int


_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def kgrams(unit: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-gram."""
    h = unit
    for step in range(k.bit_length() - 1):  # hashes of 2, 4, ... k units
        h = _mix(h[: -(1 << step)] * np.uint64(2 * step + 3) + _mix(h[1 << step :]))
    return h


def anchors(unit: np.ndarray, u: Units, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its anchor's place and hash. unit: a number for each unit; common: flags by class of k-gram."""
    h = kgrams(unit, u.k)
    place = np.uint64((1 << POS_BITS) - 1)
    rank = (h >> np.uint64(1)) | (common[h >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(63))
    least = (rank & ~place) | (np.arange(len(h), dtype=np.uint64) & place)
    many, have = u.window - u.k + 1, 1
    while 2 * have <= many:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < many:
        least = np.minimum(least[: len(least) - (many - have)], least[many - have :])
    at = (least & place).astype(np.int64)
    return at, h[at].view(np.int64)


class Chunk:
    """Some texts one after another: a number for each unit, where each text starts, and the words or the bytes themselves."""

    def __init__(self, texts: pa.Array, u: Units) -> None:
        if u.words:
            split = pc.ascii_split_whitespace(texts)
            full = pc.greater(pc.binary_length(split.values), 0)  # white space at an edge makes an empty word
            self.words = split.values.filter(full)
            self.start = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy()]
            coded = self.words.dictionary_encode()
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
            self.unit = hashes[coded.indices.to_numpy()]
        else:
            parts = [t.encode() for t in texts.to_pylist()]
            self.data = b"".join(parts)
            self.start = np.append(0, np.cumsum([len(x) for x in parts], dtype=np.int64))
            self.unit = _BYTE[np.frombuffer(self.data, np.uint8)]

    def pieces(self, u: Units, common: np.ndarray, most: int = 1 << 20) -> list[np.ndarray]:
        """(text, place of the first window, windows, place of the anchor, anchor) for stretches of windows with one anchor; at most so many windows are looked at at once."""
        text = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        out = [[np.empty(0, np.int64)] * 5]
        for first in range(0, len(self.unit) - u.window + 1, most):
            at, h = anchors(self.unit[first : first + most + u.window - 1], u, common)
            i = np.arange(first, first + len(h))
            inside = text[i] == text[i + u.window - 1]
            i, at, h = i[inside], at[inside] + first, h[inside]
            if not len(i):
                continue
            # Where words go on and on alike every window has an anchor of its own, but with one hash, which is all that words need.
            new = np.append(True, (i[1:] != i[:-1] + 1) | ((h[1:] != h[:-1]) if u.words else (at[1:] != at[:-1])))
            if u.words:
                since = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                new |= since % PIECE_WINDOWS == 0
            new = np.flatnonzero(new)
            out.append([text[i[new]], i[new], np.diff(np.append(new, len(i))), at[new], h[new]])
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def chunks(batch: pa.RecordBatch, u: Units) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about a million units: arrays over them stay small."""
    most = (4 if u.words else 1) << 20
    part = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cut, cut[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


# ---- which k-grams are frequent


def _counted(u: Units):
    """(cell, n) of the classes of k-grams that a task has twice or more; cell -1 counts all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for part in chunks(batch, u):
                unit = Chunk(part.column("text"), u).unit
                if len(unit) >= u.k:
                    np.add.at(n, (kgrams(unit, u.k) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(n.sum(), n[at]))], names=["cell", "n"])

    return run


def frequent(rows: DataFrame, u: Units, sample: int = 20_000, least: int = 20) -> Broadcast:
    """Flags of the classes of k-grams that are frequent among about `sample` documents, eight to a byte."""
    every = max(1, rows.count() // sample)
    counts = rows.filter(F.pmod(F.xxhash64("th"), F.lit(every)) == 0).select("text").mapInArrow(_counted(u), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = counts.filter("cell = -1").first()
    cells = counts.filter(F.col("n") > max(least, 8 * (total.n if total else 0) >> CELL_BITS)).filter("cell >= 0").select("cell").toArrow()  # at most 2^CELL_BITS / 8
    flags = np.zeros(1 << CELL_BITS, np.uint8)
    flags[cells.column("cell").to_numpy()] = 1
    return rows.sparkSession.sparkContext.broadcast(np.packbits(flags))


# ---- which windows may repeat


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, th, doc): doc stands for the id and the text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("th", F.xxhash64("text")).withColumn("doc", F.xxhash64("id", "th"))


def _of(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A number for an anchor in a text; a chance clash only makes a window go further than it need."""
    return _mix(anchor.view(np.uint64) + text.astype(np.uint64) * _MUL)


def _sightings(u: Units, shared: Broadcast):
    """(anchor, doc, n) for each row's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(shared.value)
        for batch in batches:
            for part in chunks(batch, u):
                text, _, _, _, anchor = Chunk(part.column("text"), u).pieces(u, common)
                _, at, n = np.unique(_of(text, anchor), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), part.column("doc").take(pa.array(text[at])), pa.array(n)], names=["anchor", "doc", "n"])

    return run


def candidates(rows: DataFrame, u: Units, shared: Broadcast) -> DataFrame:
    """(id, th, text, anchors): the rows with an anchor that two rows have (bytes: or one row twice), and those anchors.

    Two rows with one id and one text are one document here: for words they are no repeats of each other, and for bytes n counts both.
    """
    seen = staged(rows.select("doc", "text").mapInArrow(_sightings(u, shared), "anchor long, doc long, n long"), "sightings")
    every = seen.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("n").alias("n"))
    twice = every.filter("lo < hi" if u.words else "n > 1").select("anchor")
    of = staged(seen.join(twice, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("anchors")), "repeated-anchors")  # no more than a row has
    dropped(seen)
    return rows.join(of, "doc").select("id", "th", "text", "anchors")


def found(part: pa.RecordBatch, u: Units, common: np.ndarray) -> tuple[Chunk, list[np.ndarray]]:
    """A chunk of candidates, and those of its pieces (see Chunk.pieces) whose anchor is repeated."""
    chunk = Chunk(part.column("text"), u)
    pieces = chunk.pieces(u, common)
    lists = part.column("anchors")
    known = _of(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy())
    hit = np.isin(_of(pieces[0], pieces[4]), known)
    return chunk, [x[hit] for x in pieces]


def joined(i: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Ranges of windows, with those that meet in a document as one."""
    order = np.lexsort((start, th, i))
    i, th, start, n = i[order], th[order], start[order], n[order]
    if not len(i):
        return [i, th, start, n]
    end = start + n
    new = np.append(True, (i[1:] != i[:-1]) | (th[1:] != th[:-1]) | (start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return [i[at], th[at], start[at], np.maximum.reduceat(end, at) - start[at]]


# ---- taking repeats out


def without(docs: DataFrame, ranges: DataFrame, u: Units, id_col: str, text_col: str) -> DataFrame:
    """id_col, n_units, n_removed, n_spans, kept_sha256 for every row of docs; ranges: (id, th, start, n) repeated windows."""
    of = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))  # no more than the document has windows
    rows = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = rows.withColumn("th", F.xxhash64("text")).join(of, ["id", "th"], "left")
    names = ["given", "n_units", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                kept, counts = cut(text.as_py(), ranges.as_py() or [], u)
                out.append((*counts, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("given"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return met.select("given", "text", "ranges").mapInArrow(run, f"given {kind}, n_units long, n_removed long, n_spans long, kept_sha256 string")


def cut(text: str | None, ranges: list[dict], u: Units) -> tuple[bytes, tuple[int, int, int]]:
    """What is left of the text (words joined by one space), and its units, the removed ones and their runs."""
    data = (text or "").encode()
    units = data.split() if u.words else data
    gone = np.zeros(len(units) + 2, np.int8)
    for r in ranges:
        gone[r["start"] + 1 : r["start"] + r["n"] + u.window] = 1
    runs = int((np.diff(gone) == 1).sum())
    mask = gone[1:-1].astype(bool)
    if not runs:
        return (b" ".join(units) if u.words else data), (len(units), 0, 0)
    kept = b" ".join(w for w, g in zip(units, mask.tolist(), strict=True) if not g) if u.words else np.frombuffer(data, np.uint8)[~mask].tobytes()
    return kept, (len(units), int(mask.sum()), runs)

"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the text of all documents with smaller ids, in blocks: a block holds the pieces (see repeats.py) of a range of anchors,
and every piece goes to the block of its anchor, the only one in which its windows can be found. A block is indexed by a suffix
array over its words. Each piece is parsed greedily: from where a factor ends the longest one is searched for that also starts in a smaller
document, among the nearest suffixes of smaller ids before and after in the array. A factor as long as a window at least makes all windows
inside it duplicates without a search of their own, and at its end the windows across the boundary are looked up one by one, for they may
occur elsewhere in the block.

Parsing has two rounds of the same kind. A task first parses its own pieces against each other; of those it sends on only the words
around windows that it did not find. So a passage of a third of all documents reaches its block once for each task. The blocks then
find what lies in other tasks. Rows of a block come in order of anchor and id; a task holds one block, of about block_rows pieces. An
anchor with more pieces than that is no task's: its pieces fall apart into windows, which meet by their words.

A window is a duplicate if its words also start in a document with a smaller id; a null id counts as larger than all, and rows with
one id are no duplicates of each other. Null and empty texts have no words. Rows with equal id and text get equal results. Very long
texts are read in overlapping segments. Empty tables give empty results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import staged
from brightcask.llm.repeats import RANGES, Units, candidates, chunks, found, frequent, joined, slim, without

BLOCK_ROWS = 50_000
PIECES = "anchor long, id long, th long, start int, n int, body binary"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


class Block:
    """The words of pieces one after another, and the suffix array of the places where a window starts."""

    def __init__(self, bodies: pa.Array, window: int) -> None:
        split = pc.split_pattern(bodies, " ")
        self.window, self.words = window, split.values
        self.start = split.offsets.to_numpy().astype(np.int64)  # of each piece, and the end
        lengths = np.diff(self.start)
        self.piece = np.repeat(np.arange(len(lengths)), lengths)
        self.left = self.start[1:][self.piece] - np.arange(len(self.piece))  # words of the piece from here on
        self.at = np.flatnonzero(self.left >= window)
        levels = [self.words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1]
        width, longest = 1, int(lengths.max(initial=1))
        while width < longest:  # ranks of 1, 2, 4 ... words; an end comes before any word
            rank = levels[-1]
            after = np.zeros_like(rank)
            after[:-width] = np.where(self.left[:-width] > width, rank[width:], 0)
            levels.append(np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1)
            width *= 2
        self.order = self.at[np.argsort(levels[-1][self.at], kind="stable")]
        self.shared = self._shared(levels)

    def _shared(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each suffix shares with the one before it in order."""
        a, b = self.order[:-1], self.order[1:]
        most, n = np.minimum(self.left[a], self.left[b]), np.zeros(max(0, len(self.order) - 1), np.int64)
        for i in range(len(levels) - 1, -1, -1):
            live = n < most
            n[live] += (levels[i][a[live] + n[live]] == levels[i][b[live] + n[live]]).astype(np.int64) << i
        return np.minimum(n, most)

    def index(self, ids: np.ndarray) -> None:
        """Makes factors() ready; ids: of the pieces.

        Only suffixes that share a window with a neighbour can begin a factor. Of 1, 2, 4 ... of them from each on it is noted which id is
        least and how few words neighbours share, as far as the largest group of suffixes with one window goes.
        """
        twin = self.shared >= self.window
        kept = np.flatnonzero(np.append(False, twin) | np.append(twin, False)) if len(self.order) else np.empty(0, np.int64)
        self.row = np.full(len(self.piece), -1, np.int64)
        self.row[self.order[kept]] = np.arange(len(kept))
        shared = np.zeros(len(kept), np.min_scalar_type(int(self.shared.max(initial=0))))  # with the suffix before it
        near = np.flatnonzero(np.diff(kept) == 1) + 1
        shared[near] = self.shared[kept[near] - 1]
        own = np.unique(ids, return_inverse=True)[1].astype(np.int32)
        self.least, self.fewest = [own[self.piece[self.order[kept]]]], [shared]
        group = np.diff(np.append(np.flatnonzero(shared < self.window), len(kept)))
        for k in range(int(group.max(initial=1)).bit_length() - 1):
            for levels in (self.least, self.fewest):
                levels.append(np.minimum(levels[k][: -(1 << k)], levels[k][1 << k :]))

    def factors(self, places: np.ndarray) -> np.ndarray:
        """The most words from each of the places on, a window at least, that also start in a piece with a smaller id; else 0.

        Of all suffixes with a smaller id the one that shares most is the nearest before or the nearest after in order. Both are found by
        jumps of 2^k suffixes, the longest first, over those with no smaller id.
        """
        out = np.zeros(len(places), np.int64)
        some = np.flatnonzero(self.row[places] >= 0)
        row = self.row[places[some]]
        mine, last = self.least[0][row], len(self.least[0]) - 1
        for back in (True, False):
            at, n = row.copy(), np.full(len(row), np.iinfo(np.int64).max)
            for k in range(len(self.least) - 1, -1, -1):
                low = at - (1 << k) if back else at + 1  # the first suffix jumped over
                fits = np.flatnonzero(low >= 0 if back else at + (1 << k) <= last)
                low, links = low[fits], self.fewest[k][low[fits] + 1 if back else low[fits]]
                far = (links >= self.window) & (self.least[k][low] >= mine[fits])
                n[fits[far]] = np.minimum(n[fits[far]], links[far])
                at[fits[far]] += -(1 << k) if back else 1 << k
            ends = np.flatnonzero(at > 0 if back else at < last)
            link, met = self.fewest[0][at[ends] if back else at[ends] + 1], self.least[0][at[ends] + (-1 if back else 1)]
            good = (link >= self.window) & (met < mine[ends])
            out[some[ends[good]]] = np.maximum(out[some[ends[good]]], np.minimum(n[ends[good]], link[good]))
        return out

    def parse(self, ids: np.ndarray) -> np.ndarray:
        """By word: whether the window that starts here is a duplicate. Factors are looked for where the one before ends, and windows that
        reach beyond a factor's end are looked up; all others lie in a factor and need no search."""
        self.index(ids)
        gone = np.zeros(len(self.piece) + 1, np.int32)
        crossing = np.zeros(len(self.piece), bool)
        at, last = self.start[:-1].copy(), self.start[1:] - self.window
        while (live := np.flatnonzero(at <= last)).size:
            here = at[live]
            length = self.factors(here)
            hit = length > 0
            first, stop, end = here[hit], (here + length)[hit], last[live[hit]]
            np.add.at(gone, first, 1)
            np.add.at(gone, stop - self.window + 1, -1)
            across = (stop[:, None] + np.arange(1 - self.window, 0)).ravel()
            across = across[across <= np.repeat(end, self.window - 1)]
            crossing[across] = self.factors(across) > 0
            at[live] = here + np.where(hit, length, 1)
        return (np.cumsum(gone)[:-1] > 0) | crossing

    def runs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, first window in it, windows) of each run of windows with of set."""
        flag = np.concatenate([[0], (of & (self.left >= self.window)).astype(np.int8), [0]])
        change = np.diff(flag)
        first, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        piece = self.piece[first]
        return piece, first - self.start[piece], stop - first


def _rows(cols: list, kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in names.split(", ")])


def _bodies(words: pa.Array, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The n words from each of first on, joined by spaces."""
    cuts = np.append(0, np.cumsum(n))
    at = np.arange(cuts[-1]) + np.repeat(first - cuts[:-1], n)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(at)).cast(pa.binary())), pa.scalar(b" ", pa.binary()))


def _own(u: Units, shared, block_rows: int):
    """Candidates in; PIECES out: what the task finds among its own (without a body), and what it sends on."""

    def settle(held: list[list]) -> Iterator[pa.RecordBatch]:
        anchor, i, th, start = (np.concatenate([x[c] for x in held]) for c in range(4))
        block = Block(pa.concat_arrays([x[4] for x in held]), u.window)
        gone = block.parse(i)
        piece, first, n = block.runs(gone)
        known = joined(i[piece], th[piece], start[piece] + first, n)
        yield _rows([known[1], *known, pa.nulls(len(known[0]), pa.binary())], KINDS, PIECES)
        piece, first, n = block.runs(~gone)
        yield _rows([anchor[piece], i[piece], th[piece], start[piece] + first, n, _bodies(block.words, block.start[piece] + first, n + u.window - 1)], KINDS, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, held, many = np.unpackbits(shared.value), [], 0
        for batch in batches:
            for part in chunks(batch, u):
                chunk, (text, first, n, _, anchor) = found(part, u, common)
                i, th = (part.column(c).to_numpy() for c in ("id", "th"))
                held.append([anchor, i[text], th[text], first - chunk.start[text], _bodies(chunk.words, first, n + u.window - 1)])
                many += len(text)
                if many >= block_rows:
                    yield from settle(held)
                    held, many = [], 0
        if many:
            yield from settle(held)

    return run


def _blocks(window: int, block_rows: int):
    """PIECES in order of anchor and id in, no anchor with more than block_rows of them; RANGES out."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        i, th, start = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "th", "start"))
        block = Block(table.column("body").combine_chunks(), window)
        piece, first, n = block.runs(block.parse(i))
        return _rows(joined(i[piece], th[piece], start[piece] + first, n), KINDS[1:5], RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < block_rows or not batch.num_rows:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            if last := int(np.searchsorted(anchor, anchor[-1])):  # the last anchor may go on
                yield settle(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _windows(window: int):
    """PIECES in; (words, id, th, start) of each of their windows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                split = pc.split_pattern(part.column("body"), " ")
                n = part.column("n").to_numpy().astype(np.int64)
                piece = np.repeat(np.arange(part.num_rows), n)
                place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
                words = _bodies(split.values, split.offsets.to_numpy().astype(np.int64)[piece] + place, np.full(len(piece), window))
                i, th, start = (part.column(c).to_numpy().astype(np.int64)[piece] for c in ("id", "th", "start"))
                yield _rows([words, i, th, start + place], [pa.binary(), pa.int64(), pa.int64(), pa.int32()], "words binary, id long, th long, start int")

    return run


def _of_hot_anchors(pieces: DataFrame, u: Units) -> DataFrame:
    """RANGES of pieces whose anchors have too many for one task: windows meet by their own words, the least id summed up before the shuffle."""
    windows = staged(pieces.mapInArrow(_windows(u.window), "words binary, id long, th long, start int"), "hot-windows")
    first = windows.groupBy("words").agg(F.min("id").alias("first"), F.max("id").alias("most")).filter("first < most").select("words", "first")
    return windows.join(first, "words").filter("id > first").select("id", "th", "start", F.lit(1).alias("n"))


def duplicate_windows(docs: DataFrame, id_col: str, text_col: str, u: Units, block_rows: int) -> DataFrame:
    rows = slim(docs, id_col, text_col)
    shared = frequent(rows, u)
    pieces = staged(candidates(rows, u, shared).mapInArrow(_own(u, shared, block_rows), PIECES), "pieces")
    sent = pieces.filter("body is not null")
    hot = staged(sent.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > block_rows).select("anchor"), "hot-anchors")
    blocks = sent.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "id")
    out = pieces.filter("body is null").select("id", "th", "start", "n").unionByName(blocks.mapInArrow(_blocks(u.window, block_rows), RANGES))
    return out.unionByName(_of_hot_anchors(sent.join(hot, "anchor", "left_semi"), u))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256."""
    u = Units(words=True, window=window, k=4 if window > 4 else 1)
    out = without(docs, duplicate_windows(docs, id_col, text_col, u, block_rows), u, id_col, text_col)
    return out.select(F.col("given").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")

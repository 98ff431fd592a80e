"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Only suffixes that start at an anchor seen twice (see repeats.py) can begin a repeat, so the suffix array is sparse: it holds those,
each cut where its anchor's windows end, with the bytes before the anchor that its windows reach back to.

1. Each task sorts its suffixes into runs and front-codes them: a row has the length of the prefix that it shares with the row
   before it, and the rest. Pieces that are equal lie side by side in a run: they repeat, and one row stands for them from there on.
2. Runs are exchanged by ranges of the suffixes' first bytes, which Spark samples, so partitions follow on each other in the order of
   suffixes: one order over the whole corpus, in which suffixes with a common anchor lie together.
3. The runs of a partition are combined by a loser tree that knows, for every head of a run, the prefix it shares with the
   last suffix given out. The head that shares more comes first; only equal prefixes are compared, and only from there on. The
   prefixes of the combined order come out as well.
4. The suffixes of an anchor are swept by these prefixes from the longest down. Neighbours that share so much are joined, the smaller
   set into the larger, and each set is kept in order of the bytes before the anchor, where the neighbours have most in
   common. What a suffix has in common on both sides of the anchor says which of its windows also start elsewhere.

A window repeats if it also starts anywhere else, same document included. Null text counts as empty; matches never cross
documents; rows that repeat, with or without ids, are repeats of each other. Rows with equal id and text get equal results. Very long
texts are read in overlapping segments. Empty tables give empty results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import staged
from brightcask.llm.repeats import RANGES, Units, candidates, chunks, found, frequent, joined, slim, without

RUN_ROWS = 10_000
RUN_SCHEMA = "head binary, run long, seq int, shared int, rest binary, before binary, id long, th long, start int, n int"


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the longest common prefix, of which at bytes are known."""
    end = min(len(a), len(b))
    step = 16
    while at < end and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= end:
        return end
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return min(at, end)


def _runs(u: Units, shared, run_rows: int):
    """Candidates in; RUN_SCHEMA out: sorted, front-coded runs, and rows without a head that say which windows repeat.

    The first k bytes of a suffix are its head. Of the pieces that are equal in a run, one goes on with n = 0: nothing is to be learnt of it.
    """

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        cols = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RUN_SCHEMA.split(", ")])

    def code(rows: list[tuple], run: int) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[:2])
        out, same, last, seq = [], [], b"", 0
        for p, (suffix, before, i, th, start, n) in enumerate(rows):
            twin = p + 1 < len(rows) and rows[p + 1][:2] == (suffix, before)
            if twin or same:
                same.append((i, th, start, n))
            if twin:
                continue
            if same:
                i, th, start, n = 0, 0, 0, 0
            k = common(last, suffix)
            k = k if k >= u.k else u.k
            out.append((suffix[: u.k], run, seq, k, suffix[k:], before, i, th, start, n))
            last, seq = suffix, seq + 1
            for x in same:
                out.append((None, None, None, None, None, None, *x))
            same = []
        twice = [x for x in out if x[0] is None]
        cols = joined(*(np.array([x[c] for x in twice], np.int64) for c in range(6, 10)))
        yield rows_of([x for x in out if x[0] is not None])
        yield rows_of([(None, None, None, None, None, None, *x) for x in zip(*(c.tolist() for c in cols), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, part, number, rows = np.unpackbits(shared.value), TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for some in chunks(batch, u):
                chunk, (text, first, n, place, _) = found(some, u, common)
                i, th = (some.column(c).to_numpy()[text].tolist() for c in ("id", "th"))
                data, start = chunk.data, (first - chunk.start[text]).tolist()
                for a, m, p, *x in zip(first.tolist(), n.tolist(), place.tolist(), i, th, start, strict=True):
                    rows.append((data[p : a + m + u.window - 1], data[a:p], *x, m))
                if len(rows) >= run_rows:
                    yield from code(rows, (part << 24) + number)
                    number, rows = number + 1, []
        yield from code(rows, (part << 24) + number)

    return run


class LoserTree:
    """Merges sorted runs of (shared, suffix, ...): shared is the prefix shared with the run's suffix before."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.next = [0] * len(runs)
        self.lost: list[tuple[int, int]] = [(-1, 0)] * self.size  # by node: the run that lost here, its prefix shared with the winner

    def _head(self, run: int) -> bytes | None:
        return self.runs[run][self.next[run]][1] if 0 <= run < len(self.runs) and self.next[run] < len(self.runs[run]) else None

    def _play(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser); both come with the prefix that they share with the last suffix given out."""
        (ra, na), (rb, nb) = a, b
        x, y = self._head(ra), self._head(rb)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if na != nb:  # known prefixes decide
            return (a, b) if na > nb else (b, a)
        n = common(x, y, na)
        first = x[n:n + 1] < y[n:n + 1] or (x[n:n + 1] == y[n:n + 1] and ra < rb)
        return (a, (rb, n)) if first else (b, (ra, n))

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return (node - self.size, 0)
        winner, self.lost[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple]:
        """(prefix shared with the one before, suffix, ...) in order."""
        winner = self._build(1)
        while self._head(winner[0]) is not None:
            run = winner[0]
            item = self.runs[run][self.next[run]]
            yield (winner[1], *item[1:])
            self.next[run] += 1
            head = self._head(run)
            winner = (run, self.runs[run][self.next[run]][0] if head is not None else 0)
            node = (run + self.size) // 2
            while node:
                winner, self.lost[node] = self._play(winner, self.lost[node])
                node //= 2


def repeated(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, th, first window, windows) that repeat; group: (shared, suffix, before, id, th, start, n) in suffix order, with one anchor.

    A window that begins o bytes before the anchor repeats if another piece has o bytes before and window - o from the anchor on in common.
    """
    back = [x[2][::-1] for x in group]
    place = {p: r for r, p in enumerate(sorted(range(len(group)), key=back.__getitem__))}
    piece = sorted(range(len(group)), key=place.__getitem__)
    best = [-1] * len(group)  # bytes before the anchor known to be in common, from the longest shared suffix down
    home = list(range(len(group)))
    sets = [[place[p]] for p in range(len(group))]  # of the first piece of each joined stretch

    def top(p: int) -> int:
        while home[p] != p:
            home[p] = home[home[p]]
            p = home[p]
        return p

    def met(p: int, before: int, shared: int) -> Iterator[tuple[int, int, int, int]]:
        if before <= best[p]:
            return
        _, _, b, i, th, start, n = group[p]
        first, last = max(best[p] + 1, window - shared, len(b) - n + 1), min(before, len(b))
        best[p] = before
        if first <= last and n:
            yield i, th, start + len(b) - last, last - first + 1

    for p in sorted(range(1, len(group)), key=lambda p: -group[p][0]):
        shared, small, large = group[p][0], top(p - 1), top(p)
        if len(sets[small]) > len(sets[large]):
            small, large = large, small
        for r in sets[small]:
            at = bisect_left(sets[large], r)
            for other in sets[large][max(0, at - 1) : at + 1]:
                before = common(back[piece[r]], back[piece[other]])
                yield from met(piece[r], before, shared)
                yield from met(piece[other], before, shared)
            sets[large].insert(at, r)
        sets[small] = []
        home[small] = large


def _combine(window: int, k: int):
    def repeats(runs: list[list[tuple]]) -> Iterator[tuple[int, int, int, int]]:
        group: list[tuple] = []
        for item in LoserTree(runs):
            if group and item[0] < k:
                if len(group) > 1:
                    yield from repeated(group, window)
                group = []
            group.append(item)
        if len(group) > 1:
            yield from repeated(group, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[int, list[tuple]]] = []
        last = b""
        for batch in batches:
            for head, number, _, shared, rest, before, i, th, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not runs or runs[-1][0] != number:
                    runs.append((number, []))
                    last = b""
                # A run goes on in the next partition with another head, so what is shared with a row there is the head at most.
                last = last[:shared] + rest if last[:k] == head else head + rest
                runs[-1][1].append((shared if runs[-1][1] and shared > k else common(runs[-1][1][-1][1], last) if runs[-1][1] else 0, last, before, i, th, start, n))
        out = list(repeats([r for _, r in runs]))
        cols = joined(*(np.array(c, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 4)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "th", "start", "n"])

    return run


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, u: Units, run_rows: int, bucket_rows: int) -> DataFrame:
    rows = slim(docs, id_col, text_col)
    shared = frequent(rows, u)
    runs = staged(candidates(rows, u, shared).mapInArrow(_runs(u, shared, run_rows), RUN_SCHEMA), "runs")
    sent = runs.filter("head is not null")
    buckets = max(1, sent.count() // bucket_rows)
    ranges = sent.repartitionByRange(buckets, "head").sortWithinPartitions("run", "seq")
    return runs.filter("head is null").select("id", "th", "start", "n").unionByName(ranges.mapInArrow(_combine(u.window, u.k), RANGES))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 400, run_rows: int = RUN_ROWS, bucket_rows: int = 10_000) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    u = Units(words=False, window=window, k=32 if window >= 64 else 4)
    out = without(docs, repeated_windows(docs, id_col, text_col, u, run_rows, bucket_rows), u, id_col, text_col)
    return out.select(F.col("given").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")

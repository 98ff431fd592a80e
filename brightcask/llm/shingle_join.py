"""Near-dedup by SimHash and covering locality-sensitive hashing, as op10 does it, with an exact check of word shingles, and a join of
shingles for what fingerprints tell apart: every pair with Jaccard 0.8 or more is found, and no other is linked.

Fingerprints are those of a text's set of 5-word shingles. Those within 4 bits are linked by simhash.links; the links whose sets have
similarity 0.8 stand, and what they tie together is one component from there on. Most pairs of similarity 0.8 differ in more bits than
covering tables are affordable for, so a join of shingles follows, which compares only texts that are not in one component yet.

A text is the set of its 5-word shingles' hashes; texts with one set are one node. Two sets with similarity 0.8 share at least four
fifths of either, so in any one order of all shingles they share one of each one's first n - ceil(0.8 n) + 1 (prefix filter). Nodes
meet in the buckets of those shingles. A pair is a candidate if its sizes, what is left behind the shared shingle and the distance
of its parity sketches (a lower bound of the symmetric difference) allow 0.8; all candidates are compared by their whole sets. The
order only decides the work: shingles that are frequent in a sample of documents come last.

Of buckets above few members the first round takes a search forest of the candidates only, and the second round all candidate pairs
whose members are not in one component by then: a large group of copies takes no comparison of all pairs. What can still be
quadratic is a shingle shared by very many texts that stay as near as a candidate and are not linked.

Null text and text without words are one node. Null ids take part, as in simhash. Rows that repeat are one node. Very long texts are
read whole. Empty tables give empty results; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightcask.llm import simhash
from brightcask.llm.common import dropped, only_rows, row_order, staged, text_mark
from brightcask.llm.components import components
from brightcask.llm.simhash import majority, shingle_hashes

WORDS_IN = 5
BITS = 512
WORDS = BITS // 64
PARTS = 4
#: Ids that are broadcast at most.
FEW_IDS = 500_000


def ordered(text: str | None, hot: np.ndarray) -> np.ndarray:
    """The distinct shingles in the common order: by hash, those in hot (sorted) last."""
    got = np.unique(shingle_hashes(text, WORDS_IN)).view(np.int64)
    if not len(hot) or not len(got):
        return got
    late = hot[np.minimum(np.searchsorted(hot, got), len(hot) - 1)] == got
    return np.concatenate([got[~late], got[late]])


def digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.sort(shingles).tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray) -> bytes:
    """For each of BITS classes of shingles, whether their number is odd."""
    count = np.bincount((shingles.view(np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _profile(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ordered(t.as_py(), hot) for t in b.column("text")]
            heads = [s[: len(s) - (4 * len(s) + 4) // 5 + 1] for s in sets]
            cols = [pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), _lists(heads)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), *cols], names=["id", "mark", "node", "n", "fp", "marks", "prefix"])

    return run


def fine_sketch(shingles: np.ndarray) -> bytes:
    """sketch() with two classes or more for each shingle, in a power of two: it tells long sets apart, too, in a thirtieth of their size."""
    bits = max(BITS, 1 << int(2 * len(shingles)).bit_length())
    count = np.bincount((shingles.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many classes two fine sketches differ, the larger being folded to the smaller one's classes: at most the sets' difference."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.int64)
    for b in batches:
        sets = [ordered(t.as_py(), none) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), _lists(sets), pa.array([fine_sketch(s) for s in sets], pa.binary())], names=["node", "tokens", "fine"])


def _finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose fine sketches allow similarity 0.8."""
    for b in batches:
        both = b.column("both").to_numpy()
        most = both - 2 * need(both)
        ok = pa.array([apart(x, y) <= m for x, y, m in zip(b.column("fu").to_pylist(), b.column("fv").to_pylist(), most.tolist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], names=["u", "v"])


def frequent(slim: DataFrame, sample: int = 20_000, above: int = 20, most: int = 200_000) -> np.ndarray:
    """Shingles in more than `above` of about `sample` documents, the most frequent, sorted by hash."""
    every = max(1, slim.count() // sample)
    drawn = slim.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    counts = drawn.mapInArrow(_sets, "node long, tokens array<long>, fine binary").select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") > above)
    return np.sort(np.array([r.token for r in counts.orderBy(F.desc("count"), "token").limit(most).collect()], np.int64))


def need(both: np.ndarray) -> np.ndarray:
    """Shared shingles that similarity 0.8 takes, by the sum of both sizes."""
    return (4 * both + 8) // 9


def near(marks: np.ndarray, other: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks ^ other).sum(1, dtype=np.int64) <= both - 2 * need(both)


def allowed(n: np.ndarray, place: np.ndarray, a: int, others: np.ndarray) -> np.ndarray:
    """Those of others whose size and place allow similarity 0.8 with a, if the bucket's shingle is the first that they share."""
    return others[np.minimum(n[a] - place[a], n[others] - place[others]) >= need(n[a] + n[others])]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.Array]]:
    """The columns of each run of one token with two rows or more."""
    held: list[pa.RecordBatch] = []

    def whole() -> list[pa.Array]:
        return [pa.concat_arrays([h.column(c) for h in held]) for c in names]

    for b in batches:
        if not b.num_rows:
            continue
        token = b.column("token").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(token) != 0) + 1).tolist(), len(token)]
        for a, z in zip(cut, cut[1:], strict=False):
            if held and held[0].column("token")[0].as_py() != int(token[a]):
                if sum(h.num_rows for h in held) > 1:
                    yield whole()
                held = []
            if z == len(token) or held:
                held.append(b.slice(a, z - a))
            elif z - a > 1:
                yield [b.column(c).slice(a, z - a) for c in names]
    if sum(h.num_rows for h in held) > 1:
        yield whole()


def _small(few: int):
    """Sorted (token, n, node, place, comp) in; candidates (node, other) of small buckets between components, members (node, token, n, place) of large ones out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = ["node", "other", "token", "n", "place"], []

        def out() -> pa.RecordBatch:
            node, other, token, n, place = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else [[]] * 5))
            pair = token == 0
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other, mask=~pair), *[pa.array(x, mask=pair) for x in (token, n, place)]], names=names)

        for cols in _runs(batches, ["token", "n", "node", "place", "comp"]):
            token, n, node, place, comp = (c.to_numpy() for c in cols)
            if len(n) > few:
                parts.append((node, np.zeros_like(node), np.where(token == 0, 1, token), n, place))
            else:
                ends = np.searchsorted(n, n * 5 // 4, "right")
                for a in range(len(n) - 1):
                    others = np.arange(a + 1, ends[a])
                    met = allowed(n, place, a, others[comp[others] != comp[a]])
                    if len(met):
                        zero = np.zeros(len(met), np.int64)
                        parts.append((np.full(len(met), node[a]), node[met], zero, zero, zero))
            if len(parts) > 20_000:
                yield out()
                parts.clear()
        yield out()

    return run


def forest(n: np.ndarray, place: np.ndarray, marks: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a search forest of a bucket's candidate pairs."""
    rest, edges = np.arange(len(n)), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            a = front.pop()
            met = allowed(n, place, a, rest)
            met = met[near(marks[met], marks[a], n[met] + n[a])]
            edges += [(a, int(b)) for b in met]
            front += met.tolist()
            rest = rest[~np.isin(rest, met)]
    return edges


def _large(whole: bool):
    """Sorted (token, n, node, place, comp, marks) in; candidates out: a forest of each bucket, or if whole all between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for cols in _runs(batches, ["n", "node", "place", "comp", "marks", "token"]):
            n, node, place, comp = (c.to_numpy() for c in cols[:4])
            marks = _marks(cols[4])
            us, vs = [none], [none]
            if not whole:
                edges = np.array(forest(n, place, marks), np.int64).reshape(-1, 2)
                us, vs = [node[edges[:, 0]]], [node[edges[:, 1]]]
            elif (comp != comp[0]).any():
                ends = np.searchsorted(n, n * 5 // 4, "right")
                for a in range(len(n) - 1):
                    others = np.arange(a + 1, ends[a])
                    met = allowed(n, place, a, others[comp[others] != comp[a]])
                    met = met[near(marks[met], marks[a], n[met] + n[a])]
                    us.append(np.full(len(met), node[a]))
                    vs.append(node[met])
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            ok = near(_marks(b.column("mu")), _marks(b.column("mv")), b.column("nu").to_numpy() + b.column("nv").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], names=["u", "v"])


def verified(found: DataFrame, nodes: DataFrame, rows: DataFrame, slim: DataFrame) -> DataFrame:
    """The candidates (u, v) with similarity 0.8 or more: first by their sketches, then by finer ones, then by the whole sets of those left.

    A pair takes one set to the other, and sets are large: pairs go in PARTS parts, one after another, whose shuffles are gone before the next.
    Documents of candidates are looked up by a broadcast of their ids while these are few, else by a join of both sides.
    """
    left = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("marks").alias("mu"))
    right = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("marks").alias("mv"))
    found = staged(found.distinct().join(left, "u").join(right, "v").mapInArrow(_sketched, "u long, v long"), "candidates")
    met = staged(found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).distinct(), "candidate-nodes")
    ids = staged(rows.join(met, "node", "left_semi").select(F.col("id").alias("other")).distinct(), "candidate-ids")
    texts = slim.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, F.col("id").eqNullSafe(F.col("other")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "node long, tokens array<long>, fine binary").join(met, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("fine").alias("fine"))
    sets = staged(sets, "shingle-sets")
    fine = sets.select("node", "fine", F.size("tokens").cast("long").alias("n"))
    pairs = found.join(fine.select(F.col("node").alias("u"), F.col("fine").alias("fu"), F.col("n").alias("nu")), "u").join(fine.select(F.col("node").alias("v"), F.col("fine").alias("fv"), F.col("n").alias("nv")), "v")
    likely = staged(pairs.select("u", "v", "fu", "fv", (F.col("nu") + F.col("nv")).alias("both")).mapInArrow(_finely, "u long, v long"), "likely")
    parts = []
    for k in range(PARTS):
        mine = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(PARTS)) == k  # noqa: B023, E731
        both = likely.filter(mine("u")).join(sets.filter(mine("node")).select(F.col("node").alias("u"), F.col("tokens").alias("ut")), "u").join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("vt")), "v")
        parts.append(staged(both.filter(9 * F.size(F.array_intersect("ut", "vt")) >= 4 * (F.size("ut") + F.size("vt"))).select("u", "v"), "near"))
    dropped(found, met, ids, sets, likely)
    return functools.reduce(DataFrame.unionByName, parts)


def alike(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v) by fingerprint: each node with the least one of its fingerprint, and the least ones of linked fingerprints; a node has a
    fixed number of them at most, however many are alike."""
    least = staged(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    near = simhash.links(least.select("fp")).distinct()
    named = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"l{c}"))
    pairs = nodes.join(least, "fp").select("node", F.col("least").alias("other")).unionByName(near.join(named("u"), "u").join(named("v"), "v").select(F.col("lu").alias("node"), F.col("lv").alias("other")))
    return staged(pairs.filter("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct(), "alike")


def grouped(docs: DataFrame, id_col: str, text_col: str, few: int) -> tuple[DataFrame, DataFrame]:
    """(rows, of): rows (id, node) of docs, and of (node, first): the row (none, id, mark) that comes first in the node's component."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    marked = slim.select("id", text_mark(F.col("text")).alias("mark"), "text")
    whole = staged(marked.mapInArrow(_profile(frequent(slim)), f"id {kind}, mark long, node long, n long, fp long, marks binary, prefix array<long>"), "shingle-profile")
    rows = staged(whole.select("id", "node"), "shingle-rows")
    full = staged(whole.groupBy("node").agg(F.min(row_order("id", "mark")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "marks", "prefix")]), "full-nodes")
    dropped(whole)
    nodes = staged(full.drop("prefix"), "nodes")
    links = verified(alike(nodes), nodes, rows, slim)
    tied = components(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    at = full.join(tied, "node", "left").select("node", "n", F.coalesce("root", "node").alias("comp"), F.posexplode("prefix").alias("place", "token")).withColumn("place", F.col("place").cast("long"))
    met = at.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(_small(few), "node long, other long, token long, n long, place long")
    met = staged(met, "bucket-pairs")
    dropped(full)
    pairs = met.filter("token is null").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
    links = links.unionByName(verified(pairs, nodes, rows, slim))
    large = met.filter("token is not null").drop("other")
    if large.head(1):
        large = staged(large.join(nodes.select("node", "marks"), "node"), "large-buckets")
        for whole in (False, True):
            tied = components(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
            named = large.join(tied, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
            found = named.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(_large(whole), "u long, v long")
            links = links.unionByName(verified(found, nodes, rows, slim))
    tied = components(links)
    placed = staged(nodes.join(tied.select(F.col("u").alias("node"), "v"), "node", "left").select("node", "first", F.coalesce("v", "node").alias("root")), "placed")
    ids = staged(placed.groupBy("root").agg(F.min("first").alias("first")), "component-firsts")
    return rows, staged(placed.drop("first").join(ids, "root").select("node", "first"), "components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, few: int = 6) -> DataFrame:
    """One row per row of docs: id_col, component_id."""
    rows, of = grouped(docs, id_col, text_col, few)
    return rows.join(of, "node").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, few: int = 6) -> DataFrame:
    """Of each component of docs the row that comes first: by id, null last, then by the text's hash. Rows of other components stay, whatever ids they share."""
    _, of = grouped(docs, id_col, text_col, few)
    return only_rows(docs, of.select("first.id", "first.mark").distinct(), id_col, text_col)

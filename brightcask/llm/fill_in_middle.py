"""Fill-in-the-middle transformation over units, by a sparse scan of events.

Units are runs of ASCII letters and every other code point. One Aho-Corasick automaton reads the text and reports the places where the
class changes (a letter beside another ASCII character) and the sentinels. Code points beyond ASCII are no letters; they are read as a
question mark each, which leaves all places as they are. Between two events all characters are of one class: letters are one unit, others
are as many as there are places. So the unit of a place, and the place of a unit, follow from the events alone, by a binary search and a
subtraction.

A document's cuts and form are drawn by the SHA-256 of a seed and its id. Texts that are empty or hold a sentinel stay plain, for the
parts could not be told apart again. restored() rebuilds the text from form and output alone, in SQL functions.

Null text counts as empty. A null id is drawn as the id of no digits. Repeated rows give repeated rows, equal ids equal draws. Very long texts are
read whole, one at a time. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL, START, END = 0, 1, 2

_automata: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """START at the first letter of a run, END at the first character behind one, SENTINEL at a sentinel's last; made once for each worker."""
    if not _automata:
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        others = [chr(c) for c in range(128) if chr(c) not in string.ascii_letters]
        for letter in string.ascii_letters:
            for other in others:
                a.add_word(other + letter, START)
                a.add_word(letter + other, END)
        for s in (PREFIX, SUFFIX, MIDDLE):
            a.add_word(s, SENTINEL)
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


class Units:
    """The units of a text, from its events."""

    def __init__(self, text: str) -> None:
        flat = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        at = np.fromiter((place << 2 | kind for place, kind in automaton().iter(f" {flat} ")), np.int64)  # the spaces open and close runs at the ends
        kind, place = at & 3, (at >> 2) - 1
        self.marked = bool((kind == SENTINEL).any())
        start, self.end = place[kind == START], place[kind == END]
        saved = np.cumsum(self.end - start - 1)  # places that are no units, up to the end of each run
        self.first = self.end - saved - 1  # units before each run
        self.n = len(text) - int(saved[-1]) if len(saved) else len(text)

    def place(self, units: int) -> int:
        """Code points of so many first units."""
        run = int(np.searchsorted(self.first, units)) - 1
        return units if run < 0 else int(self.end[run]) + units - int(self.first[run]) - 1


def transformed(key: str, text: str, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle in code points, output) of one text."""
    units = Units(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    draw = [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]
    if not text or units.marked or draw[2] % 100 >= plain_from:
        return units.n, "plain", None, None, text
    a, z = (units.place(u) for u in sorted(d % (units.n + 1) for d in draw[:2]))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if draw[3] % 100 < spm_below:
        return units.n, "spm", a, z - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, z - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(seed: int, plain_from: int, spm_below: int):
    kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [transformed(k.as_py(), t.as_py() or "", seed, plain_from, spm_below) for k, t in zip(b.column("key"), b.column("text"), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)]], names=["id", *[n for n, _ in kinds]])

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """One row per row of docs: id_col, n (units), form, prefix_chars, middle_chars, output. Nothing is shuffled.

    Of the draws from 0 to 99, those from plain_from on stay plain; of the others' second draws, those below spm_below put the suffix first.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return slim.mapInArrow(_transform(seed, plain_from, spm_below), schema).withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that a form and an output were made of."""
    part = F.split(output, "<[PSM]>", -1)
    join = lambda *order: F.concat(*[part[i] for i in order])
    return F.when(form == "plain", output).when(form == "psm", join(1, 3, 2)).otherwise(join(2, 3, 1))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """transform() with SHA-256 of the output and of the text rebuilt from it, in place of the output."""
    made = transform(docs, id_col, text_col, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))

"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, digits as 0, white space runs as one space) and hashed. For each host, the distinct documents
(by whole text, so that copies of a document count once) with a line are counted; a line in more of them than the host's limit is
boilerplate. The limit is a share of the host's distinct documents, but min_docs at least and most_docs at most, so that a host with
a third of all documents is judged like a small one. A document that loses more than max_lost of its words to such lines is depleted
and rejected, as is one that fails the base rules.

Per document, only hashes and word counts of its distinct lines travel. Counting goes through partial aggregates, so a line in a
third of all documents reaches its counter as one row per task and text. The boilerplate table is joined, not collected.

Null text has no words and fails the base rules. A null host is a host of its own. Null ids are judged like others, and rows that
repeat each. Very long texts are read whole, one at a time. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightcask.llm.common import staged, whole_row

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
DIGITS = bytes.maketrans(b"123456789", b"000000000")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_key(line: str) -> int:
    """Signed 64-bit hash of the normalised line."""
    return xxhash.xxh3_64_intdigest(b" ".join(line.lower().encode().split()).translate(DIGITS)) - (1 << 63)


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    held = np.zeros(n, bool)
    for k in range(3):
        held[k : n - 2 + k] |= again
    return int(held.sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """BASE for one text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def line_words(text: str) -> dict[int, int]:
    """Words by line, for the lines that have any."""
    out: dict[int, int] = {}
    for line in text.split("\n"):
        if n := len(line.encode().split()):
            key = line_key(line)
            out[key] = out.get(key, 0) + n
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, keys, counts, digests = [], [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base.append(measures(text))
            lines = line_words(text)
            keys.append(list(lines))
            counts.append(list(lines.values()))
            digests.append(xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63))
        cols = np.array(base, np.int64).reshape(-1, len(BASE)).T
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), pa.array(digests, pa.int64()), *map(pa.array, cols), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["id", "host", "digest", *BASE, "lines", "line_words"])


def profile(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A staged row per row of docs: id, host, digest of the text, BASE, its distinct lines and their words, tag (a row number)."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    rows = slim.mapInArrow(_profile, f"id {kind}, host string, digest long, {', '.join(f'{c} long' for c in BASE)}, lines array<long>, line_words array<int>")
    return staged(rows.withColumn("tag", F.monotonically_increasing_id()), "line-profile")


def boilerplate(profiles: DataFrame, min_docs: int = 10, share: float = 0.05, most_docs: int = 100) -> DataFrame:
    """(host, line, n_docs) of the lines above the host's limit."""
    hosts = profiles.groupBy("host").agg(F.count_distinct("digest").alias("host_docs"))
    counts = profiles.select("host", "digest", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count_distinct("digest").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    return counts.join(hosts, "host").filter(F.col("n_docs") > F.least(F.lit(share) * F.col("host_docs"), F.lit(most_docs))).drop("host_docs")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, min_docs: int = 10, share: float = 0.05, most_docs: int = 100, max_lost: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, BASE, base_failed, n_lost_words, kept."""
    profiles = profile(docs, id_col, text_col, host_col)
    common = staged(boilerplate(profiles, min_docs, share, most_docs).select("host", "line"), "boilerplate")
    lines = profiles.select("tag", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("at")).select("tag", "host", F.col("at.lines").alias("line"), F.col("at.line_words").alias("words"))
    lost = lines.join(common, ["host", "line"], "left_semi").groupBy("tag").agg(F.sum("words").alias("n_lost_words"))
    out = profiles.drop("lines", "line_words").join(lost, "tag", "left").withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("n_lost_words") <= F.lit(max_lost) * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", "n_lost_words", kept.alias("kept"))


def without_boilerplate(docs: DataFrame, common: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs with the lines in common (host, line) taken out of their texts; all columns and rows stay.

    Only the few lines of a document that are common come back to it, by its row number.
    """
    rows = staged(whole_row(docs, tag=F.monotonically_increasing_id(), text=docs[text_col], host=F.coalesce(F.concat(F.lit("="), docs[host_col].cast("string")), F.lit(""))), "documents")
    keys = F.pandas_udf(lambda s: s.map(lambda t: list(line_words(t or ""))), "array<long>")
    met = rows.select("tag", "host", F.explode(keys("text")).alias("line")).join(common, ["host", "line"], "left_semi")
    cut = F.pandas_udf(lambda s, k: s.combine(k, lambda t, drop: t if drop is None or t is None else "\n".join(x for x in t.split("\n") if line_key(x) not in set(drop))), "string")
    out = rows.join(met.groupBy("tag").agg(F.collect_set("line").alias("drop")), "tag", "left")
    return out.select(*[cut("text", "drop").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

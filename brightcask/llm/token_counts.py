"""Token counts of a BPE vocabulary by merging alone: no identifiers are made.

A text's symbols are its characters, a character outside the vocabulary being as many symbols as it has bytes. Adjacent symbols whose
joined text is a piece wait in a heap, best score first and then from the left; popping one joins its two symbols in a linked list and
puts the pairs with its new neighbours in. The number of tokens is the number of symbols less the number of merges.

No merge crosses a place where a space follows another character if no piece holds such a place, nor one beside a line's end if no
piece holds one; texts then fall apart into short stretches, and a worker remembers the counts of those that it has met, so many of them
at most. A stretch of a megabyte is merged as a whole, in the time of a sort.

Null and empty texts have no bytes and no tokens. Null ids and repeated rows are rows like others. Very long texts are read whole, never
truncated. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the model writes a space.
SPACE = "▁"
LIMIT = 4096
#: Stretches that a worker remembers, and how long they are at most.
REMEMBERED, SHORT = 500_000, 40


class Vocabulary:
    """Ranks of the pieces of a sentencepiece BPE model, spaces written as spaces."""

    def __init__(self, model_path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if model.normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}" or not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("only models that leave texts as they are, put a space before them and fall back to bytes are counted here")
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        #: A better score is a smaller rank; single characters are there, too, but are never joined from anything.
        self.rank = {model.id_to_piece(i).replace(SPACE, " "): -model.get_score(i) for i in plain}
        joined = [p for p in self.rank if len(p) > 1]
        if lost := {c for p in joined for c in p} - self.rank.keys():
            raise ValueError(f"characters that only occur in longer pieces: {sorted(lost)}")
        ends = "" if any("\n" in p for p in joined) else "\n"
        self.stretch = re.compile(rf" *[^ {ends}]+| +" + "|\n" * bool(ends) if not any(re.search("[^ ] ", p) for p in joined) else "(?s:.+)")
        self.known: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of one stretch, by its heap and linked list."""
        rank, n = self.rank, len(text)
        symbols = n if text.isascii() and all(c in rank for c in text) else sum(1 if c in rank else len(c.encode()) for c in text)
        if n < 2:
            return symbols
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, to = heappop(heap)
            right = after[left]
            if right < 0 or end[left] == 0 or end[right] != to:  # one of the two has been joined to another since
                continue
            symbols -= 1
            end[left], end[right] = to, 0
            after[left] = far = after[right]
            if far >= 0:
                before[far] = left
                if (r := rank.get(text[left : end[far]])) is not None:
                    heappush(heap, (r, left, end[far]))
            if (near := before[left]) >= 0 and (r := rank.get(text[near:to])) is not None:
                heappush(heap, (r, near, to))
        return symbols

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for s in self.stretch.findall(" " + text.replace(SPACE, " ")):
            if (n := known.get(s)) is None:
                n = self.merged(s)
                if len(s) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[s] = n
            total += n
        return total


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model_path: str) -> Vocabulary:
    """Read once for each Python worker."""
    if model_path not in _vocabularies:
        _vocabularies[model_path] = Vocabulary(model_path)
    return _vocabularies[model_path]


def _counts(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabulary(model_path).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array([count(t.as_py() or "") for t in b.column("text")], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = LIMIT, model_path: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens above limit). Nothing is shuffled."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = slim.mapInArrow(_counts(model_path or public_tokenizers.path("piece_bpe_32k.model")), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

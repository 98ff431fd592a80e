"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels the words of each line (the sequence) with their kind, by weights for the word's shape, length, digits and edges
and for those of the words beside it, and for pairs of labels. It is trained in numpy by gradient ascent of the exact log-likelihood on
a small labelled table, made here from a seed: filler of the kinds that documents hold, with personal data put in. Decoding is
Viterbi over many lines at once, padded to one length. A line whose words are all plain, by a margin that no sequence of
labels could make up for, is known to decode to "nothing" and skips it.

Pattern spans stay as they are; the field's spans are added where they overlap none. Offsets are code points of the whole text.

Null text counts as empty and has no spans. Ids may be null or repeat; every row gets its own result. Very long texts are decoded line by
line, very long lines as one sequence. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN_KINDS = ("email", "ip", "card", "phone")
KINDS = (*PATTERN_KINDS, "secret")
#: A run from which no match starts is passed over as a whole: no later start in it could match either. Group 1 tells matches from runs.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]+\.[0-9]+\.[0-9]+)?")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Labels of the field: nothing, and the first and further words of each kind.
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a number, however long, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def pattern_spans(text: str) -> dict[str, list[Span]]:
    """Spans by kind. A match that fails its check is dropped and not tried again."""
    out: dict[str, list[Span]] = {k: [] for k in PATTERN_KINDS}
    if "@" in text:
        out["email"] = [("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    out["ip"] = [("ip", *m.span()) for m in IP.finditer(text) if m[1] and all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(("card", *m.span()))
    if "+" in text:
        out["phone"] = [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# ---- features


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs once; other characters as they are."""
    kinds = ["0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word]
    return "".join(c for i, c in enumerate(kinds) if i == 0 or c != kinds[i - 1])


def observed(word: str) -> tuple[str, ...]:
    """The features of a word. Words with equal features are alike to the field."""
    s, digits, n = shape(word), sum(c.isdigit() for c in word), len(word)
    core = word.strip("\"'.,;:!?()")
    mixed = digits > 1 and core.isalnum() and not core.isdigit() and core.isascii()
    return (
        f"shape={s if len(s) <= 6 else 'long'}", f"length={min(n // 4, 8)}", f"digits={min(digits, 5) if digits < 6 else 6 + min((digits - 6) // 4, 4)}",
        f"first={s[:1]}", f"last={s[-1:]}", f"marks={''.join(sorted(set(s) & set('@+=().-:')))}",
        f"mixed={mixed and ('upper' if core.isupper() else 'lower')}", f"dots={min(word.count('.'), 4)}", f"key={word.lower().strip(':=') in KEY_WORDS}", f"pair={'=' in word[1:-1] and word.lower().split('=')[0] in KEY_WORDS}",
    )


# Names before a secret.
KEY_WORDS = {"password", "passwd", "pwd", "secret", "token", "key", "api_key", "apikey", "access_key", "auth"}


# ---- the labelled table


def labelled_table(rows: int = 800, seed: int = 17) -> list[list[tuple[str, str]]]:
    """Lines of (word, label). Filler looks like the prose, junk, tables and numbers of documents; personal data is put between."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = ["the", "an", "er", "ti", "on", "ou", "ing", "é", "ße", "ción", "la", "wh", "re", "ä", "st", "nd"]
    plain = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 6))))
    hexed = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    ascii_ = lambda: plain().encode("ascii", "ignore").decode() or "a"
    host = lambda: pick(["", "", f"{ascii_()}.", f"{ascii_()}-"]) + ascii_() + digits(int(rng.integers(0, 2))) + pick([".com", ".example.com", ".org", ".net", ".co.uk", ".de", ".example.net"])

    def filler() -> str:
        w = plain()
        form = rng.random()
        if form < 0.60:
            return w
        if form < 0.74:
            return w + pick([".", ",", ";", "!", "?", ":"])
        if form < 0.82:
            return w.capitalize()
        if form < 0.87:
            return w + pick(["***", "###", "$$$", "%%%", "&&&", ",***", ".###", ",$$$", ".%%%"])
        if form < 0.90:
            return w.upper() + pick(["!!", "", ".!!", ",!!", "!"])
        if form < 0.92:
            return pick(["|", "-", "=", "&", "/", "+", "*"])
        if form < 0.95:
            return pick([digits(1), digits(2), digits(4), f"{digits(1)}.", f"{digits(1)}.{digits(1)}.", f"{digits(1)}.{digits(1)}", f"({digits(1)})", f"{digits(2)}%", f"{digits(2)},", f"{digits(2)}-{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}"])
        return pick([f"({w})", f'"{w}"', f"{w}'s", f"{w}-{plain()}", f"{w.upper()}-{plain().upper()}", f"<{w}>", f"www.{plain()}.com", f"http://{plain()}.org/{plain()}", f"www.{host()}/{ascii_()}?{ascii_()}={digits(3)}&{ascii_()}={ascii_()}", f"https://{host()}/{ascii_()}-{digits(2)}.html", f"{w}{digits(1)}"])

    def personal() -> list[tuple[str, str]]:
        kind = pick(KINDS)
        end = pick(["", "", "", ".", ","])
        if kind == "email":
            words = [pick([f"{plain()}.{digits(2)}", plain(), f"{plain()}_{plain()}", f"{plain()}+{digits(1)}"]).encode("ascii", "ignore").decode() + "x@" + host() + end]
        elif kind == "ip":
            words = [".".join(str(int(x)) for x in rng.integers(0, 256, 4)) + end]
        elif kind == "card":
            words = pick([[digits(16)], [digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))], [digits(19)]])
            words = [*words[:-1], words[-1] + end]
        elif kind == "phone":
            words = pick([[f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(4), digits(3)], [f"+{digits(2)}", digits(2), digits(4), digits(4)], [f"+{digits(2)}", digits(1), digits(2), digits(2), digits(2), digits(2)], [f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]])
            words = [*words[:-1], words[-1] + end]
        else:
            form, key = pick(["pair", "quoted", "bare", "id"]), pick(sorted(KEY_WORDS))
            value = hexed(int(rng.integers(14, 42)))
            if form == "pair":
                words = [f"{key}={value}"]
            elif form == "id":
                words = ["AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))]
            else:
                return [(key, "O"), (pick(["=", ":"]), "O"), (f'"{value}"' if form == "quoted" else value, "B-secret")]
        return [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(words)]

    table = []
    for _ in range(rows):
        line: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(1, 12))):
            line += personal() if rng.random() < 0.2 else [(filler(), "O")]
        table.append(line)
    return table


# ---- the field


@dataclass
class Field:
    feature: dict[str, int]
    weights: np.ndarray  # side (word before, word, word after) x feature x label
    pairs: np.ndarray  # label x label
    plain: tuple[float, float, float] = (np.inf, 0.0, 0.0)
    seen: dict[bytes, int] = field(default_factory=dict)
    kinds: dict[tuple, int] = field(default_factory=dict)
    score: list[np.ndarray] = field(default_factory=list)  # by kind of word: side x label

    def kind(self, word: bytes) -> int:
        """The number of the word's kind; even numbers are plain. 0 stands for the end of a line."""
        if (k := self.seen.get(word)) is None:
            k = self.observe(observed(word.decode()))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = k
        return k

    def observe(self, features: tuple[str, ...]) -> int:
        if (k := self.kinds.get(features)) is None:
            s = self.weights[:, [self.feature[f] for f in features if f in self.feature]].sum(1)
            margin = (s[:, :1] - s[:, 1:]).min(1)
            k = len(self.score) + (len(self.score) + (0 if self.is_plain(margin) else 1)) % 2
            while len(self.score) <= k:
                self.score.append(s)
            self.kinds[features] = k
        return k

    def is_plain(self, margin: np.ndarray) -> bool:
        """Whether the word beats every label but O by so much that no labels of its neighbours make up for it."""
        own, before, after = self.plain
        return margin[1] > own and margin[0] >= before and margin[2] >= after

    def find_plain(self, beside: float = 0.5) -> None:
        """Limits that make a word plain. Labels other than O gain at most the swing in their pairs, and 2 * beside from the words beside."""
        swing = 2 * float(self.pairs.max() - self.pairs[0, 0])
        self.plain = (swing + 2 * beside, -beside, -beside)


def _pad(lines: list[list[int]], size: int) -> np.ndarray:
    out = np.zeros((len(lines), size), np.int64)
    for i, x in enumerate(lines):
        out[i, : len(x)] = x
    return out


@functools.cache
def default_model() -> Field:
    """The field as trained on the labelled table, once for a process."""
    return train(labelled_table())


def train(table: list[list[tuple[str, str]]], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Gradient ascent (Adam) of the log-likelihood; expectations by the forward-backward recursions over all lines at once."""
    k, label = len(LABELS), {x: i for i, x in enumerate(LABELS)}
    names = sorted({f for line in table for w, _ in line for f in observed(w)})
    feature = {f: i for i, f in enumerate(names)}
    size, n, nf = max(map(len, table)), len(table), len(names)
    width = len(observed("a"))
    at = np.full((n, size, width), nf)
    gold, mask = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    for i, line in enumerate(table):
        for t, (w, y) in enumerate(line):
            at[i, t], gold[i, t], mask[i, t] = [feature[f] for f in observed(w)], label[y], True
    side = np.full((3, n, size, width), nf)
    side[0, :, 1:], side[1], side[2, :, :-1] = at[:, :-1], at, at[:, 1:]
    side = side[:, mask]  # from here on only the words, without the padding: side x word x feature
    theta = np.zeros(3 * (nf + 1) * k + k * k)
    m, v, one = np.zeros_like(theta), np.zeros_like(theta), np.eye(k)
    for step in range(1, steps + 1):
        w, a = theta[: -k * k].reshape(3, nf + 1, k), theta[-k * k :].reshape(k, k)
        e = np.zeros((n, size, k))
        e[mask] = sum(w[s][side[s]].sum(1) for s in range(3))
        ea, top = np.exp(a), e.max(2, keepdims=True)
        ee = np.exp(e - top)
        alpha, beta, scale = np.zeros((size, n, k)), np.ones((size, n, k)), np.ones((size, n))
        for t in range(size):
            x = ee[:, t] * (alpha[t - 1] @ ea if t else 1.0)
            alpha[t] = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), alpha[t - 1] if t else x)
        for t in range(size - 2, -1, -1):
            x = (beta[t + 1] * ee[:, t + 1]) @ ea.T
            beta[t] = np.where(mask[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
        post = np.moveaxis(alpha * beta, 0, 1)
        post /= post.sum(2, keepdims=True)
        diff = np.broadcast_to((one[gold] - post)[mask][:, None, :], (*side.shape[1:], k))
        g = np.stack([np.bincount((side[s][..., None] * k + np.arange(k)).ravel(), diff.ravel(), (nf + 1) * k).reshape(nf + 1, k) for s in range(3)])
        g[:, nf] = 0
        ga = np.zeros((k, k))
        for t in range(1, size):
            live = mask[:, t]
            joint = alpha[t - 1][live][:, :, None] * ea * (ee[:, t] * beta[t])[live][:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            ga += np.einsum("ni,nj->ij", one[gold[live, t - 1]], one[gold[live, t]]) - joint.sum(0)
        grad = np.concatenate([g.ravel(), ga.ravel()]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, a = theta[: -k * k].reshape(3, nf + 1, k), theta[-k * k :].reshape(k, k)
    out = Field(feature, w[:, :nf].copy(), a.copy())
    out.find_plain()
    return out


def fresh(model: Field) -> Field:
    """A copy with its own memory of words, whose kind 0 is the end of a line."""
    return Field(model.feature, model.weights, model.pairs, model.plain, {}, {}, [np.zeros((3, len(LABELS)))])


def viterbi(model: Field, lines: list[list[int]], cells: int = 1 << 18) -> list[np.ndarray]:
    """The best labels of each line of kinds; lines of similar length are decoded together, at most about cells words at once."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    score = np.stack(model.score)
    while order:
        size = len(lines[order[-1]])
        take = order[-max(1, cells // max(size, 1)) :]
        del order[-len(take) :]
        kinds = _pad([lines[i] for i in take], size)
        e = score[kinds, 1]
        e[:, 1:] += score[kinds[:, :-1], 0]
        e[:, :-1] += score[kinds[:, 1:], 2]
        lengths = np.array([len(lines[i]) for i in take])
        best, back = e[:, 0], np.zeros((size, len(take), len(LABELS)), np.int8)
        for t in range(1, size):
            through = best[:, :, None] + model.pairs
            back[t] = through.argmax(1)
            best = np.where((t < lengths)[:, None], through.max(1) + e[:, t], best)
        at = best.argmax(1)
        path = np.zeros((len(take), size), np.int64)
        for t in range(size - 1, -1, -1):
            live = t < lengths
            path[live, t] = at[live]
            at = np.where(live & (t > 0), back[t, np.arange(len(take)), at], at)
        for j, i in enumerate(take):
            out[i] = path[j, : lengths[j]]
    return out


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def field_spans(model: Field, texts: list[str]) -> list[list[Span]]:
    """Spans that the field finds in each text."""
    todo: list[tuple[int, int, list[int]]] = []
    for i, text in enumerate(texts):
        at = 0
        for n, line in enumerate(text.encode().split(b"\n")):
            kinds = [model.kind(w) for w in line.split()]
            if any(k % 2 for k in kinds):
                todo.append((i, n, kinds))
    out: list[list[Span]] = [[] for _ in texts]
    lines_of: dict[int, list[tuple[int, str]]] = {}
    for (i, n, _), path in zip(todo, viterbi(model, [x for *_, x in todo]), strict=True):
        if not path.any():
            continue
        if i not in lines_of:
            at, lines_of[i] = 0, []
            for line in texts[i].split("\n"):
                lines_of[i].append((at, line))
                at += len(line) + 1
        start, line = lines_of[i][n]
        words = list(WORDS.finditer(line))
        t = 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            kind, z = (path[t] - 1) // 2, t + 1
            while z < len(path) and path[z] == 2 * kind + 2:
                z += 1
            a, b = _trim(line, words[t].start(), words[z - 1].end(), KINDS[kind])
            if a < b and _passes(line[a:b], KINDS[kind]):
                out[i].append((KINDS[kind], start + a, start + b))
            t = z
    return out


def _trim(line: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The span without quotes and punctuation at its edges, and without the name before a secret."""
    if kind == "secret" and "=" in line[a:b]:
        a += line[a:b].index("=") + 1
    while a < b and line[a] in "\"'.,;:!?<[{":
        a += 1
    while a < b and not (line[b - 1].isalnum() or line[b - 1] in "_-)"):
        b -= 1
    return a, b


def _passes(found: str, kind: str) -> bool:
    """The checks that the patterns' kinds have hold for the field's spans too: a number that fails them is some other number."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return all(p.isdecimal() and octet(p) for p in found.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def _add(base: list[Span], found: list[Span]) -> list[Span]:
    """All spans, by kind as listed and then start; found ones only where they overlap no other."""
    starts: list[int] = []  # of what is taken, in order and apart
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = list(base)
    for kind, a, b in found:
        at = bisect_right(ends, a)
        if at == len(starts) or starts[at] >= b:
            out.append((kind, a, b))
            starts.insert(at, a)
            ends.insert(at, b)
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all spans, the field's too)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())  # a few thousand weights
    names = ["id", *(f"n_{k}" for k in PATTERN_KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fresh(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                counts, digests, spans, totals = [], [], [], []
                for text, found in zip(texts, field_spans(model, texts), strict=True):
                    by_kind = pattern_spans(text)
                    base = [s for k in PATTERN_KINDS for s in by_kind[k]]
                    counts.append([len(by_kind[k]) for k in PATTERN_KINDS])
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                    both = _add(base, found)
                    spans.append(written(both))
                    totals.append(len(both))
                cols = np.array(counts, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, cols), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(totals, pa.int64())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {', '.join(f'n_{k} long' for k in PATTERN_KINDS)}, base_sha256 string, spans string, n_spans long")
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; all columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def clean(texts):
        model = fresh(shared.value)
        plain = [t or "" for t in texts]
        out = []
        for original, text, found in zip(texts, plain, field_spans(model, plain), strict=True):
            spans = _add([s for v in pattern_spans(text).values() for s in v], found)
            for kind, a, b in sorted(spans, key=lambda s: -s[1]):
                text = f"{text[:a]}[{kind}]{text[b:]}"
            out.append(None if original is None else text)
        return texts.__class__(out, dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))

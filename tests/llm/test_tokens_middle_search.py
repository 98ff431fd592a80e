"""Token counts, fill-in-the-middle and lexical search against the library, an exact round trip and plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from brightcask.llm import fill_in_middle, lexical_search, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, tag string, n string, term string, item string, output string"
ALPHABET = "abthe ing  \n▁\t.é你😀\x00<PSM>AZ1?"
R = random.Random(5)
SAID = ["".join(R.choice(ALPHABET) for _ in range(R.randint(1, 40))) for _ in range(300)]
TEXTS = [
    None, "", " ", "  a  b ", "Wherever you go, THERE you are.", "Wherever you go, THERE you are.", "<s>a</s><unk><0x41>\r\n", "already <S> marked", "é" * 3000, "y" * 20_000, "x \n" * 4000, "ends in a word", ". , !", "thethethe" * 900, *SAID,
]
ROWS = [*enumerate(TEXTS), (4, TEXTS[4]), (None, TEXTS[4]), (None, None), (-7, "negative id"), (4, "another text")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", "x", "x", "x", "x") for i, t in ROWS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def same(got, wanted):
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def test_token_counts(docs, none, model):
    got = token_counts.token_counts(docs, limit=50).collect()
    n = {t: len(model.encode(t or "")) for _, t in ROWS}
    same([tuple(r) for r in got], [(i, len((t or "").encode()), n[t], n[t] > 50) for i, t in ROWS])
    assert token_counts.token_counts(none).collect() == []


def test_token_counts_of_a_stretch_of_a_hundred_thousand_letters(model):
    text = "".join(R.choice("abcdefghijklmnop") for _ in range(100_000))
    assert token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).count(text) == len(model.encode(text))


def test_token_counts_remember_only_so_many_stretches(model, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    words = token_counts.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert [words.count(t or "") for t in TEXTS] == [len(model.encode(t or "")) for t in TEXTS] and len(words.known) <= 3


def test_token_counts_of_the_documents(spark, model):
    from brightcask.llm.queries import op11_token_counts

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    same([tuple(r) for r in op11_token_counts(spark, SF).collect()], [(i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts.items()])


def by_units(key, text):
    """The transformation by listing all units."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, z = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:z], units[z:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(docs, none):
    got = fill_in_middle.transform(docs).collect()
    wanted = [(i, *by_units("" if i is None else i, t or "")) for i, t in ROWS]
    same([tuple(r) for r in got], wanted)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    same([tuple(r) for r in fill_in_middle.digests(docs).collect()], [(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(wanted, ROWS, strict=True)])
    assert fill_in_middle.transform(none).collect() == []


def test_units_and_their_places_follow_from_events():
    for text in SAID:
        units, found = re.findall("[A-Za-z]+|[^A-Za-z]", text), fill_in_middle.Units(text)
        assert (found.n, found.marked) == (len(units), bool(re.search("<[PSM]>", text)))
        assert [found.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_fill_in_middle_of_other_ids(spark):
    df = spark.createDataFrame([("a-1", "some words here"), (None, "and there")], "key string, body string")
    got = fill_in_middle.transform(df, "key", "body").collect()
    same([tuple(r) for r in got], [("a-1", *by_units("a-1", "some words here")), (None, *by_units("", "and there"))])


def terms_of(text):
    return re.findall(lexical_search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(rows, items, top=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(i, Counter(t)) for i, t in ((i, terms_of(t)) for i, t in rows) if t]
    docs, words, out = len(held), sum(c.total() for _, c in held), []
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        scored = []
        for place, (i, c) in enumerate(held):
            m = 75 + 25 * c.total() * docs // words
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score:
                scored.append((-score, i is None, i or 0, place, i))
        out += [(item, k + 1, s[4], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return out


ITEMS = [(1, "Wherever YOU go"), (2, "a b a b the"), (2, "a b a b the"), (3, None), (4, "... !"), (None, "é你 marked Text"), (5, "nowheretobefound"), (6, " ".join(x for x in SAID if x.isascii()))]


@pytest.mark.parametrize("options", [{}, {"slice_docs": 3, "block_terms": 4}, {"top": 3}])
def test_lexical_search(spark, docs, options):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, term string")
    got = lexical_search.rank(docs, items, **options).collect()
    same([tuple(r) for r in got], ranked(ROWS, ITEMS, options.get("top", 20)))


def test_lexical_search_without_documents_or_items(spark, docs, none):
    items = spark.createDataFrame([(1, "the words")], "item_id long, text string")
    assert lexical_search.rank(none, items).collect() == []
    found = lexical_search.rank(docs, items.filter("false"))
    assert found.collect() == [] and [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]


def test_terms_are_those_of_the_pattern():
    for text in SAID:
        assert [w.decode() for w in text.encode().translate(lexical_search.FOLD).split()] == terms_of(text)


def test_a_term_of_every_document_weighs_nothing(spark):
    rows = [(i, "all " + "some " * (i % 2) + f"own{i}") for i in range(600)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), [(1, "all"), (2, "all some own7")]
    got = lexical_search.rank(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    same([tuple(r) for r in got], ranked(rows, items))
    assert {r.item_id for r in got} == {2}

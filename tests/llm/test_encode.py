import random

import pytest

from tidemill.llm import encode
from tidemill.llm.encode import Encoder, default_path, token_ids

tokenizers = pytest.importorskip("tokenizers")
ODD = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "​", "\x1c", "\x85", "　", "a", "Z", "é", "é", "ß", "9", "²", "३", "ப", "ி", "😀", "👩‍🌾", "'s", "'LL", "’s", "<|endoftext|>", "_", "..", "the", " Hello", "\x00", "aaaaaaa", "ﬁ"]


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_as_the_public_tokenizer(spark, sf, public):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.ids for r in token_ids(docs).collect()}
    assert got == {r.doc_id: public(r.text) if r.text else [] for r in docs.collect()}


def test_odd_texts(public):
    r, e = random.Random(1), Encoder(open(default_path(), "rb").read())
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    offsets, ids = e.encode(texts)
    assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])] == [public(t) for t in texts]


def test_rows(spark, public, monkeypatch):
    rows = [(1, None, "x", [1]), (2, "", "x", None), (None, "tea", None, None), (3, "tea", "x", None), (3, "tea", "x", None), (4, "word " * 50_000, "x", None), (5, "ab" * 20_000, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in token_ids(df).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert got == [(1, []), (2, []), (3, public("tea")), (3, public("tea")), (4, public("word " * 50_000)), (5, public("ab" * 20_000)), (None, public("tea"))]
    assert token_ids(df.limit(0)).count() == 0 and token_ids(df).columns == ["doc_id", "ids"]


def test_long_texts_and_full_cache(public, monkeypatch):
    monkeypatch.setattr(encode, "LONG_TEXT", 20)
    monkeypatch.setattr(encode, "CACHED_WORDS", 2)
    e = Encoder(open(default_path(), "rb").read())
    for text in ("one two three four five six seven", "one", "eight nine one two three ten eleven"):
        offsets, ids = e.encode([text, None])
        assert list(ids) == public(text) and list(offsets) == [0, len(ids), len(ids)]

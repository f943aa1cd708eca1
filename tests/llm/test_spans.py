import random
from collections import defaultdict

import pytest

from tidemill.llm import spans
from tidemill.llm.spans import MIN_LENGTH, shared_characters, sharing_classes, sharing_pairs

R = random.Random(11)


def text(n):
    return "".join(R.choice("abcdefgh ऑé😀\n") for _ in range(n))


def brute(docs):
    held = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - MIN_LENGTH + 1):
            held[t[k : k + MIN_LENGTH]].add(i)
    pairs = {(a, b) for v in held.values() for a in v for b in v if a < b}
    covered = {}
    for i, t in docs:
        mark = bytearray(len(t or ""))
        for k in range(len(mark) - MIN_LENGTH + 1):
            if len(held[t[k : k + MIN_LENGTH]]) > 1:
                mark[k : k + MIN_LENGTH] = b"\1" * MIN_LENGTH
        if any(mark):
            covered[i] = sum(mark)
    return pairs, covered


@pytest.fixture(scope="module")
def docs():
    out = [(1, None), (2, ""), (3, "short"), (4, text(MIN_LENGTH - 1))]
    passage = text(900)
    for i in range(10, 40):  # stretches of lengths around the limit, anywhere in their documents
        n = R.choice([250, 298, 299, 300, 301, 302, 350, 700])
        at = R.randrange(0, len(passage) - n + 1)
        out.append((i, text(R.randrange(0, 200)) + passage[at : at + n] + text(R.randrange(0, 200))))
    twin = text(300)
    out += [(50, twin), (51, twin), (52, twin[:-1] + "!"), (53, twin + twin)]
    footer = text(298)  # under the limit: shared by many, no span by itself
    out += [(100 + i, text(40 + i) + footer + text(30)) for i in range(30)]
    out += [(200, "x" * 350 + "q"), (201, "y" + "x" * 330), (202, "x" * 299), (203, "ab" * 200), (204, "ba" * 160 + "c")]
    return out


def test_against_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id bigint, text string, pos int, key string").repartition(3)
    pairs, covered = brute(docs)
    assert len(pairs) > 30
    got = [tuple(r) for r in sharing_pairs(df).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert {r.doc_id: r.shared_chars for r in shared_characters(df).collect()} == covered
    links = defaultdict(int)
    for p in pairs:
        for i in p:
            links[i] += 1
    assert {r.doc_id: r.links for r in sharing_classes(df).collect()} == links


def test_hot_standing_texts(spark):
    """A footer of over 300 characters and one of 250 in all documents: one class of links, no links; both in one block."""
    long, short = text(320), text(250)
    docs = [(i, text(20) + chr(97 + i % 20) + long) for i in range(3000)] + [(10_000 + i, chr(97 + i % 20) + text(20) + short + text(5)) for i in range(3000)]
    docs += [(20_000 + i, "q" * 60 + short + text(10)) for i in range(3)]  # leave the block together and go on for 310 characters
    got = {r.doc_id: (r.class_id, r.class_size, r.links) for r in sharing_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: (0, 3000, 2999) for i in range(3000)} | {20_000 + i: (20_000, 3, 2) for i in range(3)}


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 1000)
    common = text(450)
    docs = [(1, text(2345) + common + text(3000)), (2, common + text(800)), (3, text(980) + common[:300]), (4, text(5000))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    # Workers see the module as it is on disk, so the pieces are checked on the driver and the result by the whole operator.
    rows, places, _ = spans._anchors([t for _, t in docs])
    marks = {(int(r), int(p)) for r, p in zip(rows, places)}
    monkeypatch.undo()
    rows, places, _ = spans._anchors([t for _, t in docs])
    assert marks == {(int(r), int(p)) for r, p in zip(rows, places)}
    assert {tuple(r) for r in sharing_pairs(df).collect()} == brute(docs)[0] == {(1, 2), (1, 3), (2, 3)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharing_pairs(df).count() == 0 and shared_characters(df).count() == 0
    assert sharing_pairs(spark.createDataFrame([(None, text(400)), (1, None)], "doc_id bigint, text string")).count() == 0

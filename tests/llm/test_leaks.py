import random
import re

import pytest

from tidemill.llm import leaks
from tidemill.llm.leaks import SPAN, leaked_items

R = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(60)]
ITEMS = [(i, " ".join(R.choice(VOCABULARY) for _ in range(R.randint(20, 40)))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]


def runs(doc, item):
    """The longest run of words in common, by trying all."""
    a, b = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (doc, item))
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.fixture(scope="module")
def docs():
    out = [(900, None), (901, ""), (902, "  "), (903, "टीम " * 30)]
    for n in range(150):
        words = ITEMS[R.randrange(12)][1].split()
        size = R.randint(9, 15)
        at = R.randint(0, max(0, len(words) - size))
        part = words[at : at + size]
        for _ in range(n % 4):
            part[R.randrange(len(part))] = "changed"
        text = R.choice([" ", ", ", "\r\n", "--", "_"]).join(part)
        out.append((n, R.choice(["", "Start here. "]) + R.choice([str.upper, str.title, str])(text) + R.choice(["", " and so on", "​!"])))
    return out


def test_exact_runs(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, item_id string, span_words int").repartition(3)
    items = spark.createDataFrame([(i, t, "q", 5) for i, t in ITEMS], "item_id bigint, text string, question_set string, doc_id int")
    found = leaked_items(df, items).collect()
    want = {(d, i) for d, x in docs for i, y in ITEMS if runs(x, y) >= SPAN}
    assert want and {(r.doc_id, r.item_id) for r in found if r.exact_run >= SPAN} == want
    assert all(r.exact_run == runs(dict(docs)[r.doc_id], dict(ITEMS)[r.item_id]) for r in found if r.exact_run >= SPAN)


def test_substitutions_are_tolerated(spark):
    words = ITEMS[0][1].split()[:SPAN]
    rows = []
    for a in range(SPAN):
        for b in range(a, SPAN):
            changed = list(words)
            changed[a] = changed[b] = "other"
            rows.append((a * 100 + b, " ".join(changed)))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = {r.doc_id: r for r in leaked_items(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect() if r.item_id == 0}
    assert set(found) == {i for i, _ in rows}
    assert all(r.span_words == SPAN and r.equal_words == SPAN - len({i // 100, i % 100}) and r.first_word == 0 for i, r in found.items())


def test_a_full_filter_gives_the_same(spark, docs, monkeypatch):
    """More evaluation texts than the filter can tell apart: everything is joined, the result stays."""
    df, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    whole = sorted(leaked_items(df, items).collect())
    full = leaks._filter(spark.createDataFrame([(1,)], "h bigint"))
    full[:] = 0xFFFFFFFFFFFFFFFF
    monkeypatch.setattr(leaks, "_filter", lambda seeds: full)
    assert whole and sorted(leaked_items(df, items).collect()) == whole


def test_hot_window_and_repeated_rows(spark):
    """A passage that half of all documents and many items hold: every pair comes out, once for equal rows."""
    words = ITEMS[0][1].split()[:SPAN]
    docs = [(i, f"d{i} " * 3 + " ".join(words)) for i in range(3000)] + [(7, "d7 " * 3 + " ".join(words)), (7, " ".join(words)), (None, " ".join(words)), (None, " ".join(words))]
    items = [(i, " ".join(words) + f" i{i}") for i in range(20)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + items[:3], "item_id bigint, text string")).select("doc_id", "item_id", "exact_run").collect()
    assert len(got) == 3002 * 20 and {r.exact_run for r in got} == {SPAN}


def test_letters_that_grow_in_lower_case(spark):
    text = " ".join("İ" * 12)
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [tuple(r) for r in leaked_items(rows, rows.withColumnRenamed("doc_id", "item_id")).select("doc_id", "item_id").collect()] == [(1, 1)]


def test_empty(spark, docs):
    df, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leaked_items(df.limit(0), items).count() == 0 and leaked_items(df, items.limit(0)).count() == 0


def test_very_long_text(spark):
    words = ITEMS[2][1].split()[:SPAN]
    text = "filler " * 300_000 + " ".join(words) + " filler" * 10
    got = leaked_items(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()
    assert [(r.item_id, r.exact_run, r.first_word) for r in got] == [(2, SPAN, 300_000)]

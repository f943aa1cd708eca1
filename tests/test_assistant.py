import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill import assistant
from tidemill.operators.entities import mentions
from tidemill.operators.retrieval import sections


@pytest.mark.parametrize(
    "question, kind, tool",
    [
        ("Hello, what can you do?", "help", None),
        ("Which columns does the sales table have?", "out_of_scope", None),
        ("Why did revenue fall last week?", "insufficient", "sales_overview"),
        ("How is net revenue calculated?", "method", None),
        ("How many rows were written in the last run?", "data", "pipeline_rows"),
        ("How many rows are in quarantine?", "data", "quarantine"),
        ("Show lapsing and at risk customers", "data", "retention"),
        ("Which products have the highest expected demand?", "data", "top_forecast"),
        ("What does policy say about refunds?", "policy", None),
        ("Show late deliveries and what we should do: what to do?", "hybrid", "delivery_overview"),
        ("What does lift mean?", "method", None),
        ("tell me a story", "policy", None),
        ("", "policy", None),
    ],
)
def test_routes(question, kind, tool):
    assert assistant.route(question) == (kind, tool)


def test_a_word_counts_for_the_tool_of_the_longest_phrase():
    found = assistant.scores("at risk customers by highest expected demand")
    assert found["top_forecast"] > 0 and found["category_forecast"] == 0 and found["retention"] > 0


def test_table_of_questions(spark):
    df = spark.createDataFrame([(1, "Show cancelled orders"), (2, None)], "item_id int, text string")
    assert {tuple(r) for r in assistant.routed(df, "item_id", "text").collect()} == {(1, "data", "cancellations"), (2, None, None)}


def test_parameters_are_checked():
    first, last, known = dt.date(2025, 4, 1), dt.date(2025, 7, 1), {"store": {"S1"}, "category": {"C1"}}
    check = lambda tool, **given: assistant.checked(tool, given, known, first, last)
    assert check("category_forecast", store="S1", category="C1") == {"store": "S1", "category": "C1"}
    for tool, given in (("category_forecast", {"store": "S2"}), ("sales_overview", {"start": dt.date(2025, 3, 1)}), ("sales_overview", {"stores": ["S1", "S9"]}), ("top_products", {"top": 21}), ("top_products", {"top": 0}), ("retention", {"top": 5}), ("delivery_overview", {"start": last, "end": first})):
        with pytest.raises(assistant.BadParameter):
            check(tool, **given)


def test_replies(spark):
    many = spark.range(30).select(F.col("id").alias("customer_id"), F.col("id").alias("n"))
    text = assistant.table_text(many)
    assert "customer_id" not in text and text.count("\n") == 22 and "there are more" in text
    assert "more" not in assistant.table_text(many.limit(3))
    said = assistant.reply("insufficient", "| n |", [("Orders wait.", "document 4")])
    assert "not why" in said and "Orders wait. [1]" in said and "[1] document 4" in said
    assert "nothing" in assistant.reply("policy", None)


@pytest.mark.parametrize("answer, ok", [("Sales were 1,200 in two stores [1].", True), ("Sales were 1300.", False), ("Three stores.", False), ("No number.", True)])
def test_numbers_must_be_grounded(answer, ok):
    assert assistant.grounded(answer, "1200 units, 2 stores") is ok
    assert not assistant.grounded("fine", "", ["[1]"])


def test_answer_over_the_tables(spark, sf):
    assert "| deliveries |" in assistant.answer(spark, sf, "analyst", "Show the delivery performance").replace("| deliveries | delivered", "| deliveries |")


def test_names_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "From New-York to york"), (2, "Newyork, Yorkshire"), (3, None), (4, ""), (5, "store s01 S01!")], "i int, t string")
    names = spark.createDataFrame([("city", "NY", "New York"), ("city", "Y", " york "), ("store", "S01", "S01"), ("store", "x", "..."), ("store", "x", None)], "kind string, entity string, name string")
    got = sorted((r.id, r.entity, r.words) for r in mentions(docs, "i", "t", names).collect())
    assert got == [(1, "NY", 2), (1, "Y", 1), (1, "Y", 1), (5, "S01", 1), (5, "S01", 1)]
    assert mentions(docs, "i", "t", names.limit(0)).count() == 0


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\r\n# One \nbody #x\n## Two\nmore"), (2, None), (3, " "), (4, "plain")], "d int, t string")
    assert [(r.doc_id, r.section, r.heading, r.body) for r in sections(df, "d", "t").sort("doc_id", "section").collect()] == [(1, 1, "", "intro\n"), (1, 2, "One", "One \nbody #x\n"), (1, 3, "Two", "Two\nmore"), (4, 1, "", "plain")]

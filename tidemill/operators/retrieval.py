"""Keyword retrieval over a corpus: chunks, tokens, synonym expansion, BM25, best sentences, grounded numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.operators.wordlists import STOPWORDS, SYNONYMS
from tidemill.scale import join_salted, written

# Chunk sizes in words, BM25 constants, the score below which an answer is no answer.
LONG, WINDOW, OVERLAP, SHORT = 200, 160, 30, 12
K1, B = 1.5, 0.75
LEAST_SCORE = 3.24

def plain_text(c: Column) -> Column:
    """Markdown without its marks: links as their text, emphasis, code and heading marks removed."""
    linked = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(linked, r"(?m)^#+\s*", ""), r"[*`_]{1,3}", "")


def chunks(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, part, text, words): documents of over 200 words as windows of 160 words, 30 shared; under 12 words none."""
    words = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != "")
    step = WINDOW - OVERLAP
    n = F.size("w")
    # A window begins every `step` words until one reaches the end.
    count = F.when(n <= LONG, 1).otherwise(F.greatest(F.ceil((n - WINDOW) / F.lit(step)).cast("int"), F.lit(0)) + 1)
    size = F.when(n <= LONG, n).otherwise(WINDOW)
    parts = documents.select(F.col(doc_id).alias("doc_id"), words.alias("w")).where(n >= SHORT).select("doc_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), count)).alias("part"))
    part = F.slice("w", (F.col("part") - 1) * step + 1, F.col("size"))
    return parts.select("doc_id", "part", F.array_join(part, " ").alias("text"), F.size(part).alias("words"))


def stem(w: Column) -> Column:
    """A word without its commonest English endings."""
    cut = lambda n: w.substr(F.lit(1), F.length(w) - n)
    return (
        F.when((F.length(w) > 5) & w.endswith("ing"), cut(3))
        .when((F.length(w) > 4) & w.endswith("ed"), cut(2))
        .when((F.length(w) > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), cut(1))
        .otherwise(w)
    )


def tokens(text: Column) -> Column:
    """Stemmed lower-case words of letters and digits without stopwords, as an array."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOPWORDS)), stem)


def expanded(text: Column) -> Column:
    """The distinct tokens of a question, with those of every synonym group of which it holds a phrase."""
    groups = [F.when(F.lower(text).rlike("|".join(rf"(?<![a-z]){p}(?![a-z])" for p in g)), tokens(F.lit(" ".join(g)))).otherwise(F.array().cast("array<string>")) for g in SYNONYMS]
    return F.array_distinct(F.concat(tokens(text), *groups))


def bm25(parts: DataFrame, key: list[str], text: str, questions: DataFrame, question_id: str, question: str, expand: bool = True) -> DataFrame:
    """(question_id, *key, score) of every question and part with a word in common.

    Only words that some question asks are kept of the postings. Tokens and weights are written, as several branches read
    them; words that a large part of the corpus holds are salted. Scores are combined map-side per question and part.
    """
    n = written(parts.select(*key, tokens(F.col(text)).alias("t")).where(F.size("t") > 0), "tokens")
    size = n.agg(F.count("*").alias("N"), F.avg(F.size("t")).alias("mean"))
    asked = questions.select(F.col(question_id).alias("question_id"), F.explode(expanded(F.col(question)) if expand else F.array_distinct(tokens(F.col(question)))).alias("token"))
    postings = n.select(*key, F.size("t").alias("len"), F.explode("t").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    tf = written(postings.groupBy(*key, "token", "len").agg(F.count("*").alias("tf")), "frequencies")
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    rare = written(asked.join(df, "token"), "asked")
    x = join_salted(tf, rare, "token").join(F.broadcast(size))  # one row
    idf = F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return x.select("question_id", *key, weight.alias("w")).groupBy("question_id", *key).agg(F.round(F.sum("w"), 6).alias("score"))


def top_answers(scores: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """The k best parts of each question, ties by key; cut per question by a group limit."""
    w = W.partitionBy("question_id").orderBy(F.desc("score"), *key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numbers(text: Column) -> Column:
    """The numbers in a text, thousands separators removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))


def ungrounded(reply: Column, evidence: Column) -> Column:
    """Numbers of a reply that its evidence does not hold; empty means grounded."""
    return F.array_except(numbers(F.coalesce(reply, F.lit(""))), numbers(F.coalesce(evidence, F.lit(""))))


def best_sentences(text: Column, wanted: Column, k: int = 2) -> Column:
    """The k sentences sharing most words with `wanted` (an array of tokens), in their order in the text."""
    sentences = F.filter(F.split(text, r"(?<=[.!?।])\s+"), lambda s: F.trim(s) != "")
    scored = F.transform(sentences, lambda s, i: F.struct(-F.size(F.array_intersect(tokens(s), wanted)).alias("s"), i.alias("i"), s.alias("t")))
    picked = F.slice(F.array_sort(scored), 1, k)
    return F.transform(F.array_sort(F.transform(picked, lambda p: F.struct(p["i"], p["t"]))), lambda p: p["t"])


def sections(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, section, heading, body) of the parts of marked-up texts between headings (# to ######); blank parts are left out.

    Section 1 is what stands before the first heading (heading ''); line ends of any kind count. Null texts have none.
    """
    lines = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    parts = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(lines, r"(?m)^#{1,6}[ ]+")).alias("i", "body"))
    heading = F.when(F.col("i") > 0, F.trim(F.substring_index("body", "\n", 1))).otherwise(F.lit(""))
    return parts.where(F.trim("body") != "").select("doc_id", (F.col("i") + 1).alias("section"), heading.alias("heading"), "body")


def calibrated(scores: DataFrame) -> DataFrame:
    """(worst_inside, best_outside, threshold) of (score, inside): the midpoint between the worst question with an answer and the best without."""
    low, high = F.min(F.when(F.col("inside"), F.col("score"))), F.max(F.when(~F.col("inside"), F.col("score")))
    return scores.agg(F.round(low, 6).alias("worst_inside"), F.round(high, 6).alias("best_outside"), F.round((low + high) / 2, 6).alias("threshold"))

"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.keys import norm_key
from tidemill.llm import encode, leaks, pairs, spans
from tidemill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_PAIRS_SQL = """
    with h as (select distinct upper(trim(order_id)) as o, upper(trim(product_id)) as p from slv_order_items where order_id is not null and product_id is not null),
    m as (select p, count(*) as n from h group by 1),
    j as (select x.p as a, y.p as b, count(*) as nab from h x join h y on x.o = y.o and x.p < y.p group by 1, 2),
    r as (select a, b, ma.n as na, mb.n as nb, nab, (select count(distinct o) from h) as n from j join m ma on ma.p = a join m mb on mb.p = b),
    s as (select *, nab / n as support, (nab * n) / (na * nb) as lift from r)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.item_pairs(table(spark, d, "slv_order_items"), norm_key(F.col("order_id")), norm_key(F.col("product_id")), min_both=8, min_support=0.002, min_lift=3.0)


@query(f"{_PAIRS_SQL} select a as product_a, b as product_b from s where nab >= 8 and support >= 0.002 and lift >= 3")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Product pairs bought together far more often than chance."""
    return _pairs(spark, d).select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


@query(f"""{_PAIRS_SQL} select a as product_a, b as product_b, cast(nab as bigint) as baskets_both, cast(n as bigint) as n_baskets, round(support, 6) as support, round(lift, 6) as lift, round(nab / na, 6) as confidence_ab,
    round(nab / nb, 6) as confidence_ba, round(log2(lift), 6) as pmi from s where nab >= 8 and support >= 0.0005""")
def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Support, lift, confidences and pointwise mutual information of all pairs in at least 8 baskets and 0.05 % of them."""
    found = pairs.item_pairs(table(spark, d, "slv_order_items"), norm_key(F.col("order_id")), norm_key(F.col("product_id")), min_both=8, min_support=0.0005)
    rounded = [F.round(c, 6).alias(c) for c in ("support", "lift", "confidence_ab", "confidence_ba", "pmi")]
    return found.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "baskets_both", "n_baskets", *rounded)


@query(f"""{_PAIRS_SQL} select a as product_a, b as product_b, cast(nab as bigint) as baskets_both, cast(n as bigint) as n_baskets, round(support, 6) as support, round(lift, 6) as lift, round(nab / na, 6) as confidence_ab,
    round(nab / nb, 6) as confidence_ba, round(log2(lift), 6) as pmi from s""")
def p6_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The figures of p6_pairs for every pair of products that shares an order, however rare and below chance too."""
    found = pairs.item_pairs(table(spark, d, "slv_order_items"), norm_key(F.col("order_id")), norm_key(F.col("product_id")))
    rounded = [F.round(c, 6).alias(c) for c in ("support", "lift", "confidence_ab", "confidence_ba", "pmi")]
    return found.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "baskets_both", "n_baskets", *rounded)


@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's token ids by byte_bpe_50k."""
    return encode.token_ids(table(spark, d, "documents"))


def _word_windows(table_name: str, key: str) -> str:
    """Every window of 12 words of a text as one string, without masks or hashes."""
    words = f"select {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {table_name} where text is not null"
    return f"(select distinct {key}, array_to_string(w[i : i + 11], ' ') as k from ({words}) x, unnest(range(1, len(w) - 10)) t(i) where len(w) >= 12)"


@query(f"select distinct doc_id, item_id from {_word_windows('documents', 'doc_id')} d join {_word_windows('eval_items', 'item_id')} i on i.k = d.k")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).where(F.col("exact_run") >= leaks.SPAN).select("doc_id", "item_id").distinct()


@query()
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All documents and items that match, substitutions tolerated, with what they have in common."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


# Every window of 300 characters, compared as text.
_SPANS_SQL = "w as (select doc_id, cast(i as int) as s, substring(text, i, 300) as k from documents, unnest(range(1, cast(length(text) as int) - 298)) t(i) where length(text) >= 300), g as (select k from w group by 1 having min(doc_id) < max(doc_id)), m as (select doc_id, s, w.k from w join g on g.k = w.k)"


@query(f"""with {_SPANS_SQL}, l as (select distinct a.doc_id, b.doc_id as other from m a join m b on a.k = b.k and a.doc_id <> b.doc_id) select doc_id, cast(count(*) as bigint) as links from l group by 1""")
def p9_links(spark: SparkSession, d: str) -> DataFrame:
    """How many other documents share at least 300 characters in a row with each document, counted by classes."""
    return spans.sharing_classes(table(spark, d, "documents")).select("doc_id", "links")


@query(f"with {_SPANS_SQL} select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from m a join m b on a.k = b.k and a.doc_id < b.doc_id")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with at least 300 characters in a row in common."""
    return spans.sharing_pairs(table(spark, d, "documents"))


@query(f"""with {_SPANS_SQL}, p as (select distinct doc_id, s from m), r as (select doc_id, s, greatest(0, 300 - coalesce(lead(s) over (partition by doc_id order by s) - s, 300)) as overlap from p),
    c as (select doc_id, sum(300 - overlap) as shared_chars from r group by 1)
    select doc_id, cast(length(text) as bigint) as n_chars, cast(shared_chars as bigint) as shared_chars, round(shared_chars / length(text), 6) as shared_share from c join documents using (doc_id)""")
def p9_shared_characters(spark: SparkSession, d: str) -> DataFrame:
    """How many characters of each document are shared elsewhere."""
    return spans.shared_characters(table(spark, d, "documents"))

"""Names found in texts as whole words, by an equi-join on their first word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_tokens(text: Column) -> Column:
    """The runs of letters a-z and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def mentions(documents: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(id, kind, entity, words) for every place where the words of a name stand in a row in a text.

    names: (kind, entity, name). Each word of a text meets the names that begin with it; the rest of a name is compared
    with the words that follow, of which a row carries as many as the longest name has (one number, read first). Null
    texts and names without a word match nothing.
    """
    wanted = names.select("kind", "entity", name_tokens(F.col("name")).alias("n")).where(F.size("n") > 0).distinct()
    longest = wanted.agg(F.max(F.size("n"))).first()[0] or 1
    tokens = documents.select(F.col(key).alias("id"), name_tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    # The last windows of a text are shorter; slice allows that.
    places = tokens.select("id", F.explode(F.transform("t", lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("p"), "t").select("id", F.col("p.w").alias("w"), F.slice("t", F.col("p.i") + 1, longest).alias("ahead"))
    found = places.join(wanted.withColumn("w", F.get("n", F.lit(0))), "w").where(F.slice("ahead", F.lit(1), F.size("n")) == F.col("n"))
    return found.select("id", "kind", "entity", F.size("n").alias("words"))

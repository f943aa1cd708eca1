"""Retrieval over the documents, with the held-out questions as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill import assistant
from tidemill.operators import retrieval as r
from tidemill.operators.entities import mentions
from tidemill.operators.wordlists import STOPWORDS, SYNONYMS
from tidemill.plans.registry import Registry
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_STEM = "case when len({0}) > 5 and {0} like '%ing' then {0}[:-4] when len({0}) > 4 and {0} like '%ed' then {0}[:-3] when len({0}) > 4 and {0} like '%ies' then {0}[:-4] || 'y' when len({0}) > 3 and {0} like '%s' and {0} not like '%ss' then {0}[:-2] else {0} end"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_tokens = lambda t: f"list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: w not in {_STOP}), lambda w: {_STEM.format('w')})"
_CHUNKS = f"""
    words as (select doc_id, list_filter(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') as w from documents where text is not null),
    parts as (select doc_id, w, cast(unnest(range(1, cast(case when len(w) <= {r.LONG} then 1 else greatest(ceil((len(w) - {r.WINDOW}) / {r.WINDOW - r.OVERLAP}.0), 0) + 1 end as int) + 1)) as int) as part from words where len(w) >= {r.SHORT}),
    chunks as (select doc_id, part, array_to_string(c, ' ') as text, cast(len(c) as int) as words from (select doc_id, part, case when len(w) <= {r.LONG} then w else w[(part - 1) * {r.WINDOW - r.OVERLAP} + 1 : (part - 1) * {r.WINDOW - r.OVERLAP} + {r.WINDOW}] end as c from parts))"""
_GROUPS = ", ".join(f"case when regexp_matches(lower(text), '{'|'.join('(?:^|[^a-z])' + p + '(?:$|[^a-z])' for p in g)}') then {_tokens(chr(39) + ' '.join(g) + chr(39))} else [] end" for g in SYNONYMS)
_BM25 = f"""{_CHUNKS},
    tok as (select doc_id, part, {_tokens('text')} as t from chunks), full_tok as (select * from tok where len(t) > 0),
    size as (select count(*) as n, avg(len(t)) as mean from full_tok),
    asked as (select distinct item_id as question_id, unnest(flatten([{_tokens('text')}, {_GROUPS}])) as token from eval_items),
    tf as (select doc_id, part, token, any_value(len) as len, count(*) as tf from (select doc_id, part, len(t) as len, unnest(t) as token from full_tok) group by 1, 2, 3),
    df as (select token, count(*) as df from tf group by 1),
    scores as (select question_id, doc_id, part, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {r.K1 + 1} / (tf + {r.K1} * (1 - {r.B} + {r.B} * len / mean))), 6) as score from tf join df using (token) cross join size join asked using (token) group by 1, 2, 3)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return r.chunks(table(spark, d, "documents"), "doc_id", "text")


@query(f"with {_CHUNKS} select doc_id, part, words, md5(text) as digest from chunks")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into overlapping windows of words."""
    return _chunks(spark, d).select("doc_id", "part", "words", F.md5("text").alias("digest"))


@query(f"select item_id, array_to_string(list_sort(list_distinct(flatten([{_tokens('text')}, {_GROUPS}]))), ' ') as tokens from eval_items")
def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The words each question is asked with."""
    return table(spark, d, "eval_items").select("item_id", F.array_join(F.sort_array(r.expanded(F.col("text"))), " ").alias("tokens"))


@query(f"with {_BM25} select question_id, doc_id, part, cast(score as decimal(18,4)) as score, cast(rank as int) as rank from (select *, row_number() over (partition by question_id order by score desc, doc_id, part) as rank from scores) where rank <= 3")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks for every held-out question."""
    s = r.bm25(_chunks(spark, d), ["doc_id", "part"], "text", table(spark, d, "eval_items"), "item_id", "text")
    return r.top_answers(s, ["doc_id", "part"]).withColumn("score", F.col("score").cast("decimal(18,4)"))


_WANTED = f"select item_id, question_set, list_distinct(flatten([{_tokens('text')}, {_GROUPS}])) as wanted, list_distinct({_tokens('text')}) as own from eval_items"
#: The best chunk of each question, if its score divided by the root of the question's own words clears the threshold.
_ANSWERED = f"""{_BM25}, best as (select question_id, max(score) as score from scores group by 1), wanted as ({_WANTED})"""


@query(f"""with {_ANSWERED} select question_set, cast(count(*) as bigint) as questions, cast(count(*) filter (score / sqrt(len(own)) >= {r.LEAST_SCORE}) as bigint) as answered, round(avg(score), 4) as mean_score from wanted left join best on best.question_id = item_id group by 1""")
def assistant_eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per set of questions: how many, how many of them find an answer over the threshold, and the mean best score."""
    items = table(spark, d, "eval_items")
    best = r.bm25(_chunks(spark, d), ["doc_id", "part"], "text", items, "item_id", "text").groupBy("question_id").agg(F.max("score").alias("score"))
    asked = items.select(F.col("item_id").alias("question_id"), "question_set", F.size(F.array_distinct(r.tokens(F.col("text")))).alias("own"))
    return asked.join(best, "question_id", "left").groupBy("question_set").agg(F.count("*").alias("questions"), F.count_if(F.col("score") / F.sqrt("own") >= r.LEAST_SCORE).alias("answered"), F.round(F.avg("score"), 4).alias("mean_score"))


@query()
def best_passages(spark: SparkSession, d: str) -> DataFrame:
    """For every question the two best sentences of its best chunk, if the score clears the threshold for its length."""
    items, parts = table(spark, d, "eval_items"), _chunks(spark, d)
    best = r.top_answers(r.bm25(parts, ["doc_id", "part"], "text", items, "item_id", "text"), ["doc_id", "part"], 1)
    asked = items.select(F.col("item_id").alias("question_id"), r.expanded(F.col("text")).alias("wanted"), F.size(F.array_distinct(r.tokens(F.col("text")))).alias("own"))
    found = best.join(asked, "question_id").where(F.col("score") / F.sqrt("own") >= r.LEAST_SCORE).join(parts, ["doc_id", "part"])
    return found.select("question_id", "doc_id", "part", "score", F.array_join(r.best_sentences(F.col("text"), F.col("wanted")), " ").alias("answer"))


#: Words that decide what kind of question it is, first match first.
ROUTES = (("number", "how many|how much|what share"), ("reason", "why|explain|explains"), ("choice", "which|who|whom"), ("procedure", "how is|how are|how does"))


@query(f"select item_id, case {' '.join(f'''when regexp_matches(lower(text), '{chr(92)}b({p}){chr(92)}b') then '{k}' ''' for k, p in ROUTES)} else 'other' end as route from eval_items")
def route_questions(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every question by ordered rules."""
    kind = None
    for name, pattern in ROUTES:
        hit = F.lower("text").rlike(rf"\b({pattern})\b")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return table(spark, d, "eval_items").select("item_id", kind.otherwise("other").alias("route"))


# Names count as whole words: a name's words must stand in a row among those of the text.
_IN_ROW = "' ' || array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ') || ' '"
_NAMES_SQL = """select distinct kind, entity, name from (select 'store' as kind, upper(trim(store_id)) as entity, store_id as name from stores union all select 'store', upper(trim(store_id)), store_name from stores union all select 'city', trim(city), city from stores
    union all select 'category', upper(trim(category_id)), category_id from products union all select 'product', upper(trim(product_id)), product_id from products union all select 'product', upper(trim(product_id)), product_name from products) where entity is not null and name is not null"""


@query(f"select distinct d.doc_id, n.entity as city from documents d join (select distinct entity, {_IN_ROW.format('name')} as row from ({_NAMES_SQL}) where kind = 'city' and len(regexp_extract_all(lower(name), '[a-z0-9]+')) > 0) n on contains({_IN_ROW.format('d.text')}, n.row)")
def city_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Cities named in each document, as whole words: an equi-join on the first word of a name."""
    return mentions(table(spark, d, "documents"), "doc_id", "text", _names(spark, d).where("kind = 'city'")).select("id", "entity").distinct().toDF("doc_id", "city")


def _names(spark: SparkSession, d: str) -> DataFrame:
    stores, products = table(spark, d, "stores"), table(spark, d, "products")
    key = lambda c: F.upper(F.trim(c))
    parts = [(stores, "store", key("store_id"), "store_id"), (stores, "store", key("store_id"), "store_name"), (stores, "city", F.trim("city"), "city"), (products, "category", key("category_id"), "category_id"), (products, "product", key("product_id"), "product_id"), (products, "product", key("product_id"), "product_name")]
    rows = [df.select(F.lit(kind).alias("kind"), entity.alias("entity"), F.col(name).alias("name")) for df, kind, entity, name in parts]
    return reduce(DataFrame.unionByName, rows).where("entity is not null and name is not null").distinct()


@query(f"""with n as (select kind, entity, {_IN_ROW.format('name')} as row, len(regexp_extract_all(lower(name), '[a-z0-9]+')) as words from ({_NAMES_SQL})),
    f as (select distinct d.doc_id, kind, entity, words from documents d join n on words > 0 and contains({_IN_ROW.format('d.text')}, n.row)),
    b as (select doc_id, kind, entity, max(words) as words, max(max(words)) over (partition by doc_id, kind) as most from f group by 1, 2, 3)
    select doc_id, kind, entity, cast(words as int) as words from b where kind <> 'product' or words = most""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Stores, cities, categories and products named in each document, by id or name; of products the longest names only."""
    found = mentions(table(spark, d, "documents"), "doc_id", "text", _names(spark, d)).groupBy(F.col("id").alias("doc_id"), "kind", "entity").agg(F.max("words").alias("words"))
    most = F.max("words").over(W.partitionBy("doc_id", "kind"))
    return found.withColumn("most", most).where("kind <> 'product' or words = most").drop("most")


_PERIOD = r"last (\d+) days?"


@query(f"""select item_id, try_cast(nullif(regexp_extract(lower(text), '{_PERIOD}', 1), '') as int) as last_days, try_cast(nullif(regexp_extract(lower(text), '(?:^|[^a-z0-9_])top (\\d+)(?:$|[^a-z0-9_])', 1), '') as int) as top,
    regexp_matches(lower(text), '(?:^|[^a-z0-9])(last|this|past) week(?:$|[^a-z0-9])') as week, regexp_matches(lower(text), '(?:^|[^a-z0-9])(last|this|past) month(?:$|[^a-z0-9])') as month from eval_items""")
def question_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The period and limit every question asks for."""
    t = F.lower("text")
    whole = lambda p: t.rlike(rf"(?<![a-z0-9])(?:{p})(?![a-z0-9])")
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("int")
    return table(spark, d, "eval_items").select("item_id", number(_PERIOD).alias("last_days"), number(r"\btop (\d+)\b").alias("top"), whole("(?:last|this|past) week").alias("week"), whole("(?:last|this|past) month").alias("month"))


def passages(spark: SparkSession, d: str, question: str) -> list[tuple[str, str]]:
    """(sentences, source) of the best three chunks for one question whose score clears the threshold."""
    asked = spark.createDataFrame([(0, question)], "item_id int, text string")
    parts = _chunks(spark, d)
    best = r.top_answers(r.bm25(parts, ["doc_id", "part"], "text", asked, "item_id", "text"), ["doc_id", "part"]).join(parts, ["doc_id", "part"])
    words = asked.select(r.expanded(F.col("text")).alias("wanted"), F.size(F.array_distinct(r.tokens(F.col("text")))).alias("own"))
    found = best.join(F.broadcast(words)).where(F.col("score") / F.sqrt("own") >= r.LEAST_SCORE)  # one question
    rows = found.select("rank", F.array_join(r.best_sentences(F.col("text"), F.col("wanted")), " ").alias("answer"), "doc_id", "part").orderBy("rank").collect()  # three at most
    return [(x.answer, f"document {x.doc_id}, part {x.part}") for x in rows]


@query()
def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """What kind of answer each question asks for and which tool gives it; rules over the words, in Arrow batches."""
    return assistant.routed(table(spark, d, "eval_items").select("item_id", "text"), "item_id", "text")


@query(f"""with {_ANSWERED}, s as (select score / sqrt(len(own)) as s, question_set <> (select min(question_set) from eval_items) as inside from wanted join best on best.question_id = item_id where len(own) > 0)
    select round(min(s) filter (inside), 6) as worst_inside, round(max(s) filter (not inside), 6) as best_outside, round((min(s) filter (inside) + max(s) filter (not inside)) / 2, 6) as threshold from s""")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The score between the worst question that has an answer and the best that has none (one set of questions standing in for the latter)."""
    items = table(spark, d, "eval_items")
    best = r.bm25(_chunks(spark, d), ["doc_id", "part"], "text", items, "item_id", "text").groupBy("question_id").agg(F.max("score").alias("score"))
    asked = items.select(F.col("item_id").alias("question_id"), "question_set", F.size(F.array_distinct(r.tokens(F.col("text")))).alias("own")).where("own > 0")
    first = F.broadcast(items.agg(F.min("question_set").alias("other")))  # one row
    x = asked.join(best, "question_id").join(first).select((F.col("score") / F.sqrt("own")).alias("score"), (F.col("question_set") != F.col("other")).alias("inside"))
    return r.calibrated(x)


@query(r"""with x as (select doc_id, regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^#{1,6}[ ]+') as p, regexp_matches(text, '^#{1,6}[ ]+') as headed from documents where text is not null), y as (select doc_id, unnest(range(1, len(p) + 1)) as i, p from x)
    select doc_id, cast(i as int) as section, case when i > 1 then trim(split_part(p[i], chr(10), 1), ' ') else '' end as heading, md5(p[i]) as digest from y where trim(p[i], ' ') <> ''""")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents split at their headings, the part before the first one included."""
    return r.sections(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "section", "heading", F.md5("body").alias("digest"))


@query("""with f as (select unnest(list_distinct(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?'))) as raw, doc_id from documents where source = 'assistant'), a as (select doc_id, replace(raw, ',', '') as number from f)
    select doc_id, cast(count(distinct number) as bigint) as numbers from a group by 1""")
def numbers_in_replies(spark: SparkSession, d: str) -> DataFrame:
    """How many different numbers each assistant reply states: what a guardrail has to find in the evidence."""
    x = table(spark, d, "documents").where("source = 'assistant'").select("doc_id", F.explode(r.numbers(F.col("text"))).alias("n"))
    return x.groupBy("doc_id").agg(F.count_distinct("n").alias("numbers"))

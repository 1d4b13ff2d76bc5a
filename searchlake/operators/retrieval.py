"""Retrieval: topics, floors, rank fusion, boosts, diversity, normalisation, pagination; the index and its search are in ``search``.

BM25's k1 and b and the tokeniser are our own choice: 1.2, 0.75 and lower-case runs of letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlake.functions.dialect import quantised, sql_list, sql_quantised
from searchlake.functions.text import sql_words_of, words_of
from searchlake.operators.search import DEPTH, K1, B

TOP, PER_DOMAIN, RRF_K = 10, 3, 60
ABSOLUTE_FLOOR, RELATIVE_FLOOR = 0.5, 0.05
SEMANTIC_MIN, SEMANTIC_EACH, SEMANTIC_ROWS = 0.80, 0.75, 5
# fixed values: words that are no topic of a query
TOPIC_STOPS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "you", "are", "was", "were", "how", "what", "why", "when", "where", "who", "which", "can",
    "will", "would", "should", "could", "make", "made", "get", "got", "use", "using", "best", "top", "home", "house", "way", "ways", "like", "need", "want", "know",
    "find", "finds", "help", "helping", "about", "than", "then", "them", "they", "does", "did", "doing", "easy", "simple", "quick", "guide", "tutorial", "recipe", "recipes",
)


def distinctive(text: Column) -> Column:
    return F.filter(words_of(text), lambda w: (F.octet_length(w) >= 3) & ~w.isin(*TOPIC_STOPS))


def sql_distinctive(text: str) -> str:
    return f"list_filter({sql_words_of(text)}, lambda w: strlen(w) >= 3 and w not in {sql_list(TOPIC_STOPS)})"


def topics(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct distinctive words."""
    return queries.select("query_id", F.explode(F.array_distinct(distinctive(F.col("text")))).alias("term"))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct words."""
    return queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, term, tf); only of the given terms if there are any, so the rest is never shuffled."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def sql_search(queries: str = "select item_id as query_id, text from benchmark", docs: str = "select doc_id, text as content from documents", fields: tuple[str, ...] = ("content",)) -> str:
    """Common table expressions for queries of plain words, that end with ``bm25(query_id, doc_id, score)``: a sum over the words of a query and the fields."""
    words = " union all ".join(f"select doc_id, '{f}' as field, {sql_words_of(f'coalesce({f}, {chr(39) * 2})')} as w from ds" for f in fields)
    return f"""qs as ({queries}), ds as ({docs}),
    terms as (select query_id, term, count(*)::double as boost from (select query_id, unnest({sql_words_of('text')}) as term from qs) group by 1, 2),
    topic as (select distinct query_id, unnest({sql_distinctive('text')}) as term from qs),
    dw as ({words}),
    post as (select field, doc_id, dl, term, count(*) as tf from (select field, doc_id, len(w) as dl, unnest(w) as term from dw) where term in (select term from terms) group by 1, 2, 3, 4),
    dfs as (select field, term, count(*)::double as df from post group by 1, 2),
    stats as (select field, count(*)::double as n, avg(len(w))::double as avgdl from dw group by 1),
    bm25 as (select query_id, doc_id, {sql_quantised(f"sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl)))")} as score
        from post join dfs using (field, term) join terms using (term) join stats using (field) group by 1, 2)"""


def floored(ranked: DataFrame) -> DataFrame:
    """Without matches far below the best, or without all if the best is no match; keeps ``best``."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    ranked = ranked.withColumn("best", best)
    return ranked.where((F.col("best") >= ABSOLUTE_FLOOR) & (F.col("score") >= F.greatest(F.col("best") * RELATIVE_FLOOR, F.lit(ABSOLUTE_FLOOR))))


SQL_RANKED = f"""ranked as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25) where rank <= {DEPTH}),
    floored as (select * from (select *, max(score) over (partition by query_id) as best from ranked) where best >= {ABSOLUTE_FLOOR} and score >= greatest(best * {RELATIVE_FLOOR}, {ABSOLUTE_FLOOR}))"""


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists: a document counts in every list it is in."""
    rows = lists[0].select("query_id", "doc_id", "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("query_id", "doc_id", "rank"))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def freshness(age: Column) -> Column:
    scale = 86400.0 * 7
    return 1 + 0.5 * (scale / (scale + age))


def diverse_top(results: DataFrame, domain: str, per: int = PER_DOMAIN, top: int = TOP) -> DataFrame:
    """At most ``per`` results of a domain, the best ``top`` of a query, scores divided by the best."""
    by_domain = Window.partitionBy("query_id", domain).orderBy(F.desc("score"), "doc_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    kept = results.withColumn("in_domain", F.row_number().over(by_domain)).where(F.col("in_domain") <= per)
    kept = kept.withColumn("position", F.row_number().over(by_query)).where(F.col("position") <= top)
    return kept.withColumn("score", quantised(F.col("score") / F.max("score").over(Window.partitionBy("query_id")))).drop("in_domain")


def sql_diverse_top(source: str, domain: str) -> str:
    return f"""select query_id, doc_id, {domain}, position::integer as position, {sql_quantised("score / max(score) over (partition by query_id)")} as score from (
        select *, row_number() over (partition by query_id order by score desc, doc_id) as position from (
        select *, row_number() over (partition by query_id, {domain} order by score desc, doc_id) as in_domain from {source}) where in_domain <= {PER_DOMAIN}) where position <= {TOP}"""


def page_of(rows: DataFrame, order: list, limit: int = 24, offset: int = 0) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` in the given order, with the total and whether more follow."""
    total = rows.count()
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.withColumn("total", F.lit(total).cast("long")).withColumn("has_more", F.lit(offset + limit < total))

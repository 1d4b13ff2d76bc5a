"""Retrieval and ranking queries over documents, with benchmark passages as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions import predicates as P
from searchlake.functions import text as T
from searchlake.functions import url as U
from searchlake.functions.dialect import quantised, sql_quantised
from searchlake.operators import ingest
from searchlake.operators import retrieval as R
from searchlake.operators import search as S
from searchlake.session import load, spread


def docs(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents"))


def asked(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark, sf_dir):
    """The index of the documents' texts."""
    source = load(spark, sf_dir, "documents")
    return S.index_of(spark, source, spread(source).select("doc_id", F.col("text").alias("content")), ("content",), "documents")


def retrieved(spark, sf_dir):
    """What whole benchmark passages find, above the floors: at most a list for each query, written once."""
    return S.kept(R.floored(S.ranked(asked(spark, sf_dir), index(spark, sf_dir))), "retrieved")


_FAST = f"""with {R.sql_search()}, {R.SQL_RANKED},
fused as (select query_id, doc_id, source, (1.0::double / ({R.RRF_K} + rank)) * (1 + 0.3::double * 0.5) as score
    from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r2 from floored) join (select doc_id, source from documents) using (doc_id))
{R.sql_diverse_top("fused", "source")}"""


@query("R1", "F14", "G3", "W1", "W2", "L1", "L2", "G4", "R9", "R12", "R13", "J1", "J3", "O5", sql=_FAST)
def search_fast(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    fused = R.fuse(retrieved(spark, sf_dir)).join(d.select("doc_id", "source"), "doc_id").withColumn("score", F.col("rrf") * (1 + 0.3 * F.lit(0.5)))
    return R.diverse_top(fused, "source").select("query_id", "doc_id", "source", "position", "score")


@query("G1", sql=f"with w as (select doc_id, {T.sql_words_of('text')} as w from documents) select count(*)::bigint as n, {sql_quantised('avg(len(w))')} as avgdl, sum(len(w))::bigint as tokens from w")
def corpus_statistics(spark, sf_dir):
    w = docs(spark, sf_dir).select(F.size(T.words_of(F.col("text"))).alias("l"))
    return w.agg(F.count(F.lit(1)).alias("n"), quantised(F.avg("l")).alias("avgdl"), F.sum("l").alias("tokens"))


@query("G1", sql=f"select term, count(distinct doc_id)::bigint as df, count(*)::bigint as cf from (select doc_id, unnest({T.sql_words_of('text')}) as term from documents) group by 1")
def term_frequencies(spark, sf_dir):
    p = R.postings(docs(spark, sf_dir))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_TITLES = "select doc_id, array_to_string((string_split(text, ' '))[1:8], ' ') as text from documents"


@query(
    "R2", "J3",
    sql=f"""with {R.sql_search()}, {R.SQL_RANKED}, t as (select doc_id, {T.sql_words_of('text')} as w from ({_TITLES})),
    hits as (select distinct terms.query_id, t.doc_id from terms join (select doc_id, unnest(w) as term from t) t using (term))
    select f.query_id, f.doc_id, (h.doc_id is not null) as in_title, {sql_quantised("f.score * case when h.doc_id is not null then 2.0 else 1.0 end")} as score
    from floored f left join hits h on h.query_id = f.query_id and h.doc_id = f.doc_id""",
)
def title_boost(spark, sf_dir):
    found = retrieved(spark, sf_dir)
    d = load(spark, sf_dir, "documents").join(found.select("doc_id").distinct(), "doc_id", "left_semi")  # the documents of the lists, no others
    title = d.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("text")).select("doc_id", T.words_of(F.col("text")).alias("w"))
    words = asked(spark, sf_dir).select("query_id", T.words_of(F.col("text")).alias("q"))
    pairs = found.select("query_id", "doc_id").join(words, "query_id").join(title, "doc_id")
    hits = pairs.where(F.arrays_overlap("q", "w")).select("query_id", "doc_id", F.lit(True).alias("hit")).distinct()
    kept = found.join(hits, ["query_id", "doc_id"], "left").withColumn("in_title", F.coalesce("hit", F.lit(False)))
    return kept.select("query_id", "doc_id", "in_title", quantised(F.col("score") * F.when(F.col("in_title"), 2.0).otherwise(1.0)).alias("score"))


_NOW = 1_706_745_600  # the moment of the search, in seconds
_PAGES = f"select page_id as doc_id, url, {T.sql_page_title('html')} as title, {T.sql_main_text('html')} as content, {_NOW - 86_400} - page_id % 90 * 43200 as ts from pages"
_TITLE_QUERIES = f"select doc_id as query_id, array_to_string({T.sql_words_of('title')}, ' ') as text from pgs where doc_id % 20 = 0"
_FIELDS = ("title", "content")


@query(
    "R1", "R2", "R7", "R8", "R9", "R12", "R13", "F14", "L1", "L2", "J1", "J3", "U8",
    sql=f"""with pgs as materialized ({_PAGES}), titled as (with {R.sql_search(_TITLE_QUERIES, "select doc_id, title from pgs", ("title",))}, {R.SQL_RANKED} select distinct query_id, doc_id from ranked),
    {R.sql_search(_TITLE_QUERIES, "select doc_id, title, content from pgs", _FIELDS)}, {R.SQL_RANKED},
    boosted as (select f.query_id, f.doc_id, {U.sql_diversity_domain('p.url')} as domain, 1.0::double / ({R.RRF_K} + row_number() over (partition by f.query_id order by f.score desc, f.doc_id))
        * (1 + 0.5::double * (604800::double / (604800 + {_NOW} - p.ts))) * (1 + 0.3::double * {U.sql_authority('p.url')}) * case when t.doc_id is null then 1 else 2 end as score
        from floored f join pgs p using (doc_id) left join titled t on t.query_id = f.query_id and t.doc_id = f.doc_id)
    {R.sql_diverse_top("boosted", "domain")}""",
)
def search_pages(spark, sf_dir):
    """Pages for the words of the titles of every twentieth page: BM25 of both fields, then freshness, the authority of each page's url and title hits."""
    ix, p = page_index(spark, sf_dir), load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    q = ix.docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(T.words_of(F.col("title")), " ").alias("text"))
    only_titles = q.select("query_id", F.concat(F.lit("title:("), "text", F.lit(")")).alias("text"))
    titled = S.ranked(only_titles, ix).select("query_id", "doc_id", F.lit(True).alias("hit"))
    ts = F.lit(_NOW - 86_400) - F.col("doc_id") % 90 * 43_200
    facts = p.select("doc_id", ts.alias("ts"), U.diversity_domain(F.col("url")).alias("domain"), U.authority(F.col("url")).alias("authority"))
    rows = R.fuse(R.floored(S.ranked(q, ix))).join(facts, "doc_id").join(titled, ["query_id", "doc_id"], "left")
    # factor by factor, as the statement multiplies: another order differs in the last bit, which rounding shows
    score = F.col("rrf") * R.freshness((F.lit(_NOW) - F.col("ts")).cast("double")) * (1 + 0.3 * F.col("authority")) * F.when(F.col("hit"), 2.0).otherwise(1.0)
    return R.diverse_top(rows.withColumn("score", score), "domain").select("query_id", "doc_id", "domain", "position", "score")


def page_index(spark, sf_dir):
    """The index of the pages' titles and contents."""
    source = load(spark, sf_dir, "pages")
    return S.index_of(spark, source, ingest.extract(spread(source)).withColumnRenamed("page_id", "doc_id"), _FIELDS, "pages")


# queries with every operator, made of the first words of a title; and which documents fit each, for the statement
_SHAPES = {
    "'+' || a || ' ' || b || ' -' || c": "a and not c",
    "'\"' || a || ' ' || b || '\" OR title:' || c": "ab or tc",
    "'(' || a || ' OR ' || b || ') AND ' || c": "(a or b) and c",
    "a || ' AND NOT ' || b": "a and not b",
    "'title:(+' || a || ' +' || b || ') content:' || c || '^2'": "(ta and tb) or kc",
    "'+(' || a || ' -' || b || ') +(' || b || ' ' || c || ')'": "(a and not b) and (b or c)",
    "'-' || a || ' NOT ' || b": "true",
    "'\"' || a || ' ' || b": "true",
}
_SHAPED = "case floor(query_id / 20) % 8 " + " ".join(f"when {i} then {text}" for i, text in enumerate(_SHAPES)) + " end"
_FITS = "case floor(query_id / 20) % 8 " + " ".join(f"when {i} then {fit}" for i, fit in enumerate(_SHAPES.values())) + " end"
_HOLDS = " ".join(f"(list_contains(tw, {w}) or list_contains(cw, {w})) as {w}, list_contains(tw, {w}) as t{w}, list_contains(cw, {w}) as k{w}," for w in "abc").replace(") as a,", ") as has_a,").replace(") as b,", ") as has_b,").replace(") as c,", ") as has_c,")


@query(
    "R1", "J1",
    sql=f"""with pgs as materialized ({_PAGES}), w as (select doc_id, {T.sql_words_of('title')} as tw, {T.sql_words_of('content')} as cw from pgs),
    q as (select doc_id as query_id, tw[1] as a, tw[2] as b, tw[3] as c from w where doc_id % 20 = 0 and len(tw) >= 3),
    h as (select query_id, doc_id, {_HOLDS} contains(' ' || array_to_string(tw, ' ') || ' ', ' ' || a || ' ' || b || ' ') or contains(' ' || array_to_string(cw, ' ') || ' ', ' ' || a || ' ' || b || ' ') as ab from q cross join w),
    f as (select query_id, doc_id from (select query_id, doc_id, has_a as a, has_b as b, has_c as c, ta, tb, tc, kc, ab from h) where {_FITS})
    select query_id, count(*)::bigint as found, min(doc_id) as first, sum(doc_id)::bigint as total from f where floor(query_id / 20) % 8 < 6 group by 1
    union all select query_id, 50, min(doc_id), sum(doc_id)::bigint from q join (select doc_id from w order by doc_id limit 50) on floor(query_id / 20) % 8 >= 6 group by 1""",
)
def search_syntax(spark, sf_dir):
    """What queries with operators, phrases, fields and groups find: how many pages, the first and the sum of their ids. Those that can't be parsed stand for all."""
    ix = page_index(spark, sf_dir)
    w = ix.docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), T.words_of(F.col("title")).alias("w")).where(F.size("w") >= 3)
    q = w.select("query_id", *(F.get("w", i).alias(c) for i, c in enumerate("abc"))).select("query_id", F.expr(_SHAPED).alias("text"))
    found = S.scores(q, ix)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("doc_id").alias("first"), F.sum("doc_id").alias("total"))


@query("R10", "R11", sql=f"""with {R.sql_search()}, {R.SQL_RANKED}, n as (select query_id, count(*) as n from topic group by 1),
    o as (select f.query_id, f.doc_id, count(p.term) as hits from floored f left join topic t using (query_id) left join post p on p.doc_id = f.doc_id and p.term = t.term group by 1, 2),
    s as (select f.*, case when n.n is null then 1.0 else o.hits / n.n::double end as overlap from floored f join o using (query_id, doc_id) left join n using (query_id))
    select query_id, doc_id, {sql_quantised("overlap")} as overlap, {sql_quantised("(0.5 + 0.5 * score / best) * (0.3 + 0.7 * overlap)")} as quality from s""")  # fmt: skip
def signal_quality(spark, sf_dir):
    """Of all retrieved pairs: the share of the query's distinctive words that the document has (1 if it has none), and the quality made of it."""
    terms = R.topics(asked(spark, sf_dir))
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    kept = retrieved(spark, sf_dir)
    # postings lie in the rows of their documents, of which only those of the lists are read on
    held = index(spark, sf_dir).lists.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.inline("counts")).select("term", "doc_id")
    hits = kept.select("query_id", "doc_id").join(terms, "query_id").join(held, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = kept.join(hits, ["query_id", "doc_id"], "left").join(sizes, "query_id", "left")
    overlap = F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n").cast("double"))
    return rows.select("query_id", "doc_id", quantised(overlap).alias("overlap"), quantised((0.5 + 0.5 * F.col("score") / F.col("best")) * (0.3 + 0.7 * overlap)).alias("quality"))


@query("R10", sql=f"""with {R.sql_search()}, {R.SQL_RANKED}, q as (select query_id, list_distinct({R.sql_distinctive('text')}) as t from qs), d as (select doc_id, ' ' || lower(content) as hay from ds)
    select query_id, doc_id, {sql_quantised("case when len(t) = 0 then 1 else len(list_filter(t, lambda w: contains(hay, ' ' || w || ' ') or contains(hay, w || '.') or contains(hay, w || ' '))) / len(t)::double end")} as overlap
    from floored join q using (query_id) join d using (doc_id)""")  # fmt: skip
def topic_overlap(spark, sf_dir):
    """Of all retrieved pairs: the share of the query's distinctive terms that the document has; 1 for a query without any."""
    asks = asked(spark, sf_dir)
    q = asks.select("query_id", F.array_distinct(R.distinctive(F.col("text"))).alias("t"))
    pairs = retrieved(spark, sf_dir).select("query_id", "doc_id")
    d = load(spark, sf_dir, "documents").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")  # the documents of the lists, no others
    rows = pairs.join(q, "query_id").join(d.select("doc_id", F.concat(F.lit(" "), F.lower("text")).alias("hay")), "doc_id")
    found = F.filter("t", lambda w: F.contains(F.col("hay"), F.concat(F.lit(" "), w, F.lit(" "))) | F.contains(F.col("hay"), F.concat(w, F.lit("."))) | F.contains(F.col("hay"), F.concat(w, F.lit(" "))))
    overlap = F.when(F.size("t") == 0, 1.0).otherwise(F.size(found) / F.greatest(F.size("t"), F.lit(1)).cast("double"))
    return rows.select("query_id", "doc_id", quantised(overlap).alias("overlap"))


@query("R8", "R9", sql=f"with o as (select o_orderkey, date_diff('second', o_orderdate, timestamp '1999-01-01') as age, 1 / (60.0::double + o_orderkey % 50) as s from orders) select o_orderkey, {sql_quantised('s * (1 + 0.5 * (604800.0 / (604800.0 + age)))')} as fresh, {sql_quantised('s * (1 + 0.3 * 0.5)')} as trusted from o where age >= 0")
def freshness_boost(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_diff("SECOND", F.col("o_orderdate"), F.lit("1999-01-01").cast("timestamp")).alias("age"), (1 / (60.0 + F.col("o_orderkey") % 50)).alias("s"))
    return o.where("age >= 0").select("o_orderkey", quantised(F.col("s") * R.freshness(F.col("age"))).alias("fresh"), quantised(F.col("s") * 1.15).alias("trusted"))


# half-lives in days by intent
HALF_LIVES = {"fresh": 0.25, "how_to": 7, "informational": 7, "comparison": 14, "technical": 30, "transactional": 30, "navigational": 90}
_INTENTS = "case event_id % 7 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(HALF_LIVES)) + " end"
_HALF = "case event_id % 7 " + " ".join(f"when {i} then {float(v)}" for i, v in enumerate(HALF_LIVES.values())) + " end"


@query("R15", sql=f"select event_id, {_INTENTS} as intent, {sql_quantised(f'pow(0.5, ((1706745600000000 - epoch_us(ts)) / 86400e6) / ({_HALF})::double)')} as weight from events")
def freshness_half_life(spark, sf_dir):
    age = F.expr("timestampdiff(MICROSECOND, ts, timestamp_ntz'2024-02-01 00:00:00')") / 86400e6  # as of 2024-02-01
    return load(spark, sf_dir, "events").select("event_id", F.expr(_INTENTS).alias("intent"), quantised(F.pow(F.lit(0.5), age / F.expr(_HALF).cast("double"))).alias("weight"))


_SCORED = "select doc_id, source, (doc_id * 7919 % 1000) / 1000.0::double as score, (doc_id * 104729 % 100) / 100.0::double as relevance from documents"


def scored(spark, sf_dir):
    d = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", "source", (d * 7919 % 1000 / F.lit(1000.0)).alias("score"), (d * 104729 % 100 / F.lit(100.0)).alias("relevance"))


@query("R16", sql=f"with s as ({_SCORED}), b as (select source, min(score) as lo, max(score) as hi from s group by 1) select doc_id, {sql_quantised('case when hi > lo then 0.05 + 0.95 * (score - lo) / (hi - lo) else 1.0 end')} as score from s join b using (source)")
def score_minmax(spark, sf_dir):
    s = scored(spark, sf_dir)
    bounds = s.groupBy("source").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = s.join(bounds, "source")
    return rows.select("doc_id", quantised(F.when(F.col("hi") > F.col("lo"), 0.05 + 0.95 * (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)).alias("score"))


@query("R17", sql=f"with s as ({_SCORED}) select doc_id, {sql_quantised('least(score, 0.6 + 0.4 * least(relevance / 0.9, 1))')} as score from s")
def merit_ceiling(spark, sf_dir):
    """A ceiling that rises with relevance (our own curve): it never lifts a score, relevance 0.9 keeps 1."""
    return scored(spark, sf_dir).select("doc_id", quantised(F.least(F.col("score"), 0.6 + 0.4 * F.least(F.col("relevance") / 0.9, F.lit(1.0)))).alias("score"))


@query("R19", sql=f"with {R.sql_search()}, n as (select query_id, count(*) as n from topic group by 1) select topic.query_id, doc_id, {sql_quantised('count(*) / max(n.n)::double')} as coverage from post join topic using (term) join n on n.query_id = topic.query_id group by 1, 2 having count(*) >= 2")
def constraint_coverage(spark, sf_dir):
    """The share of a query's distinctive words that a document has, for pairs with two or more."""
    terms = R.topics(asked(spark, sf_dir))
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = S.shared(terms, index(spark, sf_dir), 2)
    return hits.join(sizes, "query_id").select("query_id", "doc_id", quantised(F.col("score") / F.col("n").cast("double")).alias("coverage"))


@query("R14", sql=f"with s as ({_SCORED}) select doc_id, {sql_quantised('(0.45 * score + 0.25 * relevance + 0.1 * 0.5 + 0.1 * (doc_id % 3)) * (case when doc_id % 5 = 0 then 1.5 else 1.0 end)')} as score from s")
def multi_signal_score(spark, sf_dir):
    """Overlap, relevance, authority and consensus, times an intent boost; the weights are ours."""
    boost = F.when(F.col("doc_id") % 5 == 0, 1.5).otherwise(1.0)
    return scored(spark, sf_dir).select("doc_id", quantised((0.45 * F.col("score") + 0.25 * F.col("relevance") + 0.05 + 0.1 * (F.col("doc_id") % 3)) * boost).alias("score"))


@query("R20", sql=f"with s as (select *, doc_id % 6 = 0 as video from ({_SCORED})), w as (select source, min(score) filter (where not video) as weakest from s group by 1) select doc_id, {sql_quantised('case when video then least(score, coalesce(weakest, 1.0) * 0.99) else score end')} as score from s join w using (source)")
def video_pin(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("video", F.col("doc_id") % 6 == 0)
    weakest = s.where(~F.col("video")).groupBy("source").agg(F.min("score").alias("weakest"))
    rows = s.join(weakest, "source", "left")
    return rows.select("doc_id", quantised(F.when(F.col("video"), F.least(F.col("score"), F.coalesce("weakest", F.lit(1.0)) * 0.99)).otherwise(F.col("score"))).alias("score"))


@query("F9", sql="select page_id, url from pages where contains(url, '/en/') and regexp_matches(url, '^https?://[^/]*example[.](com|net)') and not contains(url, 'spam')")
def site_filter(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(F.contains("url", F.lit("/en/")) & F.rlike("url", F.lit("^https?://[^/]*example[.](com|net)")) & ~F.contains("url", F.lit("spam")))


def fail_open(rows, condition):
    """The rows that fit; all of them if none does."""
    flagged = rows.withColumn("_fit", condition)
    some = flagged.where("_fit").limit(1).count() > 0
    return (flagged.where("_fit") if some else flagged).drop("_fit")


_PARTS = ("/no-such-part/", "/en/")


@query("F9", sql=" union all ".join(f"select '{part}' as part, page_id, url from pages where not exists (select 1 from pages where contains(url, '{part}')) or contains(url, '{part}')" for part in _PARTS))
def inurl_fail_open(spark, sf_dir):
    """Pages with a part in their url: one that none has, so all stay, and one that some have."""
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    none, some = (fail_open(p, F.contains("url", F.lit(part))).select(F.lit(part).alias("part"), "page_id", "url") for part in _PARTS)
    return none.unionByName(some)


@query("F9", sql="select event_id, case when event_id % 4 = 0 then null else ts end as ts from events where event_id % 4 = 0 or (ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20')")
def date_bounds_fail_open(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("ts"))
    return e.where("ts is null or (ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20')")


@query("F9", sql="select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice >= 1000 and l_extendedprice < 2000")
def price_bounds(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").where("l_extendedprice >= 1000 and l_extendedprice < 2000").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("F10", "F13", sql=f"with s as (select doc_id, contains(lower(text), 'than') as hit, {sql_quantised('0.7 * (doc_id % 2) + 0.2 * (doc_id % 3 = 0)::int + 0.1 * (doc_id % 5 = 0)::int')} as alternative from documents) select doc_id, alternative from s where not hit or alternative > 0.3")
def hard_exclude(spark, sf_dir):
    """Excluded words drop a row unless it lists alternatives: title 70 %, url 20 %, content 10 %."""
    d = F.col("doc_id")
    score = quantised(0.7 * (d % 2) + 0.2 * (d % 3 == 0).cast("int") + 0.1 * (d % 5 == 0).cast("int"))
    rows = docs(spark, sf_dir).select("doc_id", F.contains(F.lower("text"), F.lit("than")).alias("hit"), score.alias("alternative"))
    return rows.where(~F.col("hit") | (F.col("alternative") > 0.3)).select("doc_id", "alternative")


@query("F11", "F12", sql=f"select doc_id, len(list_filter({T.sql_words_of('text')}, lambda w: w = 'the' or (length('the') >= 3 and starts_with(w, 'the') and length('the') >= 0.75 * length(w)))) > 0 as hit from documents")
def negative_token_match(spark, sf_dir):
    """A word is hit when it is the term, or a compound of which the term is at least three quarters."""
    w = T.words_of(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.exists(w, lambda x: (x == "the") | (F.startswith(x, F.lit("the")) & (F.lit(3) >= 0.75 * F.length(x)))).alias("hit"))


_GAPS = "select item_id as query_id, text || ' zygomatic' || item_id % 3 || ' photography' as text from benchmark"


@query("G19", sql=f"with {R.sql_search(_GAPS)} select query_id, term from topic where term not in (select term from post)")
def recall_gap(spark, sf_dir):
    """Distinctive words that no document has, of all passages with two more words each."""
    more = F.concat("text", F.lit(" zygomatic"), (F.col("query_id") % 3).cast("string"), F.lit(" photography"))
    terms = R.topics(asked(spark, sf_dir).withColumn("text", more))
    return terms.join(index(spark, sf_dir).terms.select("term"), "term", "left_anti").select("query_id", "term")


@query("L3", sql=f"with s as ({_SCORED}) select doc_id, {sql_quantised('score')} as score, (select count(*) from s)::bigint as total, 48 < (select count(*) from s) as has_more from (select * from s order by score desc, doc_id limit 24 offset 24)")
def paginate(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", quantised(F.col("score")).alias("score"))
    return R.page_of(rows, [F.desc("score"), "doc_id"], 24, 24)


# document queries over single rows
def _h(sql: str) -> str:
    return f"with e as (select *, {T.sql_entropy('text')} as h from documents) {sql}"


@query("T5", sql=f"select doc_id, {T.sql_bounded('text')} as bounded from documents")
def bound_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.bounded(F.col("text")).alias("bounded"))


@query("T6", sql=f"select doc_id, {T.sql_fingerprint('source', 'text')} as fingerprint from documents")
def content_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))


_EMPTY = chr(39) * 2


@query("L9", "T6", sql=f"select fp as fingerprint, min(doc_id) as doc_id, count(*)::bigint as copies from (select doc_id, {T.sql_fingerprint(_EMPTY, 'text')} as fp from documents) group by 1")
def fingerprint_dedup(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.fingerprint(F.lit(""), F.col("text")).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("T7", sql=_h(f"select doc_id, {sql_quantised('h')} as entropy from e"))
def char_entropy(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", quantised(T.entropy(F.col("text"))).alias("entropy"))


@query("T8", sql=f"select doc_id, {sql_quantised(T.sql_alpha_ratio('text'))} as ratio from documents")
def alpha_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", quantised(T.alpha_ratio(F.col("text"), T.measures(F.col("text")))).alias("ratio"))


@query("T9", sql=_h(f"select doc_id, {sql_quantised(T.sql_quality_from('text', 'h'))} as quality from e"))
def content_quality(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("m", T.measures(F.col("text")))
    return d.select("doc_id", quantised(T.quality_from(F.col("text"), F.col("m"))).alias("quality"))


@query("F1", sql=_h(f"select doc_id, {T.sql_indexworthy('source', 'text', 'h')} as worthy from e"))
def indexworthy(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("m", T.measures(F.col("text")))
    return d.select("doc_id", T.indexworthy(F.col("source"), F.col("text"), F.col("m")).alias("worthy"))


_JUNK = ("Video Item Preview", "a b c", " ")
_JUDGED = "select doc_id, text as t from documents union all select -1 - i, t from (values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_JUNK)) + ") j(i, t)"


@query("F2", "F3", sql=f"select doc_id, {P.sql_junk('t')} as junk, {P.sql_junk('t', 'doc_id % 2 = 0')} as junk_lenient from ({_JUDGED})")
def junk_filter(spark, sf_dir):
    """Every document, and three texts that are junk."""
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("t")).unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_JUNK)], "doc_id long, t string"))
    return d.select("doc_id", P.junk(F.col("t")).alias("junk"), P.junk(F.col("t"), F.col("doc_id") % 2 == 0).alias("junk_lenient"))


@query("T16", sql=f"select doc_id, {T.sql_truncated('source || chr(32) || left(regexp_replace(text, chr(91) || chr(94) || chr(92) || chr(120) || chr(48) || chr(48) || chr(45) || chr(92) || chr(120) || chr(55) || chr(70) || chr(93), chr(48), chr(103)), 400)', 180)} as short from documents")
def truncate_words(spark, sf_dir):
    ascii_text = F.concat("source", F.lit(" "), F.left(F.regexp_replace("text", r"[^\x00-\x7F]", "0"), F.lit(400)))
    return docs(spark, sf_dir).select("doc_id", T.truncated(ascii_text, 180).alias("short"))


@query("T17", sql=f"select doc_id, array_to_string({T.sql_points('text')}, '|') as points from documents")
def split_points(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.points(F.col("text")), "|").alias("points"))


@query("T18", sql="select doc_id, case when strlen(text) > 500 then left(text, 500) else text end as snippet from documents")
def snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("G5", sql="with r as (select source, n_chars, row_number() over (partition by source order by doc_id desc) as r from documents), s as (select source, list_sort(list(n_chars)) as v from r where r <= 300 group by 1) select source, (case when len(v) < 16 then 3000 else greatest(2000, least(6500, v[least(floor(len(v) * 0.9), len(v) - 1)::int + 1])) end)::bigint as cap from s")
def content_cap_p90(spark, sf_dir):
    """The value at index floor(0.9 n) of the last 300 lengths of every source; all others are dropped before the shuffle."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    last = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))).where("r <= 300")
    v = last.groupBy("source").agg(F.array_sort(F.collect_list("n_chars")).alias("v"))
    at = F.get("v", F.least(F.floor(F.size("v") * 0.9), F.size("v") - 1).cast("int"))
    return v.select("source", F.when(F.size("v") < 16, 3000).otherwise(F.greatest(F.lit(2000), F.least(F.lit(6500), at))).cast("long").alias("cap"))


@query("W9", sql="select doc_id, count(*) over w::bigint as n, max(n_chars) over w as longest from documents window w as (partition by source order by doc_id rows between 299 preceding and current row)")
def rolling_length(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(-299, 0)
    return docs(spark, sf_dir).select("doc_id", F.count(F.lit(1)).over(w).alias("n"), F.max("n_chars").over(w).alias("longest"))


@query("L10", "L11", "J13", sql=f"with a as (select distinct unnest({T.sql_words_of('text')}) as w from benchmark where item_id % 2 = 0), b as (select distinct unnest({T.sql_words_of('text')}) as w from benchmark where item_id % 2 = 1) select w, 'both' as side from (select w from a intersect select w from b) union all select w, 'left' from (select w from a except select w from b)")
def common_terms(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select("item_id", F.explode(T.words_of(F.col("text"))).alias("w"))
    left, right = b.where("item_id % 2 = 0").select("w"), b.where("item_id % 2 = 1").select("w")
    return left.intersect(right).withColumn("side", F.lit("both")).unionByName(left.subtract(right).withColumn("side", F.lit("left")))

"""Cleaning, structured-data prices, naming questions, phase texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions import text as T
from searchlake.functions.dialect import quoted, sql_list
from searchlake.operators import cleaning as C
from searchlake.session import load, spread


@query("T1", "T2", "T3", "T4")
def clean_content(spark, sf_dir):
    p = spread(load(spark, sf_dir, "pages")).select("page_id", "html", T.page_title(F.col("html")).alias("title"))
    return C.clean(p, "html", "title").select("page_id", "content")


_ECHO = "case page_id % 3 when 0 then upper(title) || ' - ' || 'body of ' || page_id when 1 then title else 'Other text ' || title end"
_TITLES = "select page_id, 'A steady title of page number ' || page_id as title from pages"


@query("T4", sql=f"select page_id, case page_id % 3 when 0 then 'body of ' || page_id when 1 then '' else 'Other text ' || title end as body from ({_TITLES})")
def title_echo(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("A steady title of page number "), F.col("page_id").cast("string")).alias("title"))
    return p.withColumn("c", F.expr(_ECHO)).select("page_id", C.title_echo(F.col("c"), F.col("title")).alias("body"))


_OFFER = "case page_id % 4 when 0 then '<script type=\"application/ld+json\">{\"@type\":\"Product\",\"offers\":[{\"price\":\"1,0' || page_id || '.5\",\"priceCurrency\":\"EUR\"}]}</script>' when 1 then '<span itemprop=\"price\" content=\"' || page_id || '\">x</span><meta itemprop=\"priceCurrency\" content=\"GBP\">' when 2 then '<p>only 5 dollars</p>' else html end"


@query("T15", "C4", sql="select page_id, case page_id % 4 when 0 then ('10' || page_id || '.5')::double else page_id::double end as price, case page_id % 4 when 0 then 'EUR' else 'GBP' end as currency from pages where page_id % 4 < 2")
def page_prices(spark, sf_dir):
    return C.page_prices(load(spark, sf_dir, "pages").select("page_id", F.expr(_OFFER).alias("html")), "page_id")


_FACTS = ("Now 19.99 USD in stock", "Price: $5", "sold out of stock", "no facts at all")
_SNIPPETS = "select doc_id, text as s from documents union all select -1 - i, s from (values " + ", ".join(f"({i}, {quoted(s)})" for i, s in enumerate(_FACTS)) + ") f(i, s)"


@query("C5", sql=f"select doc_id, try_cast(coalesce(nullif(regexp_extract(s, '([0-9]+[.][0-9]+) USD', 1), ''), nullif(regexp_extract(s, '[$]([0-9]+)', 1), '')) as double) as price, case when regexp_matches(s, '[0-9]+[.][0-9]+ USD|[$][0-9]') or regexp_matches(lower(s), '\\b(in stock|out of stock)\\b') then 'snippet_extracted' end as source from ({_SNIPPETS})")
def snippet_prices(spark, sf_dir):
    """Every snippet is searched; one without a price or an availability (documents have no titles, so no names) has no source."""
    d = spread(load(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("s"))
    d = d.unionByName(spark.createDataFrame([(-1 - i, s) for i, s in enumerate(_FACTS)], "doc_id long, s string"))
    stock = F.rlike(F.lower("s"), F.lit(r"\b(in stock|out of stock)\b"))
    found = F.coalesce(F.nullif(F.regexp_extract("s", "([0-9]+[.][0-9]+) USD", 1), F.lit("")), F.nullif(F.regexp_extract("s", "[$]([0-9]+)", 1), F.lit("")))
    return d.select("doc_id", found.cast("double").alias("price"), F.when(found.isNotNull() | stock, "snippet_extracted").alias("source"))


_ASK = "case doc_id % 4 when 0 then 'why is the apache web server named after a helicopter' when 1 then 'where does the name ford come from' when 2 then 'how to make biryani at home' else 'best keyboard' end"
_HEAD = "case doc_id % 2 when 0 then 'What famous helicopter was named for its marker?' else 'Where-named history' end"


@query("R18", sql=f"with d as (select doc_id, {_ASK} as q, {_HEAD} as t from documents) select doc_id, doc_id % 4 < 2 as naming, case when doc_id % 4 = 0 then 0.45::double when doc_id % 4 = 1 then 0.45::double else 0.9::double end as score from d")
def naming_questions(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(_ASK).alias("q"), F.expr(_HEAD).alias("t"))
    return d.select("doc_id", C.naming_question(F.col("q")).alias("naming"), C.naming_score(F.col("q"), F.col("t"), F.lit(0.9)).alias("score"))


_GOALS = ("Write a fantasy novel", "Learn AI")


@query(
    "M2",
    sql=f"""with g as (select distinct regexp_replace(text, '[^\\x00-\\x7F]', 'o', 'g') as goal from conversations where role = 'user' union select unnest([{', '.join(quoted(g) for g in _GOALS)}])),
    w as (select goal, list_filter(regexp_split_to_array(lower(goal), '[^\\p{{L}}\\p{{N}}]+'), lambda w: (length(w) >= 3 or w in {sql_list(C.SHORT)}) and w not in {sql_list(C.TOPIC_STOPS)}) as w from g),
    t as (select goal, case when len(w) > 0 then array_to_string(w, ' ') else goal end as topic, unnest([1, 2, 3, 4]) as phase from w)
    select goal, phase, case phase when 1 then 'Phase 1: Plan & Begin ' when 4 then 'Phase 4: Finish & Review ' else 'Phase ' || phase || ': Build ' end || chr(39) || {T.sql_truncated('goal', 85)} || chr(39) as title,
    case phase when 1 then 'foundation' when 4 then 'completion' else 'progress' end as kind,
    'Define the scope and success criteria for ' || chr(39) || topic || chr(39) || '. Set up the foundation before building ' || chr(39) || topic || chr(39) || '.' as objectives from t""",
)
def phase_content(spark, sf_dir):
    """The phases of every text that a user has written (in ASCII, where both engines cut alike), and of two goals in plain words."""
    said = load(spark, sf_dir, "conversations").where("role = 'user'").select(F.regexp_replace("text", r"[^\x00-\x7F]", "o").alias("goal"))
    return C.phase_titles(said.unionByName(spark.createDataFrame([(g,) for g in _GOALS], "goal string")).distinct())


@query("G20", sql="select count(distinct source)::bigint as sources, count(distinct lang)::bigint as languages, count(distinct text)::bigint as texts from documents")
def distinct_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"), F.countDistinct("text").alias("texts"))


@query("S21", sql="select page_id::varchar as title, url, null::varchar as description from pages")
def news_columns(spark, sf_dir):
    from searchlake.sources import readers

    hits = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("title"), "url")
    return readers.media(hits, "news").select("title", "url", "description")

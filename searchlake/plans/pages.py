"""Queries over crawled pages: URL identity and kinds, extraction, filters, frontier, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions import html
from searchlake.functions import predicates as P
from searchlake.functions import text as T
from searchlake.functions import url as U
from searchlake.functions.dialect import quantised, sql_any, sql_quantised
from searchlake.operators import ingest
from searchlake.session import load, spread


def pages(spark, sf_dir):
    return spread(load(spark, sf_dir, "pages"))


@query("U1", "U2", "O1", sql=f"select page_id, {U.sql_canonical('url')} as canonical from pages")
def url_canonical(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical"))


_WRAPPED = "case page_id % 3 when 0 then 'https://web.archive.org/web/2020010' || page_id || '/' || url when 1 then 'https://web.archive.org/web/3/https%3A%2F%2Fexample.com%2Fa%2Bb%2F' || page_id else url end"


@query("U1", "U2", sql=f"select page_id, {U.sql_canonical('w')} as canonical from (select page_id, {_WRAPPED} as w from pages)")
def url_canonical_archived(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_WRAPPED).alias("w")).select("page_id", U.canonical(F.col("w")).alias("canonical"))


@query("U3", sql=f"select page_id, {U.sql_crawl_key('url')} as crawl_key from pages")
def url_normalized(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.crawl_key(F.col("url")).alias("crawl_key"))


_ODD = "case page_id % 4 when 0 then 'https://user:pw@' || substr(url, 9) when 1 then replace(url, '.com/', '.com.:8080/') when 2 then substr(url, 9) else url end"


@query("U4", sql=f"select page_id, {U.sql_bare_host('u')} as host from (select page_id, {_ODD} as u from pages)")
def url_host(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_ODD).alias("u")).select("page_id", U.bare_host(F.col("u")).alias("host"))


@query("U5", sql=f"select page_id, {U.sql_diversity_domain('url')} as domain from pages")
def result_domain(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.diversity_domain(F.col("url")).alias("domain"))


_PATHED = "url || case page_id % 8 when 0 then '/docs/x' when 1 then '/forum/y' when 2 then '/product/z' when 3 then '/paper/q' when 4 then '/article/r' when 5 then '/wiki/v1.2/s' when 6 then '/world/election' else '' end"


@query("U6", sql=f"select page_id, {U.sql_content_type('u')} as kind from (select page_id, {_PATHED} as u from pages)")
def content_type(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_PATHED).alias("u")).select("page_id", U.content_type(F.col("u")).alias("kind"))


@query(
    "U7", "F16", "X5",
    sql=f"""with p as (select page_id, {U.sql_content_type('url')} as kind, cast(page_id * 977 % 100000 as bigint) as age from pages)
    select page_id, kind, age, 0.3::double as priority from p where age > {U.sql_refresh_seconds('kind')}""",
)
def refresh_due(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", U.content_type(F.col("url")).alias("kind"), (F.col("page_id") * 977 % 100000).alias("age"))
    return p.where(F.col("age") > U.refresh_seconds(F.col("kind"))).withColumn("priority", F.lit(0.3))


@query("U8", sql=f"select page_id, {sql_quantised(U.sql_authority('u'))} as authority from (select page_id, {_PATHED} as u from pages)")
def domain_authority(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_PATHED).alias("u")).select("page_id", quantised(U.authority(F.col("u"))).alias("authority"))


@query("U9", sql=f"select page_id, {sql_any('lower(u)', U.NEWS_MARKS)} as news from (select page_id, {_PATHED} as u from pages)")
def news_path(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_PATHED).alias("u")).select("page_id", U.news_path(F.col("u")).alias("news"))


_SCHOLAR = "case page_id % 5 when 0 then 'https://arxiv.org/abs/' || page_id when 1 then 'https://export.arxiv.org/' || page_id when 2 then 'https://notarxiv.org/' || page_id else url end"


@query("U10", sql=f"select page_id, {U.sql_academic('u')} as academic from (select page_id, {_SCHOLAR} as u from pages)")
def academic_host(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_SCHOLAR).alias("u")).select("page_id", U.academic(F.col("u")).alias("academic"))


_SHOP = "case page_id % 5 when 0 then 'example-merchant.com' when 1 then 'testosterone-shop.com' when 2 then 'foo.test.' when 3 then 'notexample.com' else split_part(url, '/', 3) end"


@query("U11", sql=f"select page_id, {U.sql_reserved_host('h')} as reserved from (select page_id, {_SHOP} as h from pages)")
def reserved_host(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_SHOP).alias("h")).select("page_id", U.reserved_host(F.col("h")).alias("reserved"))


_RESOURCE = "case page_id % 6 when 0 then 'https://github.com/a/b' when 1 then 'https://www.coursera.org/x' when 2 then 'https://youtu.be/x' when 3 then url || '/docs/x' when 4 then 'https://arxiv.org/abs/1' else url end"


@query("U16", sql=f"select page_id, {U.sql_resource_kind('u')} as kind from (select page_id, {_RESOURCE} as u from pages)")
def resource_type(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_RESOURCE).alias("u")).select("page_id", U.resource_kind(F.col("u")).alias("kind"))


@query("U13", sql=f"select page_id, {sql_any(U.sql_parsed_host('u'), U.VIDEO_HOSTS)} as video from (select page_id, {_RESOURCE} as u from pages)")
def video_host(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_RESOURCE).alias("u")).select("page_id", U.video_host(F.col("u")).alias("video"))


@query("T11", sql=f"select page_id, {T.sql_page_title('html')} as title from pages")
def page_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.page_title(F.col("html")).alias("title"))


@query("T10", "S1", sql=f"select page_id, main_text, cast(length(main_text) as integer) as n_chars from (select page_id, {T.sql_main_text('html')} as main_text from pages)")
def page_main_text(spark, sf_dir):
    e = html.extracted(pages(spark, sf_dir), keep=("page_id",), want=("content",))
    return e.select("page_id", F.col("content").alias("main_text"), F.length("content").alias("n_chars"))


@query("T19", sql=f"select page_id, {T.sql_decoded('html')} as decoded from pages")
def entity_decode(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.decoded(F.col("html")).alias("decoded"))


@query("U12", sql=ingest.sql_links("pages"))
def page_links(spark, sf_dir):
    return ingest.page_links(pages(spark, sf_dir))


@query("S3", "J6", "X4", sql=f"""with l as ({ingest.sql_links("pages")}), seen as (select {U.sql_crawl_key('url')} as k from pages where page_id % 2 = 0),
    fresh as (select page_id, link, pos, {U.sql_crawl_key('link')} as k from l),
    new as (select page_id, k, min(pos) as pos from fresh where k not in (select k from seen) group by 1, 2),
    few as (select page_id, k, row_number() over (partition by page_id order by pos, k) as r from new)
    select k as url, 0.7::double as priority, 'discovered' as source, min(page_id) as found_on from few where r <= 5 group by k""")  # fmt: skip
def frontier_new_urls(spark, sf_dir):
    p = pages(spark, sf_dir)
    seen = p.where("page_id % 2 = 0").select(U.crawl_key(F.col("url")).alias("k"))
    return ingest.discover(ingest.page_links(p), seen)


@query("S4", sql=f"select count(*)::bigint as queue_size, count(distinct {U.sql_crawl_key('url')})::bigint as seen from pages")
def frontier_status(spark, sf_dir):
    return pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("queue_size"), F.countDistinct(U.crawl_key(F.col("url"))).alias("seen"))


@query("L4", sql="select page_id, priority, r from (select page_id, priority, row_number() over (order by priority desc, page_id)::integer as r from (select page_id, (page_id * 37 % 11) / 10.0::double as priority from pages)) where r <= 30")
def frontier_pop(spark, sf_dir):
    queue = pages(spark, sf_dir).select("page_id", (F.col("page_id") * 37 % 11 / F.lit(10.0)).alias("priority"))
    top = queue.orderBy(F.desc("priority"), "page_id").limit(30)  # as many as a batch takes
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("priority"), "page_id")))


_VERSIONS = "select page_id % 100 as key, page_id as seq, url, 0.5::double as authority from pages"


@query("S6", "S7", "W3", sql=f"with v as ({_VERSIONS}) select key, seq, url, authority from (select *, row_number() over (partition by key order by seq desc) as r from v) where r = 1")
def ingest_upsert(spark, sf_dir):
    versions = pages(spark, sf_dir).select((F.col("page_id") % 100).alias("key"), F.col("page_id").alias("seq"), "url", F.lit(0.5).alias("authority"))
    return ingest.upsert(versions.where("seq % 2 = 0"), versions.where("seq % 2 = 1"), "key", "seq")


@query("S7", sql="select page_id, url from pages where page_id % 2 = 0 union all select page_id, url from pages where page_id % 3 = 0")
def ingest_append(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "url")
    return p.where("page_id % 2 = 0").unionByName(p.where("page_id % 3 = 0"))


@query("S9", sql="select url, page_id as ts from pages where url <> '' order by page_id, url limit 1000")
def url_listing(spark, sf_dir):
    return pages(spark, sf_dir).where("url <> ''").select("url", F.col("page_id").alias("ts")).orderBy("ts", "url").limit(1000)


@query("S10", "G21", sql="select count(*)::bigint as documents, sum(strlen(html))::bigint as bytes, (floor(sum(strlen(html)) / 1048576.0 * 100 + 0.5) / 100)::double as megabytes from pages")
def index_stats(spark, sf_dir):
    p = pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))
    return p.withColumn("megabytes", (F.floor(F.col("bytes") / 1048576.0 * 100 + 0.5) / 100).cast("double"))


@query("S11", "S12", sql="select url, 'No Title' as title, page_id as ts, 0.5::double as authority from pages where url <> ''")
def schema_migration(spark, sf_dir):
    old = pages(spark, sf_dir).select("url", F.lit("No Title").alias("title"), F.col("page_id").alias("ts"), F.lit(0.5).alias("authority"), F.lit(1.0).alias("price"), F.array(F.lit(1.0)).alias("embedding"))
    return ingest.migrate(old)


_EXTRACTED = f"select page_id, url, {T.sql_page_title('html')} as title, {T.sql_main_text('html')} as content from pages"


@query("F1", "S1", sql=f"with e as ({_EXTRACTED}), h as (select *, {T.sql_entropy('content')} as h from e) select page_id, {T.sql_indexworthy('title', 'content', 'h')} as worthy from h")
def indexworthy_pages(spark, sf_dir):
    e = ingest.extract(pages(spark, sf_dir))
    return e.withColumn("m", T.measures(F.col("content"))).select("page_id", T.indexworthy(F.col("title"), F.col("content"), F.col("m")).alias("worthy"))


@query("S1", "S6", "S8", sql=f"""with e as ({_EXTRACTED}), h as (select *, {T.sql_entropy('content')} as h from e)
    select url, title, content, {sql_quantised(U.sql_authority('url'))} as authority, {sql_quantised(T.sql_quality_from('content', 'h'))} as quality, {U.sql_content_type('url')} as content_type
    from h where {T.sql_indexworthy('title', 'content', 'h')}""")  # fmt: skip
def crawl_to_index(spark, sf_dir):
    e = ingest.extract(pages(spark, sf_dir)).withColumn("m", T.measures(F.col("content")))
    e = e.where(T.indexworthy(F.col("title"), F.col("content"), F.col("m")))
    return e.select(
        "url", "title", "content", quantised(U.authority(F.col("url"))).alias("authority"),
        quantised(T.quality_from(F.col("content"), F.col("m"))).alias("quality"), U.content_type(F.col("url")).alias("content_type"),
    )


@query("S2", sql=f"select page_id, {T.sql_one_shot('html')} as content from pages")
def one_shot_crawl(spark, sf_dir):
    """The text of the first selector with over 200 bytes, white space as it is, at most 5000 characters."""
    return html.extracted(pages(spark, sf_dir), keep=("page_id",), want=("one_shot",)).withColumnRenamed("one_shot", "content")


# a page's own html with the mark of a date in front, and its url with a date in it
_META = ("property=\"article:published_time\"", "property=\"article:modified_time\"", "name=\"datePublished\"", "name=\"date\"", "name=\"DC.date\"", "name=\"dcterms.modified\"", "itemprop=\"datePublished\"")


def _marked(day: str, other: str) -> str:
    """A mark by page_id: each of the seven metas, a time element, or none; the third in four has another, later meta too, which counts less."""
    metas = " ".join(f"when {i} then '<meta {m} content=\"' || {day} || 'T08:00:00Z\">'" for i, m in enumerate(_META))
    return f"case page_id % 12 {metas} when 7 then '<body><time datetime=\"' || {day} || '\">today</time>' else '' end || case when page_id % 4 = 2 then '<meta itemprop=\"datePublished\" content=\"{other}\">' else '' end"


def _dated(day: str) -> str:
    return f"case page_id % 12 when 8 then url || '/' || replace({day}, '-', '/') || '/' when 9 then url || '/' || replace(left({day}, 7), '-', '/') || '/x' when 10 then url || '?on=' || {day} else url end"


_OTHER = 20 + 31 * 365  # day 20 of January 2001 in rough days, less the years to 1970
_ROUGH = f"case when y between 2000 and 2030 and m between 1 and 12 and d between 1 and 31 then ((y - 1970) * 365 + (m - 1) * 30 + d) * 86400 end"


@query("T12", "T13", sql=f"""with p as (select page_id, page_id % 12 as mark, page_id % 4 = 2 as two, 1999 + page_id % 33 as y, 1 + page_id % 13 as m, 1 + page_id % 32 as d from pages),
    r as (select *, {_ROUGH} as rough, case when y between 2000 and 2030 and m between 1 and 12 then ((y - 1970) * 365 + (m - 1) * 30 + 1) * 86400 end as month from p)
    select page_id, coalesce(cast(case when mark <= 6 then coalesce(rough, case when two and mark < 6 then {_OTHER} * 86400 end) when two then {_OTHER} * 86400 when mark = 9 then month when mark in (7, 8, 10) then rough end as bigint), -1) as published from r""")  # fmt: skip
def publication_date(spark, sf_dir):
    """Pages with dates in metas, time elements and urls, some of them out of bounds: the rough seconds of the first that counts, else -1."""
    day = F.format_string("%04d-%02d-%02d", 1999 + F.col("page_id") % 33, 1 + F.col("page_id") % 13, 1 + F.col("page_id") % 32)
    marked = F.concat(F.expr(_marked("day", "2001-01-20")), "html").alias("html")
    rows = pages(spark, sf_dir).select("page_id", "url", "html", day.alias("day")).select("page_id", F.expr(_dated("day")).alias("url"), marked)
    found = html.extracted(rows, want=("dates",))
    return found.select("page_id", F.coalesce(T.publication(F.col("dates"), F.col("url")), F.lit(-1).cast("long")).alias("published"))


_TITLED = "case page_id % 7 when 0 then 'free porn' when 1 then 'Adult Education in Essex' when 2 then '150 funny jokes' when 3 then 'apple | meaning' when 4 then 'Top 10 java frameworks' when 5 then 'cheap essay services' else 'Plain page' end"
_LINKED = "case page_id % 7 when 6 then url || '/adult-games/' else url end"


@query("F4", sql=f"select page_id, {P.sql_adult('t', 'u')} as adult from (select page_id, {_TITLED} as t, {_LINKED} as u from pages)")
def family_filter(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_TITLED).alias("t"), F.expr(_LINKED).alias("u")).select("page_id", P.adult(F.col("t"), F.col("u")).alias("adult"))


@query("F5", sql=f"select page_id, {P.sql_definition_page('t', 'c')} as definition from (select page_id, {_TITLED} as t, case when page_id % 2 = 0 then 'noun. a thing' else html end as c from pages)")
def definition_page(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", F.expr(_TITLED).alias("t"), F.expr("case when page_id % 2 = 0 then 'noun. a thing' else html end").alias("c"))
    return p.select("page_id", P.definition_page(F.col("t"), F.col("c")).alias("definition"))


@query("F6", "F7", sql=f"select page_id, {P.sql_listicle('t', 'html', 'url')} as listicle, regexp_matches(lower(t), '{P.TOP_N}') as top_n from (select *, {_TITLED} as t from pages)")
def listicle(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("t", F.expr(_TITLED))
    return p.select("page_id", P.listicle(F.col("t"), F.col("html"), F.col("url")).alias("listicle"), F.rlike(F.lower("t"), F.lit(P.TOP_N)).alias("top_n"))


@query("F8", sql=f"select page_id, {P.sql_spam('t', 'url')} as spam from (select *, {_TITLED} as t from pages)")
def spam_resource(spark, sf_dir):
    return pages(spark, sf_dir).withColumn("t", F.expr(_TITLED)).select("page_id", P.spam(F.col("t"), F.col("url")).alias("spam"))


@query("G8", sql=f"select {U.sql_diversity_domain('url')} as domain, count(*)::bigint as n from pages group by 1")
def domain_counts(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.diversity_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("W2", "R12", sql=f"select page_id, domain, r from (select page_id, domain, row_number() over (partition by domain order by score desc, page_id)::integer as r from (select page_id, {U.sql_diversity_domain('url')} as domain, page_id * 31 % 97 as score from pages)) where r <= 3")
def domain_diversity(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", U.diversity_domain(F.col("url")).alias("domain"), (F.col("page_id") * 31 % 97).alias("score"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "page_id"))).where("r <= 3").select("page_id", "domain", "r")


@query("T12", "T13", sql="select page_id, case when y between 2000 and 2030 and m between 1 and 12 and d between 1 and 31 then cast(((y - 1970) * 365 + (m - 1) * 30 + d) * 86400 as bigint) else -1 end as published from (select page_id, 1995 + page_id % 40 as y, 1 + page_id % 13 as m, 1 + page_id % 31 as d from pages)")
def epoch_compat(spark, sf_dir):
    date = F.format_string("%04d-%02d-%02dT00:00:00Z", 1995 + F.col("page_id") % 40, 1 + F.col("page_id") % 13, 1 + F.col("page_id") % 31)
    return pages(spark, sf_dir).select("page_id", F.coalesce(T.rough_epoch(date), F.lit(-1).cast("long")).alias("published"))


@query("T13", sql="select page_id, cast(epoch(make_date(2000 + (page_id % 30)::int, 1 + (page_id % 12)::int, 1 + (page_id % 28)::int)) as bigint) as published from pages")
def epoch_exact(spark, sf_dir):
    date = F.format_string("%04d-%02d-%02d", 2000 + F.col("page_id") % 30, 1 + F.col("page_id") % 12, 1 + F.col("page_id") % 28)
    return pages(spark, sf_dir).select("page_id", T.exact_epoch(date).alias("published"))


_MONEY = "case page_id % 8 when 0 then 'US$ 5' when 1 then 'C$ CAD' when 2 then 'AUD $' when 3 then '20 Euro' when 4 then '£9' when 5 then 'Rs. 40' when 6 then '100 yen' else 'free' end"


@query("T14", sql=f"select page_id, {T.sql_currency('m')} as currency from (select page_id, {_MONEY} as m from pages)")
def currency_code(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(_MONEY).alias("m")).select("page_id", T.currency(F.col("m")).alias("currency"))


@query("J5", "L9", sql=f"select k as canonical, min(page_id) as page_id, count(*)::bigint as copies from (select page_id, {U.sql_canonical('url')} as k from pages) group by 1")
def merge_by_canonical(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical"))
    return p.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies"))


@query("S18", "L8", "G9", "J5", sql=f"""with hits as (select {U.sql_canonical('url')} as k, 'a' as engine, 1.0::double as score from pages where page_id % 2 = 0
    union all select {U.sql_canonical('url')}, 'b', 0.8::double from pages where page_id % 3 = 0 union all select {U.sql_canonical('url')}, 'c', 0.6::double from pages where page_id % 5 = 0)
    select k as canonical, count(distinct engine)::bigint as sources, string_agg(distinct engine, ',' order by engine) as engines, {sql_quantised("max(score) + 0.1 * (count(distinct engine) - 1)")} as score from hits group by 1""")  # fmt: skip
def source_consensus(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical"))
    parts = [p.where(f"page_id % {m} = 0").select("canonical", F.lit(e).alias("engine"), F.lit(s).alias("score")) for m, e, s in ((2, "a", 1.0), (3, "b", 0.8), (5, "c", 0.6))]
    hits = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = hits.groupBy("canonical").agg(F.array_sort(F.collect_set("engine")).alias("e"), F.max("score").alias("s"))  # a handful of engines
    return out.select("canonical", F.size("e").cast("long").alias("sources"), F.array_join("e", ",").alias("engines"), quantised(F.col("s") + 0.1 * (F.size("e") - 1)).alias("score"))


@query("U14", sql="select page_id from pages where regexp_matches(url, '//(m|www)[.]')")
def audio_surfaces(spark, sf_dir):
    marks = spark.createDataFrame([("//m.",), ("//www.",)], "mark string")
    p = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "(//[a-z]+[.])", 1).alias("mark"))
    return p.join(marks, "mark", "left_semi").select("page_id")


@query("S5", sql="select url, 'seed' as source, 0.5::double as priority from (values ('https://docs.example.org/'), ('https://news.example.org/')) t(url) where url not in (select url from pages)")
def seed_urls(spark, sf_dir):
    return ingest.seeds(spark, ["https://docs.example.org/", "https://news.example.org/"], pages(spark, sf_dir).select("url"))

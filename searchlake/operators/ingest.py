"""Page extraction, links, frontier and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlake.functions import html
from searchlake.functions import url as U
from searchlake.functions.dialect import has_any, sql_any

# fixed values: what a link may not hold
SKIPPED = (".pdf", ".zip", ".tar", ".gz", ".exe", ".dmg", ".jpg", ".png", ".gif", ".svg", ".css", ".js", "#", "javascript:", "mailto:")
_HREF = r"<a\s[^>]*href=[\"']([^\"']*)[\"']"
# for the statement: the pages' references are absolute or begin with a slash
_ORIGIN = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def extract(pages: DataFrame, cap: int = 6500) -> DataFrame:
    """page_id, url, title, content."""
    return html.extracted(pages, want=("title", "content"), cap=cap)


def once(value: Column) -> Column:
    """A value as a generator's only row: what uses it reads it, and no filter or projection computes it again."""
    return F.explode(F.array(value))


def page_links(pages: DataFrame) -> DataFrame:
    """http links of every page (page_id, link, pos), resolved against its url, the first place of each; null for a url that is no base."""
    out = html.extracted(pages, want=("hrefs",)).withColumn("base", U.url_parts(F.col("url"))).where("base.scheme is not null")
    out = out.select("page_id", "base", F.posexplode("hrefs").alias("pos", "href")).withColumn("ref", U.url_parts(F.trim(F.regexp_replace("href", r"[\t\n\r]", ""))))
    out = out.select("page_id", "pos", once(U.resolved(F.col("base"), F.col("ref"))).alias("link"))
    out = out.where(F.rlike("link", F.lit("(?i)^https?://")) & ~has_any(F.lower("link"), SKIPPED)).withColumn("k", U.crawl_key(F.col("link")))
    return out.groupBy("page_id", "k").agg(F.min(F.struct("pos", "link")).alias("f")).select("page_id", "f.link", F.col("f.pos").cast("integer").alias("pos"))


def sql_links(table: str) -> str:
    quote = chr(39)
    href = _HREF.replace(quote, quote * 2)
    return f"""select page_id, link, pos from (select page_id, link, pos, row_number() over (partition by page_id, {U.sql_crawl_key('link')} order by pos) as r from (
        select page_id, pos, case when regexp_matches(href, '^https?://') then href when starts_with(href, '/') then origin || href end as link from (
        select page_id, regexp_extract(url, '{_ORIGIN}', 1) as origin, unnest(hrefs) as href, cast(unnest(range(len(hrefs))) as integer) as pos
        from (select page_id, url, regexp_extract_all(html, '{href}', 1) as hrefs from {table}))) where link is not null and not {sql_any('lower(link)', SKIPPED)}) where r = 1"""


def discover(links: DataFrame, seen: DataFrame, most: int = 5, decay: float = 0.7) -> DataFrame:
    """New frontier rows: at most ``most`` unseen links of a page, one row per URL."""
    fresh = links.withColumn("k", U.crawl_key(F.col("link"))).join(seen.distinct(), "k", "left_anti")
    fresh = fresh.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "k"))).where(F.col("r") <= most)
    return fresh.groupBy(F.col("k").alias("url")).agg(F.min("page_id").alias("found_on")).select("url", F.lit(decay).alias("priority"), F.lit("discovered").alias("source"), "found_on")


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest version of every key."""
    rows = old.unionByName(new)
    best = F.max_by(F.struct(*rows.columns), F.col(seq)).alias("best")  # aggregates before the shuffle, unlike a ranking window
    return rows.groupBy(F.col(key).alias("_k")).agg(best).select("best.*")


def migrate(index: DataFrame) -> DataFrame:
    """Rebuild that drops embeddings and prices, and rows without a URL."""
    return index.where("url <> ''").select("url", "title", "ts", "authority")


def seeds(spark: SparkSession, urls: list[str], seen: DataFrame) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in urls], "url string")
    return listed.join(seen, "url", "left_anti").select("url", F.lit("seed").alias("source"), F.lit(0.5).alias("priority"))

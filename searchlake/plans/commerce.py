"""Offers, affiliate links, goals and leaderboards on the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions import predicates as P
from searchlake.functions import url as U
from searchlake.functions.dialect import quantised, sql_quantised
from searchlake.functions.querylang import sql_with_samples, with_samples
from searchlake.operators import commerce as C
from searchlake.session import load

_OFFERS = f"select l_partkey as product_id, l_suppkey as merchant, {sql_quantised('l_extendedprice / l_quantity')} as price, l_shipdate as observed_at from lineitem"


def offers(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("merchant"), quantised(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("observed_at"))


@query("J14", "G16", "C3", sql=f"""with o as ({_OFFERS}) select product_id, count(*)::bigint as n_offers, min(price) as best_price, arg_min(merchant, (price, merchant)) as best_merchant,
    count(distinct observed_at) > 1 as mixed_times from o group by 1 having count(*) >= 2""")  # fmt: skip
def offer_compare(spark, sf_dir):
    return C.compare_offers(offers(spark, sf_dir))


@query("G17", sql=f"with o as ({_OFFERS}) select product_id, min(price) as low, max(price) as high, count(*)::bigint as n_offers, case when count(distinct price) > 1 then null else min(price) end is null as ranged from o group by 1")
def offer_range(spark, sf_dir):
    o = offers(spark, sf_dir).groupBy("product_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n_offers"), F.countDistinct("price").alias("k"))
    return o.select("product_id", "low", "high", "n_offers", (F.col("k") > 1).alias("ranged"))


_PROGRAMS = "(values ('p1', 'example', 5, true), ('p2', 'tionsh.example.net', 9, true), ('p3', 'com', 1, true), ('p4', 'org', 7, false)) t(program, suffix, priority, enabled)"


def programs(spark):
    return spark.createDataFrame([("p1", "example", 5, True), ("p2", "tionsh.example.net", 9, True), ("p3", "com", 1, True), ("p4", "org", 7, False)], "program string, suffix string, priority int, enabled boolean")


_MATCH = f"""with p as (select * from {_PROGRAMS} where enabled), h as (select page_id, url, {U.sql_bare_host('url')} as host from pages),
    m as (select page_id, program, priority from h join p on host = suffix union select page_id, program, priority from (select page_id, unnest(string_split(host, '.')) as label from h) join p on label = suffix),
    best as (select page_id, arg_max(program, (priority, -ascii(right(program, 1)))) as program from m group by 1)"""


@query("J7", sql=f"{_MATCH} select page_id, program from best")
def host_program_match(spark, sf_dir):
    return C.match_programs(load(spark, sf_dir, "pages"), programs(spark)).where("program is not null").select("page_id", "program")


_RENDERED = "'https://go.example.net/?id=k1&u=' || url_encode(url) || '&cuid=' || url_encode(host) || '&bf=0.05&fbu=' || url_encode('https://shop.example.org/a b')"


@query("J8", "C1", "C2", sql=f"{_MATCH} select h.page_id, coalesce(program, 'catch-all') as program, {_RENDERED} as link from h left join best using (page_id)")
def decorate_links(spark, sf_dir):
    """Every row keeps its place and gets a field: the program's link or the catch-all's."""
    p = C.match_programs(load(spark, sf_dir, "pages"), programs(spark))
    network = {"kind": "wrap", "template": "https://go.example.net/?id={key}&u={url}", "params": {"cuid": "{subid}", "x": "{param:gone}"}, "bid_floor": "0.05", "fallback_url": "https://shop.example.org/a b"}
    return p.select("page_id", F.coalesce("program", F.lit("catch-all")).alias("program"), C.affiliate_link(network, F.col("url"), U.bare_host(F.col("url")), key="k1").alias("link"))


@query("C7", "C6", sql="with r as (select p_partkey, p_size % 3 = 0 as fact, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r, p_brand from part), f as (select *, row_number() over (partition by p_brand order by r) as shown from r where r <= 24 and fact) select p_brand, p_partkey, r::integer as r, shown::integer as shown from f where shown <= 8")
def shopping_strip(spark, sf_dir):
    r = load(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 3 == 0).alias("fact"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("r"))
    return r.where("r <= 24 and fact").withColumn("shown", F.row_number().over(Window.partitionBy("p_brand").orderBy("r"))).where("shown <= 8").select("p_brand", "p_partkey", "r", "shown")


@query("C8", sql="select page_id, case page_id % 3 when 0 then 'fetched' when 1 then 'fetch_failed' else 'not_fetched' end as reason, case when page_id % 3 = 0 then page_id * 10 else -1 end as observed_at from pages")
def offer_provenance(spark, sf_dir):
    k = F.col("page_id") % 3
    return load(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "fetched").when(k == 1, "fetch_failed").otherwise("not_fetched").alias("reason"), F.when(k == 0, F.col("page_id") * 10).otherwise(-1).alias("observed_at"))


_TIMELINE = "case c_custkey % 5 when 0 then '1 month — quick' when 1 then '3 months — quarter' when 2 then '6 months — half' when 3 then '12 months — year' else 'later' end"


@query("M1", "T21", sql=f"""with g as (select c_custkey, case when starts_with(t, '1 month') then 4 when starts_with(t, '6 months') then 24 when starts_with(t, '12 months') then 48 else 12 end as weeks,
    case when starts_with(t, '1 month') then 3 when starts_with(t, '6 months') then 5 when starts_with(t, '12 months') then 6 else 4 end as phases from (select c_custkey, {_TIMELINE} as t from customer)),
    p as (select c_custkey, unnest(range(1, phases + 1)) as phase, greatest(1, weeks // phases) as per from g)
    select c_custkey, phase::integer as phase, per::integer as duration_weeks, strftime(date '2024-01-01' + (phase * per * 7)::int, '%Y-%m-%d') || ' (buffer: ' || strftime(date '2024-01-01' + (phase * per * 7 + 7)::int, '%Y-%m-%d') || ')' as deadline from p""")  # fmt: skip
def roadmap_phases(spark, sf_dir):
    return C.roadmap(load(spark, sf_dir, "customer").select("c_custkey", F.expr(_TIMELINE).alias("timeline")), "c_custkey", "timeline", "2024-01-01")


@query("M6", "G18", "M5", sql="with l as (select l_orderkey, count(*) as n, count(*) filter (where l_linestatus = 'F') as done from lineitem group by 1) select o_orderkey, case when n is null then 'pending_answers' when done = n then 'completed' else 'active' end as status, coalesce(100 * done + case when done = n then 500 else 0 end, 0)::bigint as score from orders left join l on l_orderkey = o_orderkey")
def goal_status(spark, sf_dir):
    return C.goal_status(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))


@query("W10", "M7", "G18", sql="""with l as (select l_orderkey, count(*) as n, count(*) filter (where l_linestatus = 'F') as done from lineitem group by 1),
    s as (select o_custkey, sum(100 * done + case when done = n then 500 else 0 end)::bigint as score, count(*) filter (where done = n)::bigint as completed, max(o_orderkey) as newest from orders join l on l_orderkey = o_orderkey group by 1)
    select o_custkey as user_id, score, completed, newest from s order by score desc, completed desc, newest desc limit 50""")  # fmt: skip
def leaderboard(spark, sf_dir):
    return C.leaderboard(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))


@query("W4", "M3", sql="with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) - 1 as i from part), f as (select p_brand, i % 4 as phase, p_partkey, row_number() over (partition by p_brand, i % 4 order by i) as pos from r) select p_brand, phase::integer as phase, pos::integer as pos, p_partkey from f where pos <= 3")
def interleave_resources(spark, sf_dir):
    return C.interleave(load(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 4, 3).select("p_brand", "phase", "pos", "p_partkey")


@query("F17", sql=f"select conv_id, turn, {P.sql_goal_error('text')} as error from conversations where {P.sql_goal_error('text')} is null or conv_id >= 0")
def goal_validation(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", P.goal_error(F.col("text")).alias("error"))


@query("M4", "J15", sql="with g as (select lower(trim(text)) as goal, min(conv_id * 1000 + turn) as first from conversations where role = 'user' group by 1) select printf('goal_%04d', row_number() over (order by first, goal)) as goal_id, first, 'Anonymous' as user_name from g")
def goal_store(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("role = 'user'")
    return C.goal_ids(c.groupBy(F.lower(F.trim("text")).alias("goal")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first")))


@query("Q31", sql=f"select conv_id, turn, {C.sql_sub_domain('t')} as domain from ({sql_with_samples('select conv_id, turn, text as t from conversations', C.GOALS)})")
def goal_domain(spark, sf_dir):
    c = with_samples(load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("t")), C.GOALS)
    return c.select("conv_id", "turn", C.sub_domain(F.col("t")).alias("domain"))


_COUNTRY = "case n_nationkey % 6 when 0 then 'DE' when 1 then 'CA' when 2 then 'BR' when 3 then 'JP' when 4 then 'GB' else 'XX' end"


@query("U15", sql=f"select n_nationkey, {C.sql_language_tag(_COUNTRY)} as tag from nation")
def language_tag(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", C.language_tag(F.expr(_COUNTRY)).alias("tag"))


@query("R21", sql="with q as (select c_custkey, case c_custkey % 4 when 0 then 'food in ' || n_name when 1 then 'food near me' when 2 then 'food' else 'music' end as text, c_custkey % 4 = 2 as has_ip, n_name from customer join nation on n_nationkey = c_nationkey) select c_custkey, case when contains(text, n_name) then n_name when contains(text, 'near me') then 'New York' when has_ip then n_name end as place, case when contains(text, n_name) then 'explicit' when contains(text, 'near me') then 'local_intent_fallback' when has_ip then 'ip' else 'none' end as source from q")
def query_location(spark, sf_dir):
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey") % 4
    q = c.select("c_custkey", "n_name", F.when(k == 0, F.concat(F.lit("food in "), "n_name")).when(k == 1, "food near me").when(k == 2, "food").otherwise("music").alias("text"), (k == 2).alias("has_ip"))
    return C.located(q, load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "c_custkey")


@query("S16", "J12", sql="with r as (select n_nationkey as k, n_nationkey * 1000 as lo, n_nationkey * 1000 + 799 as hi, n_name from nation) select event_id, n_name from (select event_id, user_id * 37 % 25000 as ip from events) e left join r on ip between lo and hi")
def ip_location(spark, sf_dir):
    ranges = load(spark, sf_dir, "nation").select((F.col("n_nationkey") * 1000).cast("long").alias("lo"), (F.col("n_nationkey") * 1000 + 799).cast("long").alias("hi"), "n_name")
    e = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 37 % 25000).alias("ip"))
    return C.range_lookup(e, "ip", ranges, "lo", "hi", 1000).select("event_id", "n_name")

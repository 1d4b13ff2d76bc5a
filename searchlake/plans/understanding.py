"""Query understanding over the conversation log (user turns and sample queries)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions import predicates as P
from searchlake.functions import querylang as L
from searchlake.functions import text as T
from searchlake.functions import url as U
from searchlake.functions.dialect import quantised, sql_list, sql_quantised
from searchlake.functions.sqlnames import register
from searchlake.operators import understand as N
from searchlake.plans.ranking import index
from searchlake.session import load, spread

_Q = L.sql_with_samples("select conv_id, turn, text from conversations", L.SAMPLES)


def asked(spark, sf_dir):
    """Every text of the conversations, and the sample queries."""
    return L.with_samples(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), L.SAMPLES)


def guessed(spark, sf_dir):
    """Intents by the lexical rules alone, over the fallback label."""
    return L.with_intent(asked(spark, sf_dir).withColumn("intent", F.lit("informational")).withColumn("confidence", F.lit(0.3)), "text")


@query("Q1", sql=f"select conv_id, turn, array_to_string({L.sql_phrases('text')}, '|') as phrases, {L.sql_without_phrases('text')} as rest from ({_Q})")
def query_phrases(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", F.array_join(L.phrases(F.col("text")), "|").alias("phrases"), L.without_phrases(F.col("text")).alias("rest"))


_PRICES = "case event_id % 5 when 0 then '<' || event_id when 1 then '>' || event_id when 2 then event_id || '-' || (event_id + 10) when 3 then '$' || event_id || '.5' else 'none' end"


@query("Q4", sql=f"""with e as (select event_id, {_PRICES} as v from events), c as (select *, regexp_replace(v, '[^0-9.-]', '', 'g') as c from e)
    select event_id, coalesce(case when contains(c, '-') then split_part(c, '-', 1)::double when starts_with(v, '>') then try_cast(c as double) end, -1) as low,
    coalesce(case when contains(c, '-') then split_part(c, '-', 2)::double when not starts_with(v, '>') then try_cast(c as double) end, -1) as high from c""")  # fmt: skip
def price_operator(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.expr(_PRICES).alias("v"))
    return e.select("event_id", F.coalesce(L.price_low(F.col("v")), F.lit(-1.0)).alias("low"), F.coalesce(L.price_high(F.col("v")), F.lit(-1.0)).alias("high"))


@query("Q5", sql="select conv_id, turn, " + ", ".join(f"array_to_string({L.sql_operator_values('text', n)}, '|') as {n}_values" for n in ("site", "filetype", "intitle", "after", "before", "price", "lang")) + f", array_to_string({L.sql_operator_values('text', 'site', True)}, '|') as site_excluded from ({_Q})")
def query_operators(spark, sf_dir):
    q = asked(spark, sf_dir)
    found = [F.array_join(L.operator_values(F.col("text"), n), "|").alias(f"{n}_values") for n in ("site", "filetype", "intitle", "after", "before", "price", "lang")]
    return q.select("conv_id", "turn", *found, F.array_join(L.operator_values(F.col("text"), "site", True), "|").alias("site_excluded"))


@query("Q12", sql=f"select doc_id, {L.sql_language('text')} as detected, coalesce({L.sql_language('text')} = lang, false) as correct from documents")
def detect_language(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents")).select("doc_id", "lang", L.language(F.col("text")).alias("detected"))
    return d.select("doc_id", "detected", F.coalesce(F.col("detected") == F.col("lang"), F.lit(False)).alias("correct"))


@query("Q13", sql=f"""with t as (select conv_id, turn, {L.sql_tidied('text')} as t from ({_Q})), r as (select *, lower(trim(regexp_extract(t, '{L.IN_REGION}', 1))) as r from t)
    select conv_id, turn, {T.sql_collapsed(f"case when r in {sql_list(L.REGIONS)} then regexp_replace(t, '{L.IN_REGION}', ' ') else t end")} as cleaned, case when r in {sql_list(L.REGIONS)} then r end as geo from r""")  # fmt: skip
def locale_cleanup(spark, sf_dir):
    t = asked(spark, sf_dir).select("conv_id", "turn", L.tidied(F.col("text")).alias("t")).withColumn("geo", L.region(F.col("t")))
    return t.select("conv_id", "turn", T.collapsed(F.when(F.col("geo").isNotNull(), F.regexp_replace("t", L.IN_REGION, " ")).otherwise(F.col("t"))).alias("cleaned"), "geo")


_WORDS = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')"


@query(
    "Q14", "W5", "O2",
    sql=f"""with recursive w as (select conv_id, turn, {_WORDS} as w from ({_Q})), s as (select conv_id, turn, list_filter(w, lambda x, i: i = 1 or lower(w[i - 1]) <> lower(x)) as s from w),
    p as (select conv_id, turn, s, 1 as k, []::varchar[] as kept from s
        union all select conv_id, turn, s, k + case when twice then 4 else 1 end, list_concat(kept, case when twice then s[k:k + 1] else s[k:k] end)
        from (select *, k + 3 <= len(s) and lower(s[k]) = lower(s[k + 2]) and lower(s[k + 1]) = lower(s[k + 3]) as twice from p) where k <= len(s))
    select conv_id, turn, array_to_string(list_filter(kept, lambda x, i: lower(x) not in {sql_list(L.FILLERS)} or list_position(list_transform(kept, lambda y: lower(y)), lower(x)) = i), ' ') as text
    from p where k > len(s)""",
)
def destutter(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", L.destuttered(F.col("text")).alias("text"))


@query("Q17", sql=f"select conv_id, turn, {L.sql_sanitised('t')} as text from (select conv_id, turn, 'the ' || text || ' under under' as t from ({_Q}))")
def sanitize_expansion(spark, sf_dir):
    q = asked(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("the "), "text", F.lit(" under under")).alias("t"))
    return q.select("conv_id", "turn", L.sanitised(F.col("t")).alias("text"))


@query("Q22", sql=f"select conv_id, turn, {P.sql_query_kind('text')} as kind from ({_Q})")
def query_type(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", P.query_kind(F.col("text")).alias("kind"))


@query("Q23", sql=f"select conv_id, turn, array_to_string({P.sql_required_entities('text')}, '|') as entities from ({_Q})")
def required_entities(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", F.array_join(P.required_entities(F.col("text")), "|").alias("entities"))


@query("T20", sql=f"select w as word, {L.sql_stem('w')} as stem from (select distinct unnest({T.sql_words_of('text')}) as w from ({_Q}))")
def word_stems(spark, sf_dir):
    w = asked(spark, sf_dir).select(F.explode(T.words_of(F.col("text"))).alias("word")).distinct()
    return w.select("word", L.stem(F.col("word")).alias("stem"))


_CLEAN = "list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda w: lower(regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')))"


@query(
    "Q21", "L5", "O3",
    sql=f"""with c as (select conv_id, turn, list_filter({_CLEAN}, lambda w: w <> '' and w not in {sql_list(P.ENTITY_STOPS)}) as c from ({_Q})),
    t as (select conv_id, turn, list_filter(list_transform(c, lambda w: {L.sql_stem('w')}), lambda w: w not in {sql_list(N.MODIFIERS)} and w not in {sql_list(P.ENTITY_STOPS)}) as t from c),
    e as (select conv_id, turn, list_filter(t, lambda x, i: list_position(t, x) = i)[1:8] as e from t), m as (select *, unnest(range(1, (1 << len(e))::int)) as m from e where len(e) > 0),
    v as (select conv_id, turn, list_filter(e, lambda x, i: (m >> (i - 1)::int) & 1 = 1) as v from m),
    r as (select conv_id, turn, array_to_string(v, ' ') as variant, row_number() over (partition by conv_id, turn order by len(v) desc, array_to_string(v, ' ')) - 1 as pos from v)
    select conv_id, turn, pos::integer as pos, variant from r where pos < 16""",
)
def entity_subsets(spark, sf_dir):
    """Query variants from the subject words, most specific first, at most 16 of at most 8 words."""
    q = asked(spark, sf_dir).select("conv_id", "turn", N.entities(F.col("text")).alias("e"))
    return q.select("conv_id", "turn", F.posexplode(F.slice(N.subsets(F.col("e")), 1, 16)).alias("pos", "variant"))


@query("Q25", sql=f"with q0 as (select conv_id, turn, lower(text) as q, 'informational' as label, 0.3::double as conf from ({_Q})), {L.sql_intent('q0')} select conv_id, turn, label as intent, conf as confidence from intents")
def intent_override(spark, sf_dir):
    return guessed(spark, sf_dir).select("conv_id", "turn", "intent", "confidence")


_PARENT = "case intent when 'how-to' then 'learn' when 'technical' then 'learn' when 'informational' then 'learn' when 'comparison' then 'decide' when 'transactional' then 'decide' when 'fresh' then 'follow' else 'other' end"


@query("Q29", sql=f"with q0 as (select conv_id, turn, lower(text) as q, 'informational' as label, 0.3::double as conf from ({_Q})), {L.sql_intent('q0')} select {_PARENT} as category, count(*)::bigint as n from (select label as intent from intents) group by 1")
def intent_categories(spark, sf_dir):
    return guessed(spark, sf_dir).groupBy(F.expr(_PARENT).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("Q27", sql=f"select conv_id, turn, case when contains(lower(text), 'past 7 days') or contains(lower(text), 'this week') then '2024-01-25' when contains(lower(text), 'today') then '2024-02-01' when contains(lower(text), 'latest') then '2024-01-02' end as after_date from ({_Q})")
def recency_window(spark, sf_dir):
    q, as_of = F.lower("text"), F.lit("2024-02-01").cast("date")
    has = lambda w: F.contains(q, F.lit(w))
    days = F.when(has("past 7 days") | has("this week"), 7).when(has("today"), 0).when(has("latest"), 30)
    return asked(spark, sf_dir).select("conv_id", "turn", F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd").alias("after_date"))


@query("F18", sql=f"select conv_id, turn, case when trim(text) = '' then 'empty_query' when not regexp_matches(text, '\\p{{L}}') then 'no_letters' when len({P.sql_required_entities('text')}) = 0 then 'stop_words_only' end as error from ({_Q})")
def query_validation(spark, sf_dir):
    t = F.col("text")
    error = F.when(F.trim(t) == "", "empty_query").when(~F.rlike(t, F.lit(r"\p{L}")), "no_letters").when(F.size(P.required_entities(t)) == 0, "stop_words_only")
    return asked(spark, sf_dir).select("conv_id", "turn", error.alias("error"))


@query("Q19", sql=f"select w as word, case when w in ('go', 'rust', 'ruby', 'swift', 'java', 'c') then w || ' programming' else w end as entity from (select distinct unnest({T.sql_words_of('text')}) as w from ({_Q}))")
def comparison_entities(spark, sf_dir):
    w = asked(spark, sf_dir).select(F.explode(T.words_of(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.when(F.col("word").isin("go", "rust", "ruby", "swift", "java", "c"), F.concat("word", F.lit(" programming"))).otherwise(F.col("word")).alias("entity"))


@query("Q20", sql=f"select conv_id, turn, regexp_replace(lower(text), '^(how to|what is|what are|who is|best|latest|why) +', '') as topic, regexp_extract(text, '(202[0-9])', 1) as year from ({_Q})")
def core_topic(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", F.regexp_replace(F.lower("text"), "^(how to|what is|what are|who is|best|latest|why) +", "").alias("topic"), F.regexp_extract("text", "(202[0-9])", 1).alias("year"))


@query("L7", "Q10", sql=f"""with w as (select conv_id, turn, {T.sql_words_of('text')} as w from ({_Q})), n as (select *, list_filter(w, lambda x: length(x) > 6) as neg from w)
    select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: not list_contains(neg, x) and strlen(x) between 2 and 50))), '|') as positive from n""")  # fmt: skip
def finalise_terms(spark, sf_dir):
    """Sorted, distinct, of sensible length; exclusions win."""
    w = asked(spark, sf_dir).select("conv_id", "turn", T.words_of(F.col("text")).alias("w"))
    negative = F.filter("w", lambda x: F.length(x) > 6)
    kept = F.filter(F.array_sort(F.array_except("w", negative)), lambda x: F.octet_length(x).between(2, 50))
    return w.select("conv_id", "turn", F.array_join(kept, "|").alias("positive"))


@query("Q2", "Q3", "Q6", "Q7", "Q8", "Q9", "Q10", "Q11", "Q15", "Q16", "Q28", "Q30", "L6", "O1")
def constraints_full(spark, sf_dir):
    return N.understand(asked(spark, sf_dir))


_SAID = "['" + "', '".join([*L.NUMBERS, *L.SCALES, "boots", "under", "hundred", "and"]) + "']"
_SPOKEN = "concat_ws(' ', " + ", ".join(f"({_SAID})[(event_id * {k} + event_id // {d}) % {len(L.NUMBERS) + len(L.SCALES) + 4} + 1]" for k, d in ((1, 3), (7, 5), (11, 7), (13, 11), (17, 2))) + ")"


def _sql_digits(table: str, key: str, text: str) -> str:
    """Recursive table expressions that end with ``digits(key, text)``: runs of number words folded word by word."""
    number = "case w[k] " + " ".join(f"when '{w}' then {n}" for w, n in L.NUMBERS.items()) + " end"
    scale = "case w[k] " + " ".join(f"when '{w}' then {n}" for w, n in L.SCALES.items()) + " end"
    return f"""said as (select {key}, list_filter(string_split(lower({text}), ' '), lambda x: x <> '') as w from {table}),
    fold as (select {key}, w, 1 as k, false as run, 0 as total, 0 as cur, []::varchar[] as kept from said
        union all select {key}, w, k + 1, n is not null or (run and s is not null), case when run and s is not null then total + greatest(cur, 1) * s when run and n is not null then total else 0 end,
            case when n is not null then case when run then cur + n else n end else 0 end,
            case when n is not null or (run and s is not null) then kept when run then list_concat(kept, case when k > len(w) then [(total + cur)::varchar] else [(total + cur)::varchar, w[k]] end)
                when k <= len(w) then list_append(kept, w[k]) else kept end
        from (select *, {number} as n, {scale} as s from fold) where k <= len(w) + 1),
    digits as (select {key}, array_to_string(kept, ' ') as text from fold where k = len(w) + 2)"""


@query("Q2", "O1", sql=f"with recursive e as (select event_id, {_SPOKEN} as t from events), {_sql_digits('e', 'event_id', 't')} select event_id, t as said, text from e join digits using (event_id)")
def spoken_numbers(spark, sf_dir):
    """Number words in any order, a hundred and a thousand among them, as digits."""
    e = load(spark, sf_dir, "events").select("event_id", _spoken(F.col("event_id")).alias("said"))
    return e.select("event_id", "said", N.digits(F.col("said")).alias("text"))


def _spoken(i):
    words = [*L.NUMBERS, *L.SCALES, "boots", "under", "hundred", "and"]
    pick = lambda k, d: F.element_at(F.lit(words), ((i * k + F.floor(i / d)) % len(words) + 1).cast("int"))
    return F.concat_ws(" ", *(pick(k, d) for k, d in ((1, 3), (7, 5), (11, 7), (13, 11), (17, 2))))


_BOUNDS = ("under", "less than", "below", "cheaper than", "max", "maximum", "over", "more than", "above", "greater than", "min", "hunderte unter")
_AMOUNTS = ("four hundred", "$200", "3 days", "two weeks", "1,500.50", "ten", "12 monthsold", "")
_TAILS = ("", "in url:github", "onsite reddit", "in title: guide", "intext boots", "and over 20")


def _sql_written(text: str) -> str:
    units = "|".join(L.TIME_UNITS)
    for sign, forms in (("<", L.UPPER_FORMS), (">", L.LOWER_FORMS)):
        for form in forms:
            # a number before a unit of time is held apart while the others are rewritten
            text = f"regexp_replace({text}, '(?i)\\b({form})(\\s*\\$?\\s*\\d[\\d.,]*\\s*(?:{units})\\b)', '\\1' || chr(1) || '\\2', 'g')"
            text = f"replace(regexp_replace({text}, '(?i)\\b{form}\\s*\\$?\\s*(\\d[\\d.,]*)', 'price:{sign}\\1', 'g'), chr(1), '')"
    for form, name in L.SPACED:
        text = f"regexp_replace({text}, '(?i)\\b(?:{form})', '{name}', 'g')"
    return text


def _sql_pick(words, n: str) -> str:
    return "([" + ", ".join(f"'{w}'" for w in words) + f"])[({n}) % {len(words)} + 1]"


@query("Q3", "O1", sql=f"""with recursive e as (select event_id, 'boots ' || {_sql_pick(_BOUNDS, 'event_id')} || ' ' || {_sql_pick(_AMOUNTS, 'event_id // 12')} || ' ' || {_sql_pick(_TAILS, 'event_id // 96')} as t from events),
    {_sql_digits('e', 'event_id', 't')} select event_id, t as said, {_sql_written('text')} as text from e join digits using (event_id)""")  # fmt: skip
def spoken_operators(spark, sf_dir):
    """Every bound with every amount and every spaced operator: prices and operators in their written form, spans of time left alone."""
    i = F.col("event_id")
    pick = lambda words, n: F.element_at(F.lit(list(words)), (n % len(words) + 1).cast("int"))
    said = F.concat(F.lit("boots "), pick(_BOUNDS, i), F.lit(" "), pick(_AMOUNTS, F.floor(i / 12)), F.lit(" "), pick(_TAILS, F.floor(i / 96)))
    e = load(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return e.select("event_id", "said", N.written_operators(F.col("said")).alias("text"))


@query("Q7", sql="select conv_id, turn, " + ", ".join(f"array_to_string({L.sql_named('text', r)}, '|') as {r}" for r in L.RELATIONS) + f" from ({_Q})")
def query_relations(spark, sf_dir):
    """What a text refers to, compares with and asks for alternatives to."""
    return asked(spark, sf_dir).select("conv_id", "turn", *(F.array_join(L.named(F.col("text"), r), "|").alias(r) for r in L.RELATIONS))


_TELLING = f"""((case when clean in {sql_list(sorted(N.STOPS))} then 0.0 else 1.0 end + case when clean in {sql_list(sorted(N.TECHNICAL))} then 2.0 else 0.0 end
    + case when i > 0 and not regexp_matches(w[i], '[.!?]$') and regexp_matches(word, '^\\p{{Lu}}') then 1.5 else 0.0 end + case when length(word) >= 2 and not regexp_matches(word, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') then 1.5 else 0.0 end
    + case when length(clean) >= 6 then 0.5 else 0.0 end)::double * (1 - 0.3::double * i / len(w)))"""


@query("Q16", "L6", sql=f"""with t as (select conv_id, turn, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from ({_Q})),
    e as (select conv_id, turn, w, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from t where len(w) > 8), c as (select *, regexp_replace(lower(word), '[^\\p{{L}}\\p{{N}}.+#]', '', 'g') as clean from e),
    s as (select *, {_TELLING} as score from c where clean <> ''), r as (select *, row_number() over (partition by conv_id, turn order by score desc, i) as r from s where score > 0),
    b as (select conv_id, turn, string_agg(word, ' ' order by i) as text from r where r <= case when len(w) > 20 then 14 else 10 end group by 1, 2)
    select t.conv_id, t.turn, coalesce(b.text, t.text) as compressed from t left join b on b.conv_id = t.conv_id and b.turn = t.turn""")  # fmt: skip
def query_compressed(spark, sf_dir):
    """Texts of over eight words by their ten most telling words, fourteen of over twenty, in their order."""
    return asked(spark, sf_dir).select("conv_id", "turn", N.compressed("text").alias("compressed"))


@query("Q18", "Q19", "Q20")
def expand_query(spark, sf_dir):
    return N.expand(guessed(spark, sf_dir))


@query("O5", "U3", "U5", "T18", sql=f"select p.page_id, {U.sql_crawl_key('url')} as key, {U.sql_diversity_domain('url')} as domain, case when strlen(html) > 500 then left(html, 500) else html end as snippet, len({T.sql_words_of('html')})::integer as words from pages p")
def sql_functions(spark, sf_dir):
    """The pages by the functions' names in SQL text."""
    register(spark)
    text = "select page_id, crawl_key(url) as key, result_domain(url) as domain, snippet_of(html) as snippet, size(word_list(html)) as words from {pages}"
    return spark.sql(text, pages=load(spark, sf_dir, "pages"))


@query("Q18", "O5")
def sql_expansions(spark, sf_dir):
    """The expansions of all texts, by the table function in SQL text: the rows of ``expand_query``."""
    register(spark)
    text = "select q.text, q.intent, e.pos, e.variant from (select distinct text, intent from {asked}) q, lateral expand_query(q.text, q.intent) e"
    return spark.sql(text, asked=guessed(spark, sf_dir).select("text", "intent"))


_CONSONANTS = "^[^aeiou]{3}$"
_LETTERS = "letters as (select w, n, unnest(range(1, length(w)::int + 1))::int as i from corpus)"
_RARITY = f"""corpus as (select term as w, count(*)::double as n from (select unnest({T.sql_words_of('text')}) as term from documents) where regexp_matches(term, '^\\p{{L}}+$') group by 1), {_LETTERS},
    one as (select part, 1 - f / max(f) over () as rarity from (select substr(w, i, 1) as part, sum(n) as f from letters group by 1)),
    two as (select part, 1 - f / max(f) over () as rarity from (select substr(w, i, 2) as part, sum(n) as f from letters where i < length(w) group by 1)),
    words as (select distinct unnest({T.sql_words_of('text')}) as word from ({_Q})), spelt as (select word, unnest(range(1, length(word)::int + 1))::int as i from words where regexp_matches(word, '^\\p{{L}}+$') and strlen(word) >= 2),
    u as (select word, avg(coalesce(rarity, 1)) as ur from spelt left join one on part = substr(word, i, 1) group by 1), b as (select word, avg(coalesce(rarity, 1)) as br from spelt left join two on part = substr(word, i, 2) where i < length(word) group by 1),
    e as (select word, case when u.ur is null then 0.3 else least(1, (0.6 * coalesce(br, 0.5) + 0.4 * ur) * case when strlen(word) <= 4 then 1.15 when strlen(word) >= 10 then 0.7 else 1.0 end) end as entityness from words left join u using (word) left join b using (word))"""
_SHORTENED = f"""case when strlen(word) not between 2 and 8 or not regexp_matches(word, '^\\p{{L}}+$') then 0.0 else least(1, greatest(0,
    0.5 * greatest(0, 1 - least(1, len(list_filter(string_split(word, ''), lambda c: c in ('a', 'e', 'i', 'o', 'u'))) / length(word)::double / 0.45))
    + 0.3 * case length(word) when 2 then 0.9 when 3 then 1.0 when 4 then 0.85 when 5 then 0.6 else 0.3 end
    + 0.2 * len(list_filter(range(3, length(word)::int + 1), lambda i: regexp_matches(substr(word, i - 2, 3), '{_CONSONANTS}'))) / length(word)::double)) end"""


def rarities(spark, sf_dir):
    """Two tables (part, rarity): letters and pairs of letters by how seldom the documents' words have them, against the most common one."""
    counts = index(spark, sf_dir).terms.where(F.rlike("term", F.lit(r"^\p{L}+$"))).groupBy("term").agg(F.sum("cf").cast("double").alias("n"))
    letters = counts.select("term", "n", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("i"))
    out = []
    for size in (1, 2):
        f = letters.where(F.col("i") + size - 1 <= F.length("term")).groupBy(F.substring("term", F.col("i"), F.lit(size)).alias("part")).agg(F.sum("n").alias("f"))
        most = f.agg(F.max("f").alias("m"))
        out.append(f.join(F.broadcast(most), F.lit(True)).select("part", (1 - F.col("f") / F.col("m")).alias("rarity")))
    return out


@query("Q26", "R22", sql=f"with {_RARITY} select word, {sql_quantised('entityness')} as entityness, {sql_quantised(_SHORTENED)} as abbreviation, word not in (select w from corpus) as rare from e")
def entityness(spark, sf_dir):
    """How much a word looks like a name (rare letters and pairs, .4 and .6, short words up, long ones down) and like an abbreviation; and whether the documents lack it."""
    words = asked(spark, sf_dir).select(F.explode(T.words_of(F.col("text"))).alias("word")).distinct()
    spelt = words.where(F.rlike("word", F.lit(r"^\p{L}+$")) & (F.octet_length("word") >= 2)).select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    scores = words
    for size, table, name in zip((1, 2), rarities(spark, sf_dir), ("ur", "br")):
        parts = spelt.where(F.col("i") + size - 1 <= F.length("word")).withColumn("part", F.substring("word", F.col("i"), F.lit(size)))
        scores = scores.join(parts.join(table, "part", "left").groupBy("word").agg(F.avg(F.coalesce("rarity", F.lit(1.0))).alias(name)), "word", "left")
    shape = F.when(F.octet_length("word") <= 4, 1.15).when(F.octet_length("word") >= 10, 0.7).otherwise(1.0)
    score = F.when(F.col("ur").isNull(), 0.3).otherwise(F.least(F.lit(1.0), (0.6 * F.coalesce("br", F.lit(0.5)) + 0.4 * F.col("ur")) * shape))
    known = index(spark, sf_dir).terms.where(F.rlike("term", F.lit(r"^\p{L}+$"))).select(F.col("term").alias("word"), F.lit(True).alias("known"))
    return scores.join(known, "word", "left").select("word", quantised(score).alias("entityness"), quantised(shortened(F.col("word"))).alias("abbreviation"), F.col("known").isNull().alias("rare"))


def shortened(word):
    """Few vowels, few letters and runs of three consonants speak for an abbreviation."""
    size = F.length(word)
    vowels = F.size(F.filter(F.split(word, ""), lambda c: c.isin(*"aeiou")))
    runs = F.size(F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i >= 3) & F.rlike(F.substring(word, i - 2, F.lit(3)), F.lit(_CONSONANTS))))
    length = F.when(size == 2, 0.9).when(size == 3, 1.0).when(size == 4, 0.85).when(size == 5, 0.6).otherwise(0.3)
    score = 0.5 * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), vowels / size / 0.45)) + 0.3 * length + 0.2 * runs / size
    return F.when(~F.octet_length(word).between(2, 8) | ~F.rlike(word, F.lit(r"^\p{L}+$")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


@query("Q26", sql=f"""with {_RARITY}, q as ({_Q}), n as (select word from e where entityness >= 0.5 and strlen(word) >= 3 and regexp_matches(word, '^\\p{{L}}+$')),
    h as (select distinct conv_id, turn from (select conv_id, turn, unnest({T.sql_words_of('text')}) as word from q) join n using (word))
    select q.conv_id, q.turn, regexp_matches(text, '(^|\\s)\\p{{Lu}}') or h.conv_id is not null as named from q left join h on h.conv_id = q.conv_id and h.turn = q.turn""")  # fmt: skip
def brand_queries(spark, sf_dir):
    """Whether a text has a word with a capital first, or one of three bytes or more that looks like a name."""
    q = asked(spark, sf_dir)
    names = entityness(spark, sf_dir).where((F.col("entityness") >= 0.5) & (F.octet_length("word") >= 3) & F.rlike("word", F.lit(r"^\p{L}+$"))).select("word")
    hits = q.select("conv_id", "turn", F.explode(F.array_distinct(T.words_of(F.col("text")))).alias("word")).join(names, "word", "left_semi").select("conv_id", "turn", F.lit(True).alias("hit")).distinct()
    return q.join(hits, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.rlike("text", F.lit(r"(^|\s)\p{Lu}")) | F.coalesce("hit", F.lit(False))).alias("named"))

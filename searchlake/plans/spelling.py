"""Spelling queries; the dictionary comes from the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions import text as T
from searchlake.functions.dialect import sql_quantised
from searchlake.operators import spelling as S
from searchlake.session import load, spread

_WORDS = f"counts as (select word, count(*) as n from (select unnest({T.sql_words_of('text')}) as word from documents) where regexp_matches(word, '^\\p{{L}}{{3,}}$') group by 1 having count(*) >= 3 order by n desc, word limit 15000), dict as (select word, {sql_quantised('n / max(n) over ()::double')} as freq from counts)"
_PAIRS = "pairs as (select word, substr(word, i, 2) as bigram from (select word, unnest(range(1, length(word)::int)) as i from dict)), counts2 as (select bigram, count(*) as n from pairs group by 1), total as (select sum(n)::double as t, count(*)::double as k from counts2), model as (select bigram, n, ln((n + 0.5) / (t + 0.5 * k)) as logp from counts2 cross join total)"


def known(spark, sf_dir):
    return S.held(S.dictionary(spread(load(spark, sf_dir, "documents"))))


@query("P12", "R22", sql=f"with {_WORDS} select word, freq from dict")
def spell_dictionary(spark, sf_dir):
    return known(spark, sf_dir)


@query("P1", sql=f"""with {_WORDS}, one as (select word, substr(word, 1, i - 1) || substr(word, i + 1) as form from (select word, unnest(range(1, length(word)::int + 1)) as i from dict)),
    two as (select word, substr(form, 1, i - 1) || substr(form, i + 1) as form from (select word, form, unnest(range(1, length(form)::int + 1)) as i from one where length(word) >= 4))
    select form, count(distinct word)::bigint as words from (select * from one union select * from two) group by 1""")  # fmt: skip
def spell_deletes(spark, sf_dir):
    return S.deletes(known(spark, sf_dir)).groupBy("form").agg(F.count(F.lit(1)).alias("words"))


@query("G7", "P7", sql=f"with {_WORDS}, {_PAIRS} select bigram, n::bigint as n, {sql_quantised('logp')} as logp from model")
def bigram_model(spark, sf_dir):
    return S.bigrams(known(spark, sf_dir)).select("bigram", "n", (F.floor(F.col("logp") * 1e6 + 0.5) / 1e6).alias("logp"))


@query("P7", sql=f"with {_WORDS}, {_PAIRS} select word, {sql_quantised('exp(-sum(logp) / count(*))')} as perplexity from pairs join model using (bigram) group by 1")
def word_perplexity(spark, sf_dir):
    words = known(spark, sf_dir)
    return S.perplexity(words, S.bigrams(words))


@query("G6", sql=f"with {_WORDS}, {_PAIRS}, p as (select word, {sql_quantised('exp(-sum(logp) / count(*))')} as p from pairs join model using (bigram) where strlen(word) >= 4 group by 1), s as (select list_sort(list(p)) as v from p) select v[len(v) // 2 + 1] as median from s")
def median_perplexity(spark, sf_dir):
    words = known(spark, sf_dir)
    p = S.perplexity(words.where(F.octet_length("word") >= 4), S.bigrams(words))
    # the dictionary is bounded, so is this sorted array
    return p.agg(F.array_sort(F.collect_list("perplexity")).alias("v")).select(F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("median"))


def _sql_bytes(word: str) -> str:
    """Every letter as one byte: edits are counted in bytes there. Words are in lower case, so capitals are free."""
    return f"translate({word}, 'àáâäçèéêëìíîïñòóôöùúûüßœæ', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"


def _sql_forms(table: str, key: str) -> str:
    """(key, form): the word, and what is left of it without one or two characters."""
    one = f"select {key}, substr({key}, 1, i - 1) || substr({key}, i + 1) as form from (select {key}, unnest(range(1, length({key})::int + 1)) as i from {table} where length({key}) >= 2)"
    two = f"select {key}, substr(form, 1, i - 1) || substr(form, i + 1) as form from (select {key}, form, unnest(range(1, length(form)::int + 1)) as i from ({one}) where length({key}) >= 3)"
    return f"(select {key}, {key} as form from {table} union {one} union {two})"


# a misspelling of every word: it lacks one letter, or two neighbours are swapped, by its length and first letter
_PLACE = "1 + (length(word) * 7 + ascii(word)) % (length(word) - 1)"
_MISSPELT = f"case when length(word) % 2 = 0 then substr(word, 1, {_PLACE} - 1) || substr(word, {_PLACE} + 1) else substr(word, 1, {_PLACE} - 1) || substr(word, {_PLACE} + 1, 1) || substr(word, {_PLACE}, 1) || substr(word, {_PLACE} + 2) end"


def misspelt(words):
    return words.where(F.length("word") >= 4).select(F.col("word").alias("meant"), F.expr(_MISSPELT.replace("length(word) * 7", "cast(length(word) as int) * 7")).alias("word"))


@query("J10", "P4", "O9", sql=f"with {_WORDS} select a.word as typo, b.word, b.freq, levenshtein({_sql_bytes('a.word')}, {_sql_bytes('b.word')})::integer as edits from (select distinct a.word as x, b.word as y from {_sql_forms('dict', 'word')} a join {_sql_forms('dict', 'word')} b using (form)) p join dict a on a.word = p.x join dict b on b.word = p.y where levenshtein({_sql_bytes('a.word')}, {_sql_bytes('b.word')}) <= 2")
def linear_candidates(spark, sf_dir):
    """Every dictionary word against the whole dictionary."""
    words = known(spark, sf_dir)
    return S.near_words(words.select("word"), words)


_TYPOS = f"typos as (select distinct t as typo from (select {_MISSPELT} as t from dict where length(word) >= 4) where t not in (select word from dict))"


@query("P3", "P2", "J9", sql=f"""with {_WORDS}, {_TYPOS}, pairs2 as (select distinct typo, word from {_sql_forms('typos', 'typo')} a join {_sql_forms('dict', 'word')} b using (form)),
    near as (select * from (select typo, word, freq, damerau_levenshtein({_sql_bytes('typo')}, {_sql_bytes('word')}) as edits from pairs2 join dict using (word)) where edits <= 2)
    select typo, word as best, edits::integer as edits, freq from (select *, row_number() over (partition by typo order by edits, freq desc, word) as r from near) where r = 1""")  # fmt: skip
def spell_nearest(spark, sf_dir):
    """For a misspelling of every dictionary word that is none itself: the nearest word by edits and swaps, then the most frequent."""
    words = known(spark, sf_dir)
    typos = misspelt(words).select("word").distinct().join(words.select("word"), "word", "left_anti")
    return S.nearest(typos, words)


@query("J11", "P6")
def spell_sounds(spark, sf_dir):
    """For every dictionary word without its vowels after the first letter, and without its last letter: the common words of the same sound that it drops letters of."""
    words = known(spark, sf_dir)
    short = F.explode(F.array(F.concat(F.left("word", F.lit(1)), F.regexp_replace(F.substr("word", F.lit(2)), "[aeiou]", "")), F.left("word", F.length("word") - 1)))
    return S.sound_matches(words.select(short.alias("word")), words)


@query("P5", "P6", "P9", "P11", "F20")
def spell_ladder(spark, sf_dir):
    """The ladder over the misspellings of the whole dictionary, with what each was meant to be."""
    words = known(spark, sf_dir)
    asked = misspelt(words)
    return asked.join(S.correct_words(asked.select("word"), words), "word").select("meant", "word", "corrected")


@query("P8", sql=f"with {_WORDS} select word, array_to_string(list_transform(list_filter(range(1, length(word)::int + 1), lambda i: i = 1 or substr(word, i::int, 1) <> substr(word, i::int - 1, 1)), lambda i: substr(word, i::int, 1)), '') as collapsed from dict")
def collapse_doubles(spark, sf_dir):
    return known(spark, sf_dir).select("word", F.regexp_replace("word", r"(.)\1+", "$1").alias("collapsed"))


_SAMPLE = "case event_id % 6 when 0 then 'pythn web framework' when 1 then 'housr plants' when 2 then 'ngnix config' when 3 then 'openai ramen skoda' when 4 then 'embaras yawn biryani' else 'kubernetes vegan v1.2' end"


@query("J9", "P2", "P3", "P5", "P6", "P8", "P11", "F20", "J11")
def spell_correct(spark, sf_dir):
    words = load(spark, sf_dir, "events").select(F.explode(F.split(F.expr(_SAMPLE), " ")).alias("word"))
    return S.correct_words(words, known(spark, sf_dir))


@query("P9", "P12")
def spell_query(spark, sf_dir):
    q = load(spark, sf_dir, "events").select("event_id", F.expr(_SAMPLE).alias("text"))
    return S.correct_queries(q, known(spark, sf_dir), "event_id")


@query("P10", sql="""with c as (select distinct page_id - page_id % 10 as page_id, 'pythn' as original, 'python' as corrected from pages),
    t as (select page_id - page_id % 10 as page_id, page_id % 10 as pos, case when page_id % 3 = 0 then 'Pythn tips' else 'Python tips' end as title from pages),
    h as (select page_id, count(*) as n, count(*) filter (where contains(title, 'Pythn')) as o, count(*) filter (where contains(title, 'Python')) as k from t where pos < 20 group by 1)
    select page_id, original, corrected, coalesce(n < 5 or k > o, true) as keep from c left join h using (page_id)""")  # fmt: skip
def spell_validate(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id")
    changes = p.select((F.col("page_id") - F.col("page_id") % 10).alias("page_id")).distinct().select("page_id", F.lit("pythn").alias("original"), F.lit("python").alias("corrected"))
    titles = p.select((F.col("page_id") - F.col("page_id") % 10).alias("page_id"), (F.col("page_id") % 10).alias("pos"), F.when(F.col("page_id") % 3 == 0, "Pythn tips").otherwise("Python tips").alias("title"))
    return S.keep_corrections(changes, titles, "page_id")

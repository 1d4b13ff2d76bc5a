"""Spelling: a dictionary from the corpus, delete neighbourhoods, a bigram model, and the correction ladder.

The dictionary is a bounded table (``size`` words, the most frequent ones); it is what the correction tasks hold in memory.
Corrections run once per distinct word and are joined back.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from searchlake.functions.dialect import quantised
from searchlake.functions.metaphone import encode
from searchlake.functions.text import words_of

# fixed values: thresholds of the ladder
RARE, COMMON, MOST_EDITS, STRANGE = 0.001, 0.01, 2, 1.4
#: Names that are never corrected, and known misspellings that always are.
PROTECTED = ("openai", "github", "gitlab", "kubernetes", "nginx", "postgres", "redis", "skoda", "isro", "vegan", "ramen", "biryani", "yawn")
SEEDS = {"pythn": "python", "pthon": "python", "housr": "house", "ngnix": "nginx", "embaras": "embarrass", "embarass": "embarrass", "programing": "programming", "recieve": "receive"}


def dictionary(docs: DataFrame, size: int = 15_000, least: int = 3) -> DataFrame:
    """(word, freq): letters only, at least three of them; frequency relative to the most common word."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.rlike("word", F.lit(r"^\p{L}{3,}$")))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    counts = counts.orderBy(F.desc("n"), "word").limit(size)  # the size of the dictionary
    most = F.max("n").over(Window.partitionBy())  # over these rows, no more
    return counts.select("word", quantised(F.col("n") / most.cast("double")).alias("freq"))


def held(words: DataFrame) -> DataFrame:
    """A dictionary, which is bounded, as a table at hand: the corpus is counted once, however often it is used."""
    return words.sparkSession.createDataFrame(words.toArrow())


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word))))


def delete_forms(word: Column) -> Column:
    """The distinct strings with one character less, and for words from four characters on two less."""
    one = _without_one(word)
    return F.when(F.length(word) < 3, F.array().cast("array<string>")).when(F.length(word) < 4, F.array_distinct(one)).otherwise(F.array_distinct(F.concat(one, F.flatten(F.transform(one, _without_one)))))


def meeting_forms(word: Column) -> Column:
    """The word and what is left of it without one or two characters. Words within two edits, swaps of neighbours included, share one."""
    one = F.when(F.length(word) >= 2, _without_one(word)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(word) >= 3, F.flatten(F.transform(one, _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def deletes(words: DataFrame) -> DataFrame:
    return words.select(F.explode(delete_forms(F.col("word"))).alias("form"), "word")


def bigrams(words: DataFrame) -> DataFrame:
    """(bigram, n, logp) with half added to each count."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    counts = words.where(F.length("word") >= 2).select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("k"))
    rows = counts.join(F.broadcast(total), F.lit(True))
    return rows.select("bigram", "n", F.log((F.col("n") + 0.5) / (F.col("t") + 0.5 * F.col("k"))).alias("logp"))


def perplexity(words: DataFrame, model: DataFrame) -> DataFrame:
    """(word, perplexity) of words of two characters or more, all of whose bigrams are in the model."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    rows = words.where(F.length("word") >= 2).select("word", F.explode(pairs).alias("bigram")).join(model.select("bigram", "logp"), "bigram")
    return rows.groupBy("word").agg(quantised(F.exp(-F.sum("logp") / F.count(F.lit(1)))).alias("perplexity"))


def meetings(typos: DataFrame, words: DataFrame) -> DataFrame:
    """(typo, word, freq) of all that share a form: an equi-join on the delete neighbourhoods.

    Words longer than any in the dictionary can be near to it are left alone: they would have very many forms.
    """
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    asked = typos.where(F.length("word") <= longest + MOST_EDITS).select(F.col("word").alias("typo"), F.explode(meeting_forms(F.col("word"))).alias("form"))
    known = words.select("word", "freq", F.explode(meeting_forms(F.col("word"))).alias("form"))
    return asked.join(known, "form").select("typo", "word", "freq").distinct()


def near_words(typos: DataFrame, words: DataFrame, most: int = MOST_EDITS) -> DataFrame:
    """Dictionary words within ``most`` (at most two) edits, as a scan of the whole dictionary would find them."""
    return meetings(typos, words).where(F.levenshtein("typo", "word", most) >= 0).select("typo", "word", "freq", F.levenshtein("typo", "word").alias("edits"))


def osa_distance(a: str, b: str, most: int = MOST_EDITS) -> int:
    """Edits with swaps of neighbours, no part edited twice. Beyond a length gap of ``most`` only the gap is told."""
    gap = abs(len(a) - len(b))
    if gap > most:
        return max(gap, most + 1)
    table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, start=1):
        for j, y in enumerate(b, start=1):
            best = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, table[i - 2, j - 2] + (x != y))
            table[i, j] = best
    return table[len(a), len(b)]


def nearest(typos: DataFrame, words: DataFrame) -> DataFrame:
    """(typo, best, edits, freq): of the words that share a form and are within ``MOST_EDITS`` edits and swaps the nearest, then the most frequent."""

    @F.pandas_udf(IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa_distance(x, y) for x, y in zip(a, b)], dtype="int32")

    plain = F.levenshtein("typo", "word")
    # beyond twice as many plain edits swaps don't help
    near = meetings(typos, words).where(plain <= 2 * MOST_EDITS)
    near = near.withColumn("edits", F.when(plain <= 1, plain).otherwise(distance("typo", "word"))).where(F.col("edits") <= MOST_EDITS)
    best = F.min(F.struct("edits", (-F.col("freq")).alias("minus"), "word")).alias("b")
    return near.groupBy("typo").agg(best).select("typo", F.col("b.word").alias("best"), F.col("b.edits").cast("int").alias("edits"), (-F.col("b.minus")).alias("freq"))


def collapsed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


@F.pandas_udf(StringType())
def sound_code(words: pd.Series) -> pd.Series:
    """The Double Metaphone code of ASCII words, null for others."""
    return words.map(lambda w: encode(w) or None if w is not None and w.isascii() else None)


def letters_dropped(typo: Column, word: Column) -> Column:
    """The typo is the word without one or more of its letters."""
    place = F.aggregate(F.split(typo, ""), F.lit(0), lambda at, c: F.when(at >= 0, F.coalesce(F.nullif(F.call_function("locate", c, word, at + 1), F.lit(0)), F.lit(-1))).otherwise(-1))
    return (F.length(word) > F.length(typo)) & (place >= 0)


def sound_matches(typos: DataFrame, words: DataFrame, most: int = 3) -> DataFrame:
    """(typo, word, freq, dropped) of common words of the same sound that the typo, absent from the dictionary, drops up to ``most`` letters of: an equi-join on the code."""
    asked = typos.select(F.col("word").alias("typo")).distinct().join(words.select("word"), F.col("typo") == F.col("word"), "left_anti").withColumn("code", sound_code("typo"))
    named = words.where(F.col("freq") >= COMMON).select("word", "freq").withColumn("code", sound_code("word"))
    dropped = F.length("word") - F.length("typo")
    return asked.where("code is not null").join(named, "code").where(dropped.between(1, most) & letters_dropped(F.col("typo"), F.col("word"))).select("typo", "word", "freq", dropped.alias("dropped"))


def with_seeds(words: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """The dictionary with the known misspellings, as rare words, and what they stand for."""
    seeds = SEEDS if seeds is None else seeds
    more = {right: 0.05 for right in seeds.values()} | {typo: RARE for typo in seeds if typo not in seeds.values()}
    return words.unionByName(words.sparkSession.createDataFrame(list(more.items()), "word string, freq double").join(words.select("word"), "word", "left_anti"))


class Speller:
    """The correction ladder: a dictionary with its seeds held in memory, candidates from joins."""

    def __init__(self, words: dict[str, float], protected=PROTECTED, seeds=None):
        self.words = dict(words)
        self.seeds = SEEDS if seeds is None else seeds
        for typo, right in self.seeds.items():
            self.words.setdefault(right, 0.05)
            self.words.setdefault(typo, RARE)
        self.protected = frozenset(protected)
        counts: dict[str, int] = {}
        for word in self.words:
            for i in range(len(word) - 1):
                counts[word[i : i + 2]] = counts.get(word[i : i + 2], 0) + 1
        whole = sum(counts.values()) + 0.5 * len(counts) or 1.0
        self.logp = {b: math.log((n + 0.5) / whole) for b, n in counts.items()}
        self.unseen = math.log(0.5 / whole)

    def perplexity(self, word: str) -> float:
        if len(word) < 2:
            return 0.0
        return math.exp(-sum(self.logp.get(word[i : i + 2], self.unseen) for i in range(len(word) - 1)) / (len(word) - 1))

    def strangeness(self, word: str, candidate: str) -> float:
        a, b = self.perplexity(word), self.perplexity(candidate)
        return a / b if a > 0 and b > 0 else 1.0

    def candidates(self, word: str, others) -> list[tuple[int, float, str]]:
        """(edits, -frequency, word) of those among ``others`` that can stand for the word, nearest and most frequent first."""
        fit = [o for o in set(others) if o != word and self.words.get(o, 0) >= RARE and set(o[:3]) & set(word[:3])]
        return sorted((edits, -self.words[o], o) for o in fit if (edits := osa_distance(word, o)) <= MOST_EDITS)

    def sounds_like(self, word: str, sounds) -> str | None:
        """Of common words of the same sound that the input drops letters of, the nearest, then the most frequent."""
        fit = [w for w in set(sounds) if self.strangeness(word, w) <= STRANGE]
        return min(fit, key=lambda w: (len(w), -self.words[w], w), default=None)

    def correct(self, word: str, others=(), sounds=()) -> str | None:
        """The correction of a lower-case word, or nothing; ``others`` are the dictionary words that share a delete form with it, ``sounds`` its :func:`sound_matches`."""
        if len(word) < 3 or (len(word) == 3 and word in self.words) or word in self.protected:
            return None
        if word in self.seeds:
            return self.seeds[word]
        freq = self.words.get(word)
        if freq is not None and freq >= COMMON:
            return None
        near = self.candidates(word, others)
        if not near:
            return self.sounds_like(word, sounds) if freq is None else None
        edits, minus, best = near[0]
        if freq is not None:
            one_letter = len(word) == len(best) and sum(a != b for a, b in zip(word, best)) == 1
            # a real word is not turned into another by one letter, nor into a rarer one
            return None if one_letter or -minus < freq else best
        if edits >= 2:
            return best if collapsed(word) == collapsed(best) else None
        return best if self.strangeness(word, best) >= STRANGE else None


_SKIP = r"[./\\@#$]|\d"


def correct_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, corrected) of every distinct word that the ladder changes."""
    known = with_seeds(known)
    table = {r["word"]: r["freq"] for r in known.collect()}  # the dictionary, bounded by its size
    shared = words.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("word", pa.string()), ("corrected", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value)
        for batch in batches:
            rows = [(w, speller.correct(w, others, sounds)) for w, others, sounds in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], schema=schema)

    asked = words.select("word").distinct().where((F.length("word") >= 4) & ~F.rlike("word", F.lit(_SKIP)))
    near = meetings(asked, known).groupBy(F.col("typo").alias("word")).agg(F.collect_list(F.col("word")).alias("others"))  # of the dictionary, so bounded
    heard = sound_matches(asked, known).groupBy(F.col("typo").alias("word")).agg(F.collect_list(F.col("word")).alias("sounds"))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return asked.join(near, "word", "left").join(heard, "word", "left").select("word", listed("others"), listed("sounds")).mapInArrow(run, "word string, corrected string")


def correct_queries(queries: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, text, corrected, changed): words corrected one by one and put back in their places."""
    tokens = queries.select(key, F.posexplode(F.split("text", " ")).alias("pos", "token")).withColumn("word", F.lower("token"))
    fixed = correct_words(tokens.select("word"), known)
    rows = tokens.join(fixed, "word", "left").withColumn("out", F.coalesce("corrected", "token"))
    # a query's words are few; they are put in order again
    joined = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("t"), F.max(F.col("corrected").isNotNull()).alias("changed"))
    return queries.join(joined, key).select(key, "text", F.array_join(F.transform("t", lambda x: x["out"]), " ").alias("corrected"), "changed")


def keep_corrections(changes: DataFrame, titles: DataFrame, key: str, most: int = 20, least: int = 5) -> DataFrame:
    """(key, original, corrected, keep): the returned titles hold the corrected word more often than the original one."""
    first = titles.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "title"))), 1, most).alias("t"))
    rows = changes.join(first, key, "left")
    hits = lambda w: F.size(F.filter("t", lambda x: F.array_contains(words_of(x["title"]), F.col(w))))
    few = F.coalesce(F.size("t") < least, F.lit(True))
    return rows.select(key, "original", "corrected", F.when(few | (F.col("original") == F.col("corrected")), True).otherwise(hits("corrected") > hits("original")).alias("keep"))

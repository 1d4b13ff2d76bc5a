"""Double Metaphone, the phonetic join and the correction ladder over tables."""

import pytest
from pyspark.sql import functions as F

from searchlake.functions.metaphone import encode
from searchlake.operators import spelling as S

# published pairs of words and primary codes
CODES = {
    "testing": "TSTN", "The": "0", "quick": "KK", "brown": "PRN", "fox": "FKS", "jumped": "JMPT", "over": "AFR", "lazy": "LS", "dogs": "TKS", "MacCafferey": "MKFR", "Stephan": "STFN", "Kuczewski": "KSSK", "McClelland": "MKLL",
    "San Jose": "SNHS", "xenophobia": "SNFP", "Fokker": "FKR", "Joqqi": "JK", "Hovvi": "HF", "Czerny": "SRN", "Smith": "SM0", "Schmidt": "XMT", "Catherine": "K0RN", "Knight": "NT", "Wright": "RT", "laugh": "LF", "sugar": "XKR",
    "bacchus": "PKS", "Caesar": "SSR", "Chianti": "KNT", "focaccia": "FKX", "edge": "AJ", "edgar": "ATKR", "ghost": "KST", "ghislane": "JLN", "cagney": "KKN", "tagliaro": "TKLR", "school": "SKL", "Filipowicz": "FLPT", "breaux": "PR",
    "zhao": "J", "Thumb": "0M", "island": "ALNT", "resnais": "RSN", "Campbell": "KMPL", "architect": "ARKT", "orchestra": "ARKS", "": "", "123": "", "  ": "",
}


@pytest.mark.parametrize("word", sorted(CODES))
def test_published_codes(word):
    assert encode(word) == CODES[word]


def dropped(typo, word):
    letters = iter(word)
    return all(c in letters for c in typo)


def test_phonetic_join_equals_a_scan(spark):
    words = {w: 0.02 + i / 1000 for i, w in enumerate("committee restaurant knight night necessary separate definitely tomorrow beautiful laughter daughter straight bookkeeper occasion über".split())} | {"comity": 0.001}
    asked = ["comitee", "restrant", "nite", "knigt", "nght", "necesary", "seprate", "definitly", "tomorow", "beatiful", "lafter", "dauter", "bokeeper", "ocasion", "committee", "brn", "bxyz", "r", "", "ubr", None]
    want = {
        (a, w, f, len(w) - len(a)) for a in asked if a and a.isascii() and a not in words and encode(a) for w, f in words.items()
        if w.isascii() and f >= S.COMMON and encode(a) == encode(w) and 1 <= len(w) - len(a) <= 3 and dropped(a, w)
    }
    known = spark.createDataFrame(list(words.items()), "word string, freq double")
    got = S.sound_matches(spark.createDataFrame([(a,) for a in asked], "word string"), known)
    assert {tuple(r) for r in got.collect()} == want and {a for a, *_ in want} >= {"comitee", "necesary", "tomorow", "bokeeper"}


def test_letters_dropped(spark):
    pairs = [("abc", "abc"), ("ac", "abc"), ("ca", "abc"), ("aa", "aba"), ("aa", "ab"), ("", "a"), ("abcd", "abc"), ("hss", "hisses"), ("é", "éa")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.letters_dropped(F.col("a"), F.col("b")).alias("d")).collect()
    assert {(r.a, r.b): bool(r.d) for r in got} == {(a, b): len(b) > len(a) and dropped(a, b) for a, b in pairs}


def test_nearest_counts_swaps(spark):
    words = spark.createDataFrame([("nginx", 0.5), ("abc", 0.3), ("house", 0.2), ("horse", 0.4), ("letter", 0.1), ("tables", 0.1)], "word string, freq double")
    typos = spark.createDataFrame([(t,) for t in ("ngnix", "hose", "hosue", "eltetr", "zzzzzz", "hoxse", "atblse")], "word string")
    got = {r.typo: (r.best, r.edits) for r in S.nearest(typos, words).collect()}
    assert got == {"ngnix": ("nginx", 1), "hose": ("horse", 1), "hosue": ("house", 1), "eltetr": ("letter", 2), "hoxse": ("horse", 1), "atblse": ("tables", 2)}


def test_ladder_over_a_table(spark):
    known = spark.createDataFrame([("committee", 0.5), ("house", 0.4), ("raven", 0.3), ("programming", 0.2)], "word string, freq double")
    asked = spark.createDataFrame([(w,) for w in ("comite", "housr", "ramen", "pythn", "programing", "house", "v1.2", "ab", "openai", "committee")], "word string")
    got = {r.word: r.corrected for r in S.correct_words(asked, known).collect()}
    # found by sound alone: three letters are missing; seeds stand for themselves and are words to correct to
    assert got == {"comite": "committee", "housr": "house", "pythn": "python", "programing": "programming"}

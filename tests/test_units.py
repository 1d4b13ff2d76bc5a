"""Literal cases: each states a behaviour in one line."""

import math
import re

import pytest
from pyspark.sql import functions as F

from searchlake.functions import predicates as P
from searchlake.functions import querylang as L
from searchlake.functions import text as T
from searchlake.functions import url as U
from searchlake.operators import commerce as C
from searchlake.operators import retrieval as R
from searchlake.operators import sequences as Q
from searchlake.operators import spelling as S
from searchlake.operators import understand as N


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x long"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://web.archive.org/web/20200101/https://example.com/page", "example.com/page"),
        ("https://web.archive.org/web/3/https%3A%2F%2Fexample.com%2Fpage", "example.com/page"),
        ("HTTPS://Example.COM:8080/A/b/?q=1#x", "example.com/a/b"),
        ("Not A Url", "not a url"),
        ("https://web.archive.org/web/1/https://web.archive.org/web/2/http://a.org/x/", "a.org/x"),
    ],
)
def test_canonical(spark, url, expected):
    assert one(spark, U.canonical(F.col("u")), u=url) == expected


@pytest.mark.parametrize("url, expected", [("http://a.com/x/#frag", "http://a.com/x"), ("HTTP://A.com/", "http://a.com"), ("http://a.com/?q=/", "http://a.com/?q=")])
def test_crawl_key(spark, url, expected):
    assert one(spark, U.crawl_key(F.col("u")), u=url) == expected


@pytest.mark.parametrize("value, expected", [("https://u:p@Shop.Example.com.:8080/x", "shop.example.com"), ("shop.com?x", "shop.com"), ("a.b:x", "a.b:x")])
def test_bare_host(spark, value, expected):
    assert one(spark, U.bare_host(F.col("u")), u=value) == expected


@pytest.mark.parametrize("host, expected", [("example-merchant.com", True), ("foo.test", True), ("localhost", True), ("testosterone-shop.com", False), ("invalid-syntax.co.uk", False), ("notexample.com", False)])
def test_reserved(spark, host, expected):
    assert one(spark, U.reserved_host(F.col("h")), h=host) is expected
    assert one(spark, U.placeholder_url(F.concat(F.lit("https://"), F.col("h"), F.lit("/x"))), h=host) is expected


@pytest.mark.parametrize("url, kind", [("https://x.org/article/1", "news"), ("https://docs.x.org/", "documentation"), ("https://x.org/q/1", "forum"), ("https://x.org/pricing", "product"), ("https://x.org/essay/1", "article"), ("https://x.org/", "homepage"), ("https://x.org/a", "unknown")])
def test_content_type(spark, url, kind):
    assert one(spark, U.content_type(F.col("u")), u=url) == kind


def test_authority(spark):
    assert abs(one(spark, U.authority(F.col("u")), u="https://docs.x.edu/docs/") - 1.0) < 1e-9
    assert abs(one(spark, U.authority(F.col("u")), u="https://x.com/") - 0.6) < 1e-9
    assert abs(one(spark, U.authority(F.col("u")), u="https://x.com/clickbait") - 0.4) < 1e-9


def test_text(spark):
    assert one(spark, T.bounded(F.col("s")), s="One. Two") == "One." and one(spark, T.bounded(F.col("s")), s="none") == "none"
    assert one(spark, T.entropy(F.col("s")), s="abab") == 1.0 and one(spark, T.entropy(F.col("s")), s="éé") is None
    assert one(spark, T.rough_epoch(F.col("s")), s="2026-05-26T10:30:00Z") == ((2026 - 1970) * 365 + 4 * 30 + 26) * 86400
    assert one(spark, T.rough_epoch(F.col("s")), s="1999-05-26") is None
    assert one(spark, T.exact_epoch(F.col("s")), s="1970-01-02") == 86400
    assert one(spark, T.fingerprint(F.lit("A b!"), F.col("s")), s="C, d") == "ab|cd"
    assert one(spark, T.truncated(F.col("s"), 10), s="hello brave world") == "hello..."
    assert one(spark, T.points(F.col("s")), s="a. b; c\nd. e") == ["a", "b", "c", "d"]
    assert [one(spark, T.currency(F.col("s")), s=x) for x in ("$5 CAD", "20 euro", "Rs 5", "¥", "?")] == ["CAD", "EUR", "INR", "JPY", "USD"]


def test_page_title(spark):
    assert one(spark, T.page_title(F.col("h")), h="<html></html>") == "No Title"


def test_predicates(spark):
    assert one(spark, P.junk(F.col("s")), s="We cannot provide a description for this page right now") is True
    assert one(spark, P.junk(F.col("s")), s="short") is True and one(spark, P.junk(F.col("s"), F.lit(True)), s="short") is False
    adult = lambda t, u: one(spark, P.adult(F.col("t"), F.col("u")), t=t, u=u)
    assert adult("x", "https://a.com/adult-games/") and adult("free porn", "https://a.com/") and not adult("Adult Education in Essex", "https://essex.org/cockpit")
    kinds = {"tell me a joke": "joke", "who won the cup": "who_won", "who is ada": "factual_person", "what is dark matter": "definition", "what happened in 1923": "news_event", "how many days": "factual_thing", "red shoes": "general"}
    assert {q: one(spark, P.query_kind(F.col("q")), q=q) for q in kinds} == kinds
    assert one(spark, P.required_entities(F.col("q")), q="who is the president of France?") == ["france"]
    assert one(spark, P.required_entities(F.col("q")), q="what happened in 1923") == []
    assert one(spark, P.listicle(F.col("t"), F.lit(""), F.lit("")), t="150 funny quotes") is True
    assert one(spark, P.goal_error(F.col("g")), g="a1") == "empty_goal" and one(spark, P.goal_error(F.col("g")), g="12 34") == "invalid_goal"


def test_query_columns(spark):
    text = lambda f, q: one(spark, f(F.col("q")), q=q)
    assert text(L.destuttered, "how how to to set up set up redis") == "how to set up redis"
    assert text(L.sanitised, "the cheap cheap cars under") == "cheap cars"
    assert text(L.phrases, "find “solid state” now") == ["solid state"]
    assert (text(L.price_low, ">3000"), text(L.price_high, ">3000")) == (3000.0, None)
    assert (text(L.price_low, "10-20"), text(L.price_high, "10-20")) == (10.0, 20.0) and text(L.price_high, "<200") == 200.0
    assert text(L.language, "recette gateau pour enfants") == "fr" and text(L.language, "best laptop") is None
    assert [text(L.stem, w) for w in ("securing", "running", "testing", "kindness", "cats", "glass")] == ["security", "run", "testing", "kind", "cat", "glass"]
    assert text(N.entities, "best python web framework") == ["python", "web", "framework"]
    variants = one(spark, N.subsets(N.entities(F.col("q"))), q="python web framework")
    assert variants[:2] == ["python web framework", "python framework"] and len(variants) == 7


@pytest.mark.parametrize(
    "query, label", [("cats vs dogs", "comparison"), ("react vs vue", "technical"), ("is a better than b", "comparison"), ("how to bake bread", "how-to"), ("hello there", "chitchat"), ("latest ai news", "fresh"), ("kubernetes ingress", "technical"), ("red shoes", "informational")]
)
def test_intents(spark, query, label):
    rows = spark.createDataFrame([(query, "informational", 0.3)], "q string, intent string, confidence double")
    assert L.with_intent(rows, "q").first().intent == label


@pytest.mark.parametrize("text, expected", [("two hundred fifty", "250"), ("one thousand two hundred", "1200"), ("nineteen cats", "19 cats"), ("hundred", "hundred")])
def test_spoken_numbers(text, expected):
    assert L.spoken_to_digits(text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("boots under four hundred", "boots price:<400"), ("over five years of use", "over 5 years of use"), ("in url:github", "inurl:github"), ("onsite reddit", "site:reddit"), ("in title:guide", "intitle:guide")],
)
def test_canonical_operators(text, expected):
    assert L.canonical_operators(text) == expected


def test_constraints():
    got = L.constraints("python web frameworks without django or flask")
    assert got["negative"] == ["django", "flask"] and not {"django", "flask"} & set(" ".join(got["positive"]).split())
    got = L.constraints("i have no calculus background learn probability and statistics")
    assert "calculus" in got["negative"] and "statistics" not in got["negative"]
    got = L.constraints('boots under four hundred site:shop.com -site:ads.com "red leather"')
    assert got["price_max"] == 400 and got["sites"] == ["shop.com"] and got["negative"] == ["site:ads.com"] and got["phrases"] == ["red leather"]
    assert "nosql" in L.constraints("fast no sql database")["positive"]
    assert "notion" in L.constraints("alternative to notion")["negative"]
    assert L.constraints("better than slack")["comparisons"] == ["slack"]


@pytest.mark.parametrize("lead", ["not", "except", "excluding", "without", "other than", "besides", "no", "minus"])
def test_negation_leads(lead):
    got = L.constraints(f"running shoes {lead} nike")
    assert got["negative"] == ["nike"] and not any("nike" in p for p in got["positive"])


def test_expansions():
    out = L.expansions("react vs vue vs angular", "comparison", [], [])
    assert {"react vs vue", "vue vs angular", "react"} <= set(out) and len(out) == len({o.lower() for o in out})
    assert L.expansions("web frameworks without django", "informational", ["django"], [])[1] == "web frameworks"
    assert L.compressed("a b c", frozenset(), frozenset()) == "a b c"
    assert len(L.compressed(" ".join(f"word{i}" for i in range(30)), frozenset(), frozenset()).split()) == 14


@pytest.mark.parametrize("a, b, d", [("ngnix", "nginx", 1), ("pythn", "python", 1), ("abc", "abcdef", 3), ("ca", "abc", 3), ("same", "same", 0), ("kitten", "sitting", 3)])
def test_edit_distance(a, b, d):
    assert S.osa_distance(a, b) == d


def test_ladder():
    words = {w: 0.5 for w in ("python", "house", "nginx", "embarrass", "opened", "raven", "soda", "yarn", "bryan", "vegas", "cancelling")} | {"vegan": 0.002}
    speller = S.Speller(words)
    assert {w: speller.correct(w, words) for w in ("pythn", "housr", "ngnix", "embaras", "embarass")} == {"pythn": "python", "housr": "house", "ngnix": "nginx", "embaras": "embarrass", "embarass": "embarrass"}
    assert all(speller.correct(w, words) is None for w in ("openai", "ramen", "skoda", "yawn", "isro", "biryani", "vegan", "kubernetes", "go", "nginx"))


def test_affiliate_link(spark):
    network = {"kind": "wrap", "template": "https://n.net/?k={key}&u={url}", "params": {"cuid": "{subid}", "gone": "{param:x}"}, "bid_floor": "0.1", "fallback_url": "https://f.org/a b"}
    got = one(spark, C.affiliate_link(network, F.col("u"), F.lit("shop.com"), key="K"), u="https://shop.com/p?a=1&b=c d")
    assert got == "https://n.net/?k=K&u=https%3A%2F%2Fshop.com%2Fp%3Fa%3D1%26b%3Dc%20d&cuid=shop.com&bf=0.1&fbu=https%3A%2F%2Ff.org%2Fa%20b"
    plain = {"kind": "append_params", "template": "{url}", "params": {"tag": "{key}"}}
    assert one(spark, C.affiliate_link(plain, F.col("u"), F.lit("s"), key="K"), u="https://shop.com/p") == "https://shop.com/p?tag=K"


def test_offers(spark):
    rows = [("GTIN1", "a", 19.99, 100), ("GTIN1", "b", 9.99, 200), ("GTIN2", "c", 5.0, 100)]
    got = C.compare_offers(spark.createDataFrame(rows, "product_id string, merchant string, price double, observed_at long")).collect()
    assert [(r.product_id, r.best_price, r.best_merchant, r.mixed_times) for r in got] == [("GTIN1", 9.99, "b", True)]


def test_fusion_never_loses_lexical_hits(spark):
    lexical = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id long, doc_id long, rank long")
    semantic = spark.createDataFrame([(1, 9, 1), (1, 2, 2)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.rrf for r in R.fuse(lexical, semantic).collect()}
    assert set(range(1, 6)) < set(got) and abs(got[2] - 2 / 62) < 1e-12


def test_diversity(spark):
    rows = [(1, i, f"d{i % 2}", 1.0 / (i + 1)) for i in range(20)]
    got = R.diverse_top(spark.createDataFrame(rows, "query_id long, doc_id long, domain string, score double"), "domain").collect()
    assert len(got) == 6 and max(r.score for r in got) == 1.0


def test_generations(spark):
    got = Q.generations(spark.createDataFrame([(i, i) for i in range(101)], "k long, first long"), "k", "first", 10).collect()
    kept = {r.k for r in got if r.kept}
    assert len(kept) <= 10 and 100 in kept and 0 not in kept


def test_brace_scanners():
    from searchlake.operators import cleaning as K

    assert K.without_structured_data('a {"@context":"x","i":[{"p":1}]} b') == "a  b"
    assert K.without_structured_data('before "{"@type":"X" after') == 'before "' and K.without_structured_data("keep {this} too") == "keep {this} too"
    assert K.without_styles("x @media (a) { #r { color: red } } y").split() == ["x", "@media", "(a)", "y"]
    assert K.without_styles("{ background: url(http://a}b) } text").strip() == "text"
    assert K.without_styles("He said {well. That is} it") == "He said {well. That is} it" and K.without_styles("open { never closed") == "open { never closed"


def test_prices():
    from searchlake.operators import cleaning as K

    assert K.page_price('<script type="application/ld+json">{"@graph":[{"offers":{"lowPrice":"1,299.5","priceCurrency":"GBP"}}]}</script>') == (1299.5, "GBP")
    assert K.page_price('<span itemprop="price">12</span>') == (12.0, "USD") and K.page_price("<p>$5</p>") is None and K.page_price('<script type="application/ld+json">{bad</script>') is None


def test_title_echo(spark):
    from searchlake.operators import cleaning as K

    echo = lambda c, t: one(spark, K.title_echo(F.col("c"), F.col("t")), c=c, t=t)
    title = "The complete guide to gardens"
    assert echo(title, title) == "" and echo(f"{title} - Roses are red.", title) == "Roses are red." and echo("The complete guide to", title) == ""
    assert echo("The com nothing", title) == "The com nothing" and echo("", title) == ""


def test_naming_questions(spark):
    from searchlake.operators import cleaning as K

    asks = lambda q: one(spark, K.naming_question(F.col("q")), q=q)
    assert asks("why is the apache web server named after a helicopter") and asks("why is dallas called the big d") and asks("where does the name ford come from")
    assert not asks("how to make biryani at home") and not asks("best mechanical keyboard for programming")


def test_measures_against_plain_counts(spark):
    texts = ["", " \t\n", "abab", "éé", "Été: 3 ﬁn, ŒUVRE　漢字 \U0001f600 𝒳 x", "a\x0bb\fc\rd", "word " * 900, "é" * 1990 + "abc" * 50, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, s string").select("k", T.measures(F.col("s")).alias("m")).collect()
    assert len(rows) == len(texts)
    for k, m in rows:
        if texts[k] is None:
            assert m is None or tuple(m) == (None,) * 4
            continue
        head = [c for c in texts[k][:2000] if ord(c) < 128]
        shares = [head.count(c) / len(head) for c in set(head)]
        assert (m.entropy is None) == (not head) and (not head or abs(m.entropy + sum(p * math.log2(p) for p in shares)) < 1e-9)
        words = re.split("[ \t\n\x0b\f\r]+", texts[k])
        assert (m.letters, m.words) == (sum(map(str.isalpha, texts[k])), len([w for w in words if w])) and m.solid == sum(len(w.encode()) for w in words)

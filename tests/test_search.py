"""Query syntax and ranked search against plain evaluation."""

import math
import re
import shutil
from collections import Counter

import pytest

from searchlake.catalog import all_queries
from searchlake.functions.querysyntax import matches, parse
from searchlake.operators import search as S

DOCS = [
    (1, "copper lantern", "repair the copper lantern at home"), (2, "silver harbour", "a harbour of silver, copper and tin"), (3, "", "lantern copper lantern copper lantern"),
    (4, "harbour market", None), (5, "tin", "the market by the harbour sells tin; copper is sold out"), (6, "lantern", "silver silver silver"),
]
QUERIES = [
    "copper", "copper lantern", '"copper lantern"', '"lantern copper lantern"', "title:lantern", "title:(copper OR silver) AND harbour", "+copper -lantern", "harbour AND NOT tin", "(copper tin) AND (silver OR market)",
    "copper -title:lantern^2", "+(harbour -silver) +tin^3", 'well-kept "silver silver"', "the the copper", "zygote", "a AND b OR tin", "NOT NOT x", "", "-copper", "copper AND", '"copper', "(copper", "copper)", "colour:red", "*", "a:b:c", "!!! tin", None,
]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_search(text):
    """doc_id -> score by the definition of BM25, one document at a time."""
    parsed, out = parse(text), {}
    if parsed.everything:
        return {d[0]: 1.0 for d in DOCS}
    tables = {f: {d[0]: words(d[k]) for d in DOCS} for k, f in ((1, "title"), (2, "content"))}
    means = {f: sum(map(len, t.values())) / len(DOCS) for f, t in tables.items()}

    def part(leaf, field, doc_id):
        mine = tables[field][doc_id]
        n = len(leaf.words)
        tf = sum(tuple(mine[i : i + n]) == leaf.words for i in range(len(mine)))
        dfs = [sum(w in x for x in tables[field].values()) for w in sorted(set(leaf.words))]
        idf = sum(math.log(1 + (len(DOCS) - df + 0.5) / (df + 0.5)) for df in dfs)
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(mine) / means[field])) if tf else None

    def score(steps, found):
        stack = []
        for kind, a, b, c in steps:
            if kind == "leaf":
                stack.append((a in found, found.get(a, 0.0)))
                continue
            mine = stack[len(stack) - a - b - c :]
            del stack[len(stack) - a - b - c :]
            musts, shoulds, nots = mine[:a], mine[a : a + b], mine[a + b :]
            fit = all(m for m, _ in musts) and not any(m for m, _ in nots) and (a > 0 or any(m for m, _ in shoulds))
            stack.append((fit, sum(s for _, s in musts + shoulds) if fit else 0.0))
        return stack[-1]

    for doc_id, *_ in DOCS:
        found = {}
        for i, leaf in enumerate(parsed.leaves):
            parts = [p for f in ([leaf.field] if leaf.field else ["title", "content"]) if (p := part(leaf, f, doc_id)) is not None]
            if parts:
                found[i] = sum(parts) * leaf.boost * leaf.scored
        fit, total = (bool(found), sum(found.values())) if parsed.plain else score(parsed.steps, found)
        assert fit == matches(parsed, set(found))
        if fit:
            out[doc_id] = total
    return out


@pytest.fixture(scope="module")
def index(spark):
    return S.build(spark.createDataFrame(DOCS, "doc_id long, title string, content string"), ("title", "content"))


def test_scores_of_every_kind_of_query(spark, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = {}
    for r in S.scores(asked, index).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    for i, text in enumerate(QUERIES):
        want = plain_search(text)
        assert set(got.get(i, {})) == set(want), text
        assert all(abs(got[i][d] - s) < 2e-6 for d, s in want.items()), text


@pytest.mark.parametrize(
    "text, everything, plain, leaves",
    [
        ("", True, False, []), ("  ", True, False, []), ("a b a", False, True, [("a",), ("b",)]), ("-a", True, False, []), ("a -b", False, False, [("a",), ("b",)]), ("foo:a", True, False, []), ("l'eau", False, False, [("l", "eau")]),
        ("AND a", True, False, []), ("a OR", True, False, []), ("(a", True, False, []), ("a)", True, False, []), ('"a b', True, False, []), ("android ORacle", False, True, [("android",), ("oracle",)]), ("(" * 60 + "a" + ")" * 60, True, False, []),
        ("...", True, False, []), ("a^", True, False, []), ("[a TO b]", False, True, [("a",), ("to",), ("b",)]),
    ],
)
def test_parse(text, everything, plain, leaves):
    p = parse(text)
    assert (p.everything, p.plain, [x.words for x in p.leaves]) == (everything, plain, leaves)


def test_the_last_of_twelve_words_decides(spark, tmp_path):
    common = "one two three four five six seven eight nine ten eleven"
    texts = [(i, common + " filler words here", "src0") for i in range(20)] + [(99, common + " zirconium", "src1")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, common + " zirconium"), (2, "nothing matches this")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    best = [r for r in all_queries()["search_fast"](spark, str(tmp_path)).collect() if r.query_id == 1 and r.position == 1]
    assert [r.doc_id for r in best] == [99]
    quality = {(r.query_id, r.doc_id): r.overlap for r in all_queries()["signal_quality"](spark, str(tmp_path)).collect()}
    assert quality[1, 99] == 1.0 and {q for q, _ in quality} == {1}
    gaps = {(r.query_id, r.term) for r in all_queries()["recall_gap"](spark, str(tmp_path)).collect()}
    assert gaps == {(1, "zygomatic1"), (1, "photography"), (2, "zygomatic2"), (2, "photography"), (2, "nothing"), (2, "matches")}


def test_the_index_follows_its_files(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    rows = lambda n: spark.createDataFrame([(i, "tin " * (i + 1)) for i in range(n)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    made = []
    for n in (3, 4):
        rows(n)
        source = spark.read.parquet(path)
        made.append(S.index_of(spark, source, source.select("doc_id", source.text.alias("content")), ("content",), "documents"))
    assert [m.count for m in made] == [3, 7]
    again = S.index_of(spark, source, source, ("content",), "documents")
    assert again is made[1]
    assert Counter(r.term for r in again.terms.collect()) == {"tin": 1}
    shutil.rmtree(f"{again.folder}/terms")  # a folder that was cleared is written again
    assert S.index_of(spark, source, source.select("doc_id", source.text.alias("content")), ("content",), "documents").terms.count() == 1


def test_an_empty_table(spark):
    none = S.build(spark.createDataFrame([], "doc_id long, content string"), ("content",))
    asked = spark.createDataFrame([(1, "tin"), (2, ""), (3, '"a b"')], "query_id long, text string")
    assert S.ranked(asked, none).count() == 0

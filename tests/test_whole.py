"""Queries do the whole job: small tables, expected rows by brute force."""

import math

from searchlake.catalog import all_queries
from searchlake.functions import querylang as L
from searchlake.operators import retrieval as R
from searchlake.operators import sequences as Q
from searchlake.operators import vectors as V


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_topic_overlap_of_all_retrieved_pairs(spark, tmp_path):
    asks = [(1, "copper lantern repair guide"), (2, "silver harbour market"), (3, "unseen words only")]
    texts = [(7, "A copper lantern. Nothing else"), (13, "the silver harbour and the copper market"), (50, "no topic here"), (101, "repair the lantern, copper"), (102, "harbour silver harbour")]
    table(spark, tmp_path, "documents", [(i, t, "src0") for i, t in texts], "doc_id long, text string, source string")
    table(spark, tmp_path, "benchmark", asks, "item_id long, text string")
    got = {(r.query_id, r.doc_id): r.overlap for r in all_queries()["topic_overlap"](spark, str(tmp_path)).collect()}
    retrieved = {(r.query_id, r.doc_id) for r in all_queries()["signal_quality"](spark, str(tmp_path)).collect()}
    assert set(got) == retrieved and {d for _, d in got} == {7, 13, 101, 102}
    for (q, d), overlap in got.items():
        terms = [w for w in dict(asks)[q].split() if len(w) >= 3 and w not in R.TOPIC_STOPS]
        hay = " " + dict(texts)[d].lower()
        assert abs(overlap - sum(f"{w} " in hay or f"{w}." in hay for w in terms) / len(terms)) < 1e-6


def test_every_twentieth_vector_is_asked(spark, tmp_path):
    vectors = {i: [math.cos(0.37 * i), math.sin(0.37 * i), math.cos(0.11 * i)] for i in range(70)}
    table(spark, tmp_path, "embeddings", [(i, v, i % 3) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int")
    table(spark, tmp_path, "documents", [(i, f"copper lantern number {i}", "src0") for i in range(4)], "doc_id long, text string, source string")
    table(spark, tmp_path, "benchmark", [(33, "copper lantern")], "item_id long, text string")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    plain = lambda x: math.floor(x * 1e6 + 0.5) / 1e6
    dots = {(q, v): plain(dot(vectors[q], vectors[v])) for q in range(0, 70, 20) for v in vectors if v != q}
    cosines = {(q, v): plain(dot(vectors[q], vectors[v]) / math.sqrt(dot(vectors[q], vectors[q]) * dot(vectors[v], vectors[v]))) for q, v in dots}
    for name, scores in (("vector_dot_topk", dots), ("vector_cosine_topk", cosines)):
        expected = {(q, r, v, s) for q in range(0, 70, 20) for r, (v, s) in enumerate(sorted(((v, s) for (p, v), s in scores.items() if p == q), key=lambda x: (-x[1], x[0]))[:10], 1)}
        assert {tuple(r) for r in all_queries()[name](spark, str(tmp_path)).collect()} == expected
    got = all_queries()["semantic_gate"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.vec_id): r.sim for r in got} == {k: s for k, s in dots.items() if s >= R.SEMANTIC_EACH}
    fused = all_queries()["hybrid_rrf"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.doc_id) for r in fused if not r.lexical} == {k for k, s in dots.items() if s >= 0.3}
    assert {r.query_id for r in fused if r.lexical} <= {33}


def test_block_scores_of_small_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)] + [(50, [1.0]), (51, None)], "vec_id long, v array<double>")
    whole = {tuple(r) for r in V.block_scores(rows, rows.where("vec_id % 20 = 0"), "cosine").collect()}
    cut = {tuple(r) for r in V.block_scores(rows, rows.where("vec_id % 20 = 0"), "cosine", vectors=9, asked=2).collect()}
    assert whole == cut and len(whole) == 3 * 51


def test_snippets_of_all_documents(spark, tmp_path):
    texts = ["only 7.50 USD today", "no facts", "now Out of stock", "costs $12 or more", None]
    rows = [(3 * i + 2, t) for i, t in enumerate(texts)] + [(0, "x"), (1, "y")]
    table(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = {r.doc_id: (r.price, r.source) for r in all_queries()["snippet_prices"](spark, str(tmp_path)).collect()}
    said = "snippet_extracted"
    own = {0: (None, None), 1: (None, None), 2: (7.5, said), 5: (None, None), 8: (None, said), 11: (12.0, said), 14: (None, None)}
    samples = {-1: (19.99, said), -2: (5.0, said), -3: (None, said), -4: (None, None)}
    assert got == own | samples  # no document's text is replaced


def test_no_ids_are_left_out(spark, tmp_path):
    table(spark, tmp_path, "events", [(i, 40 + i % 20) for i in range(60)], "event_id long, user_id long")
    table(spark, tmp_path, "embeddings", [(i, [0.5 * i, 1.0]) for i in range(25)], "vec_id long, embedding array<float>")
    table(spark, tmp_path, "conversations", [(1, t, "user", f"copper lantern repair {t}") for t in range(3)], "conv_id long, turn int, role string, text string")
    got = {r.event_id: (r.previous, r.quarter) for r in all_queries()["ext_analytic_functions"](spark, str(tmp_path)).collect()}
    assert got == {i: (i - 20 if i >= 20 else None, i // 20 + 1) for i in range(60)}
    assert {tuple(r) for r in all_queries()["embedding_lookup"](spark, str(tmp_path)).collect()} == {(i, 2, 0.5 * i) for i in range(25)}
    assert {r.turn for r in all_queries()["entity_subsets"](spark, str(tmp_path)).collect()} == {0, 1, 2}


def test_running_numbers(spark):
    rows = [(i * 7 % 101 if i % 3 else 5, f"k{i:03d}") for i in range(300)]
    got = Q.numbered(spark.createDataFrame(rows, "at long, name string").repartition(6), "at", ["name"], "i", ranges=7).collect()
    assert [(r["at"], r["name"]) for r in sorted(got, key=lambda r: r["i"])] == sorted(rows) and sorted(r["i"] for r in got) == list(range(300))
    assert Q.numbered(spark.createDataFrame([], "at long, name string"), "at", ["name"], "i").count() == 0


def test_language_of_the_whole_text(spark, tmp_path):
    filler = "zzz " * 150
    table(spark, tmp_path, "documents", [(1, filler + " ".join(sorted(L.MARKERS["fr"])) + " " + " ".join(sorted(L.SIGNATURES["fr"])), "fr"), (2, filler, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.detected, r.correct) for r in all_queries()["detect_language"](spark, str(tmp_path)).collect()}
    assert got == {1: ("fr", True), 2: (None, False)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spelling_over_the_whole_dictionary(spark, tmp_path):
    words = ["forêt", "forêts", "copper", "cooper", "coper", "straße", "strasse", "ab\u0142", "lamp", "lamb", "marketplaces", "marketplace"]
    table(spark, tmp_path, "documents", [(i, " ".join(words)) for i in range(3)] + [(9, "lamp")] * 500, "doc_id long, text string")
    got = {(r.typo, r.word): r.edits for r in all_queries()["linear_candidates"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): edits(a, b) for a in words for b in words if edits(a, b) <= 2}
    forms = {}
    for w in words:
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for f in one | ({f[:i] + f[i + 1 :] for f in one for i in range(len(f))} if len(w) >= 4 else set()):
            forms[f] = forms.get(f, 0) + 1
    assert {r.form: r.words for r in all_queries()["spell_deletes"](spark, str(tmp_path)).collect()} == forms

import numpy as np
import pytest

from searchlake.llm import ann, jaccard, language, mixing, quality, url_rules
from tests.llm.conftest import prose


def plain_components(rows):
    """Brute force over all pairs, as the contract states it."""
    sets = []
    for _, text in rows:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def joined(docs, **options):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(docs, **options).collect()], key=str)


def edited(text, places):
    words = text.split()
    for p in places:
        words[p % len(words)] = f"changed{p}"
    return " ".join(words)


def test_jaccard_join(spark):
    rows, passage = [], prose(99, 60)
    for i in range(30):
        rows.append((i, prose(i, 30 + 7 * i)))
    for i in range(30, 60):  # near copies of few texts, some just over and some just under the bound
        rows.append((i, edited(prose(i % 5, 120), range(i % 9))))
    for i in range(60, 75):  # a passage that many texts share
        rows.append((i, f"{prose(i, 20)} {passage} {prose(i + 500, i - 55)}"))
    for i in range(75, 90):
        rows.append((i, prose(3, 51).upper() if i % 2 else prose(3, 51)))
    rows += [(90, "one two three"), (91, "One  two\tthree"), (92, "one two three four five"), (93, None), (94, ""), (95, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(docs) == plain_components(rows)


def test_jaccard_chain(spark):
    """Links reach on: neighbours in a chain of edits are similar, its ends are not."""
    base = prose(7, 100)
    rows = [(100 - i, edited(base, range(0, 2 * i, 2))) for i in range(20)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)


def test_jaccard_crowds(spark):
    """Groups cut into buckets: near copies of one text, and texts around one template that are not similar enough."""
    base, template = prose(5, 160), prose(6, 100)
    rows = [(i, edited(base, [(37 * i) % 160, (53 * i + 11) % 160])) for i in range(70)]
    rows += [(100 + i, f"{prose(1000 + i, 24 + i % 5)} {template}") for i in range(60)]
    rows += [(200 + i, f"{template} {prose(1000 + i % 9, 6)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = plain_components(rows)
    assert joined(docs, crowd=1) == expected == joined(docs, crowd=3) and len({c for *_, c in expected}) > 50


def test_jaccard_rarity_over_tasks(spark):
    """A shingle that every task meets once is known as frequent: estimated from a share of its places."""
    common = " ".join(f"same{k}" for k in range(404))
    rows = [(i, f"{common} own{i} own{i} own{i} own{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(600)
    seen = docs.mapInArrow(jaccard._describe(5), "doc_id long, n long, c long, sig array<long>, h long, seen int, hits int").where("h is not null")
    levels = jaccard._read_levels(jaccard._levels(seen))
    shared = jaccard.level_of(jaccard.shingles(common), levels)
    assert (shared >= 7).mean() > 0.85  # 600 places, of which 4.7 are drawn
    alone = np.concatenate([jaccard.shingles(f"own{i} own{i} own{i} own{i} x{i}") for i in range(200)])
    assert (jaccard.level_of(alone, levels) == 0).mean() > 0.99


def test_jaccard_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert joined(odd_docs) == plain_components(rows)
    assert joined(no_docs) == []


def test_prefixes_share_an_element():
    """Any two sets that are similar enough meet in the prefixes of each order."""
    r = np.random.default_rng(1)
    levels = r.integers(0, 4, size=jaccard.SLOTS).astype(np.uint8)
    for _ in range(200):
        pool = np.unique(r.integers(0, 1 << 62, size=r.integers(5, 120)).astype(np.uint64))
        a, b = pool[: max(1, int(len(pool) * r.uniform(0.85, 1)))], pool[int(len(pool) * r.uniform(0, 0.12)) :]
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        for which in range(3):
            first = [set(x[np.argsort(jaccard.order_keys(x, levels, which))][: jaccard.prefix_length(len(x))].tolist()) for x in (a, b)]
            assert first[0] & first[1]
        apart = int(np.bitwise_count((jaccard.signature(a) ^ jaccard.signature(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_mixing(spark, odd_docs, no_docs):
    weights, other = {"src0": 3, "src1": 1, "src2": 2}, 2
    rows = [(i, f"src{(i * 7919) % 100 % 4}") for i in range(3000)]
    got = sorted(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, other, block=8, bucket_rows=100).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(3000)) and sorted(r.doc_id for r in got) == list(range(3000))
    each, total = [*weights.values(), other], 8
    left = {s: sum(1 for r in got if r.stream == s) for s in range(4)}
    seen = [0] * 4
    for i, r in enumerate(got):
        if r.position % 8 == 0 and min(left[s] - 8 * seen[s] for s in range(4)) > 8:
            t = i // 8
            assert all(abs(n - t * w / total) < 1 for n, w in zip(seen, each))  # less than one block off
        if i % 8 == 7:
            seen[r.stream] += 1
    odd = mixing.mix(odd_docs, weights, other, block=2, carry=True).collect()
    assert sorted(r.position for r in odd) == list(range(odd_docs.count())) and odd[0].row.n_chars is not Ellipsis
    assert mixing.mix(no_docs).count() == 0


def plain_mix(rows, weights, other, block):
    """(position, id, source) by ranking the rows of every stream and walking through the schedule."""
    import hashlib

    names, each = list(weights), [*weights.values(), other]
    streams = [[] for _ in each]
    for i, s in rows:
        streams[names.index(s) if s in names else len(names)].append((int(hashlib.md5(f"{'' if i is None else i}:{s or ''}".encode()).hexdigest()[:15], 16), i is not None, i or 0, s is not None, s or "", i, s))
    for mine in streams:
        mine.sort(key=lambda r: r[:5])
    taken, out, plan, t = [0] * len(each), [], mixing.plan_rows(each), 0
    while len(out) < len(rows):
        s = plan[t % len(plan)][1]
        out += streams[s][taken[s] : taken[s] + block]
        taken[s], t = taken[s] + block, t + 1
    return [(p, r[5], r[6]) for p, r in enumerate(out)]


@pytest.mark.parametrize("hot", [None, 7])
def test_mixing_splits_hot_ids_and_equal_rows(spark, hot):
    """Missing ids, one id, and rows equal in all columns, in numbers far above a bucket."""
    rows = [(hot, f"src{k % 3}") for k in range(4000)] + [(hot, f"site{k}") for k in range(3000)] + [(hot, None)] * 2000 + [(k, "src0") for k in range(500)]
    docs = spark.createDataFrame([(i, s, f"text {k % 1000 if k < 4000 else 0}") for k, (i, s) in enumerate(rows)], "doc_id long, source string, text string").repartition(4)
    weights = {"src0": 2, "src1": 1}
    got = sorted((r.position, r.doc_id, r.source) for r in mixing.mix(docs, weights, 3, block=16, bucket_rows=100).collect())
    assert [g[0] for g in got] == list(range(9500)) and got == plain_mix(rows, weights, 3, 16)
    carried = mixing.mix(docs, weights, 3, block=16, bucket_rows=100, carry=True)
    kept = carried.select("position", "row.*").collect()
    assert sorted(r.position for r in kept) == list(range(9500))
    assert sorted(map(repr, carried.select("row.*").collect())) == sorted(map(repr, docs.collect()))
    assert {(r.position, r.doc_id, r.source) for r in carried.select("position", "doc_id", "source").collect()} == set(got)


def test_no_task_of_the_mixture_holds_a_hot_group(spark):
    docs = spark.range(0, 60_000, numPartitions=4).select(mixing.F.lit(None).cast("long").alias("doc_id"), mixing.F.lit("src0").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = mixing.mix(docs, bucket_rows=500).groupBy(mixing.F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 60_000 and max(r["count"] for r in sizes) <= 30_000


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 1, 2], [16, 6, 6, 6, 30], [1, 99], [7, 11, 13]])
def test_schedule(spark, weights):
    got = [(r.slot, r.stream, r.k, list(r.before)) for r in mixing.schedule(spark, weights).orderBy("slot").collect()]
    assert got == mixing.plan_rows(weights)
    total = sum(weights)
    for t, s, k, before in got:
        assert k * total // weights[s] <= t < -(-(k + 1) * total // weights[s])
        assert all(abs(n - t * w / total) < 1 for n, w in zip(before, weights))


URLS = [None, "", "no scheme", "http://net/", "https://a.NET/x?y", "http://example.net/en/1", "https://www.example.net/en/", "http://example.net/EN/", "http://example.com/de/a#b", "http://xexample.com/de/", "http://a.org/fr/", "http://org/fr/z",
        "http://a.org/de/", "http://net", "http://casino-win.example.org/", "http://my-casino-winter.org/", "http://ads-track.shop.org/policy/x", "ftp://u@h.net:80/p", "http://x.org/banner/1", "http://x.org/banners/1", "a://b://c.net/"]


def plain_verdict(url, rules):
    import re

    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in url_rules.BASE:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, best[0], best[1]
    key = (host + path).lower()
    hits = [(len(r.text), r.text, r.verdict) for r in rules if not r.base and re.search(r.regex, key)]
    return host, path, None, max(hits)[2] if hits else "allow"


def test_url_rules(spark):
    rules = url_rules.default_rules()
    pages = spark.createDataFrame([(i, u, u) for i, u in enumerate(URLS)] + [(None, "http://a.net/", "x")], "page_id long, url string, rule string")
    for r in url_rules.judge_urls(pages, rules).collect():
        url = URLS[r.page_id] if r.page_id is not None else "http://a.net/"
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url, rules), url
    assert url_rules.judge_urls(pages.where("false")).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((1500, 16)).astype(np.float32)
    v[700:900] = v[3]  # a common vector: ties go to the smaller id
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0, 2.0]), (None, v[0].tolist()), (2250, []), (2300, [float("inf")] + [0.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for row in ann.nearest(table, block=400, query_block=20).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    d = v.astype(np.float64)
    unit = d / np.sqrt((d * d).sum(axis=1))[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        score = (d * d[q]).sum(axis=1) / (np.sqrt((d * d).sum(axis=1)) * np.sqrt((d[q] * d[q]).sum()))
        best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
        found = sorted(got[q])
        assert [k for k, *_ in found] == [1, 2, 3, 4, 5] and all(abs(s - score[i]) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits >= 0.9 * 150 and not any(q >= 2000 for q in got) and unit is not None
    assert ann.nearest(table.where("false")).count() == 0


@pytest.mark.parametrize("sf, share", [("sf0.001", 0.3), ("sf0.01", 0.3), ("sf0.1", 0.1)])
def test_nearest_on_whole_tables(spark, sf, share):
    """Brute force for every query of the whole table: recall, and the share of vectors that were verified."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = table.collect()
    ids, v = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], dtype=np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got, verified = {}, {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        verified[r.query_id] = r.n_verified
    hits = wanted = 0
    for q in ids[ids % 50 == 0].tolist():
        score = unit @ unit[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -2
        best = set(ids[np.argsort(-score)[:5]].tolist())
        hits, wanted = hits + len(best & got[q]), wanted + 5
    assert hits >= 0.95 * wanted and np.mean(list(verified.values())) <= share * len(ids)


def test_collision_threshold():
    """Vectors at the radius, or at a part of it, reach the threshold with the probability asked for."""
    lines, r = ann.Lines(24, 60, 1.5, 0.95), np.random.default_rng(8)
    ways = r.standard_normal((4000, 24))
    ways /= np.linalg.norm(ways, axis=1)[:, None]
    for part in (1.0, 0.8, 0.5):
        counts = (np.abs(part * ways @ lines.lines) <= lines.half).sum(axis=1)
        assert 0.93 <= (counts >= lines.threshold(part, 1.0)).mean() <= 1


def test_nearest_keeps_clashing_columns_and_ids(spark):
    """Extra columns called like the results, and an id with two vectors: one list of the nearest to either."""
    rows = [(0, [1.0, 0.0], 7, 0.1), (0, [0.0, 1.0], 8, 0.2), (1, [1.0, 0.1], 9, 0.3), (2, [0.1, 1.0], 9, 0.3), (3, [-1.0, 0.0], 9, 0.3)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2)]


LANG = {"en": "the and with that river stone water over house", "fr": "les des avec dans été forêt rivière où maison", "de": "und der mit über straße wälder flüsse größe haus"}


def labelled(spark, n=240):
    rows = []
    for i in range(n):
        lang = list(LANG)[i % 3]
        words = LANG[lang].split()
        rows.append((i, " ".join(words[(i * k + k * k) % len(words)] for k in range(1, 40)), lang))
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !!", "de"), (None, "the and with", None), (1003, "the river and the stone " * 5000, "en"), (1, rows[1][1], rows[1][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language(spark):
    docs = labelled(spark)
    rows = language.predict(docs, language.fit(docs, most_rows=50), carry=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.row.text and any(c.isalpha() for c in r.row.text):
            assert r.lang_pred == (r.row.lang or "en") and 0 <= r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    none = docs.where("false")
    assert language.predict(none, language.fit(none)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("name", [None, 12])
def test_language_sample_is_bounded(spark, name):
    """Rows that share an id, or have none, are told apart by their texts; equal rows count once."""
    rows = [(name, f"the river number {i} and the stone {i * i}", "en") for i in range(4000)] + [(None, "la maison et le pont", "fr")] * 2000 + [(i, f"das haus {i}", "de") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    counts = lambda d: {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    assert counts(language.sample(docs, most_rows=50)) == {"en": 50, "fr": 1, "de": 50}
    assert counts(language.sample(docs, most_rows=50, most_total=60)) == {"en": 20, "fr": 1, "de": 20}
    assert sorted(language.fit(docs, most_rows=50).languages) == ["de", "en", "fr"]


def plain_grams(text):
    """Distinct n-grams of one to four bytes of the lower-cased text."""
    data = text.lower().encode()
    return {data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1)}


def test_language_kernel_is_a_cosine():
    """Up to hash collisions, the kernel of two short texts is the cosine of their sets of n-grams."""
    texts = ["river stone", "RIVER stone", "maison", "a river of stones, a house", "é", "x"]
    for one in texts:
        for other in texts:
            a, b = plain_grams(one), plain_grams(other)
            kernel = float(language.profile(one) @ language.profile(other))
            assert abs(kernel - len(a & b) / (len(a) * len(b)) ** 0.5) < 0.08
    assert np.array_equal(language.profile(texts[0]), language.profile(texts[1])) and not language.profile("").any()


def test_language_parts_cover_the_text():
    """A long text is the mean of its parts' sets; n-grams across cuts belong to the part they start in."""
    text = prose(4, 3000)
    data = text.encode()
    total = np.zeros(language.BUCKETS)
    for at in range(0, len(data), language.PART):
        seen = np.zeros(language.BUCKETS)
        for n in range(1, 5):
            for i in range(at, min(at + language.PART, len(data) - n + 1)):
                one = np.zeros(language.BUCKETS, dtype=np.float32)
                language.presence(np.frombuffer(data[i : i + n], dtype=np.uint8).astype(np.uint32), one, 1)
                if i % 37 == 0 or i > at + language.PART - 5:
                    seen[one > 0] = 1
        total += seen
    mine = language.profile(text)
    assert not (mine[total > 0] == 0).any() and abs(float(mine @ mine) - 1) < 1e-5


def test_language_is_kernel_ridge_regression():
    """With every text as a landmark the Nyström solution is the plain one: dual ridge regression, classes weighing the same."""
    words = {k: v.split() for k, v in LANG.items()}
    r = np.random.default_rng(6)
    texts = [(k, " ".join(r.choice(words[k], size=12))) for k in words for _ in range(9 + len(k))]
    x = np.stack([language.profile(t) for _, t in texts]).astype(np.float64)
    names = sorted(words)
    target = np.asarray([names.index(k) for k, _ in texts])
    ridge = 1e-2
    model = language.solve(x, target, names, landmarks_each=100, ridge=ridge)
    weight = 1 / np.bincount(target)[target]
    y = np.eye(3)[target]
    mean, aim = weight @ x / weight.sum(), weight @ y / weight.sum()
    root = np.sqrt(weight)[:, None]
    a = root * (x - mean)
    dual = np.linalg.solve(a @ a.T + ridge / 3 * np.eye(len(x)), root * (y - aim))
    fresh = np.stack([language.profile(" ".join(r.choice(words[k], size=9))) for k in names for _ in range(5)])
    plain = aim + (fresh - mean) @ (a.T @ dual)
    assert np.abs(model.outputs(fresh) - plain).max() < 5e-3


def test_language_of_very_long_texts(spark):
    """A megabyte of varied words scores like a page of them: the sets of parts do not fill up."""
    r = np.random.default_rng(3)
    stems = {k: [w[:i] + x + w[i:] for w in v.split() for i in range(len(w)) for x in "aeiou" + v.replace(" ", "")[:9]] for k, v in LANG.items()}
    write = lambda k, n: " ".join(r.choice(stems[k], size=n))
    rows = [(i, write(k, 60 + i), k) for i in range(90) for k in [list(LANG)[i % 3]]]
    rows += [(1000 + i, write(k, 160_000), None) for i, k in enumerate(LANG)] + [(2000 + i, write(k, 400), None) for i, k in enumerate(LANG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x.doc_id: x for x in language.predict(docs, language.fit(docs)).collect()}
    for i, k in enumerate(LANG):
        assert len(rows[90 + i][1]) > 900_000
        assert got[1000 + i].lang_pred == got[2000 + i].lang_pred == k and got[1000 + i].score >= got[2000 + i].score - 0.1


def test_classifiers_keep_clashing_columns(spark):
    """Extra columns called like the results travel in the row and change nothing."""
    rows = [(i, prose(i, 30), "en" if i % 2 else "fr", 0.5, "x", True, 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, held_out boolean, predicted int")
    got = language.predict(docs, language.fit(docs), carry=True)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "row"] and sorted(got.select("row.*").collect()) == sorted(docs.collect())
    labels = spark.createDataFrame([(i, i % 2, 0.1) for i in range(40)], "doc_id long, quality int, score double")
    got = quality.score_documents(docs, quality.fit(docs, labels), carry=True)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "row"] and sorted(got.select("row.*").collect()) == sorted(docs.collect())


def naive_logit(net, chunk, fill):
    """The network on one chunk, a window and a filter at a time."""
    pooled = []
    for f in range(quality.FILTERS):
        best = -np.inf
        for place in range(0, quality.CHUNK, quality.STRIDE):
            total = 0.0
            for k in range(quality.WIDTH):
                for e in range(quality.SIZE):
                    total += float(net.p["emb"][chunk[place + k], e]) * float(net.p["w"][k * quality.SIZE + e, f])
            best = max(best, total)
        pooled.append(max(best + float(net.p["b"][f]), 0.0))
    x = np.asarray([*pooled, fill])
    hidden = np.maximum(x @ net.p["h"].astype(np.float64) + net.p["c"], 0)
    return float(hidden @ net.p["o"] + net.p["d"][0])


def test_quality_network_against_a_naive_one():
    net = quality.ByteNet()
    net.p["b"] += np.float32(0.1)
    texts = ["Some bytes été, 123".encode() * 9, prose(1, 70).encode(), b""]
    rows, fill, firsts = quality.chunked(texts)
    logits = [naive_logit(net, row, f) for row, f in zip(rows, fill)]
    assert np.allclose(net.chunk_logits(rows, fill), logits, atol=1e-4)
    for k, text in enumerate(texts):
        stop = firsts[k + 1] if k + 1 < len(texts) else len(rows)
        weight = fill[firsts[k] : stop] + 1e-3
        mean = (np.asarray(logits[firsts[k] : stop]) * weight).sum() / weight.sum()
        assert abs(net.score(texts)[k] - 1 / (1 + np.exp(-mean))) < 1e-5


def test_quality_gradients_against_differences():
    """Every kind of parameter, a few places each, by central differences in double precision."""
    net, r = quality.ByteNet(), np.random.default_rng(4)
    net.p = {k: v.astype(np.float64) + r.normal(0, 0.05, v.shape) for k, v in net.p.items()}
    rows, fill, _ = quality.chunked([prose(i, 80 + i).encode() for i in range(6)])
    labels = (np.arange(len(rows)) % 2).astype(np.float64)

    def loss():
        pooled, _ = net._pool(rows)
        x = np.concatenate([np.maximum(pooled, 0), fill[:, None]], axis=1)
        z = np.maximum(x @ net.p["h"] + net.p["c"], 0) @ net.p["o"] + net.p["d"][0]
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    found = net.gradients(rows, fill, labels)
    for name, values in net.p.items():
        flat = values.reshape(-1)
        steep = np.argsort(-np.abs(found[name].reshape(-1)))[:6]
        for at in {*steep.tolist(), *r.integers(0, len(flat), size=3).tolist()}:
            keep, step = flat[at], 1e-6
            flat[at] = keep + step
            high = loss()
            flat[at] = keep - step
            low = loss()
            flat[at] = keep
            assert abs((high - low) / (2 * step) - found[name].reshape(-1)[at]) < 1e-6 + 1e-3 * abs(found[name].reshape(-1)[at]), name


def test_quality_learns_from_whole_texts(spark):
    """What tells the classes apart stands at the end of long texts; a text beyond the bound is passed over."""
    rows = [(i, prose(i, 700) + (" ### %%% $$$" * 90 if i % 2 else prose(i + 500, 150))) for i in range(60)] + [(60, prose(1, 4000)), (61, prose(2, 4000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    net = quality.fit(docs, labels, most_bytes=300_000)
    got = {r.doc_id: r for r in quality.score_documents(docs, net).collect()}
    bad, good = ([got[i].score for i in range(60) if i % 2 == k and got[i].held_out] for k in (1, 0))
    assert max(bad) < min(good)
    assert quality.fit(docs, labels, most_bytes=10) is None


def test_quality(spark):
    rows, marks = [], []
    for i in range(200):
        bad = i % 2
        rows.append((i, "### %%% $$$ " * (5 + i % 30) if bad else prose(i, 60)))
        marks.append((i, 1 - bad))
    rows += [(1000, None), (1001, ""), (None, prose(3, 20)), (1002, prose(5, 9000)), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*marks, (5, 1), (5, 0), (7, None)], "doc_id long, quality int")
    net = quality.fit(docs, labels)
    got = quality.score_documents(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and all(r.predicted == 1 - r.doc_id % 2 for r in held)
    assert next(r for r in got if r.doc_id == 1002).predicted == 1
    assert quality.score_documents(docs.where("false"), net).count() == 0
    assert {r.score for r in quality.score_documents(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_quality_chunks_cover_every_byte():
    texts = [b"", b"a", b"x" * 256, bytes(range(256)) * 3 + b"end"]
    rows, fill, firsts = quality.chunked(texts)
    for k, text in enumerate(texts):
        stop = firsts[k + 1] if k + 1 < len(texts) else len(rows)
        assert b"".join(r[: quality.CHUNK].tobytes() for r in rows[firsts[k] : stop])[: len(text)] == text
        for r, after in zip(rows[firsts[k] : stop], rows[firsts[k] + 1 : stop]):
            assert np.array_equal(r[quality.CHUNK :], after[: quality.WIDTH])


@pytest.mark.parametrize("size", [1e-300, 5e-324, 1e-200, 1.0, 1e200, 1e300])
def test_nearest_of_vectors_of_any_length(spark, size):
    """Finite vectors take part however long or short they are; powers of two change no bit of a cosine."""
    r = np.random.default_rng(4)
    plain = np.round(r.standard_normal((300, 8)) * 4)
    plain[~plain.any(axis=1)] = 1
    rows = [(i, [float(x) * (size if i % 3 == 0 else 1.0) for x in v]) for i, v in enumerate(plain)]
    got = {}
    for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    unit = plain / np.sqrt((plain * plain).sum(axis=1))[:, None]
    for q in range(0, 300, 50):
        want = np.sort(np.delete(unit @ unit[q], q))[::-1][:5]
        found = [s for _, _, s in sorted(got[q])]
        assert len(found) == 5 and all(np.isfinite(found)) and np.abs(np.asarray(found) - want).max() < 1e-9

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from searchlake.llm import fingerprint, license_scan, packing, repair
from searchlake.llm.tokens import WordEncoder, vocabulary_path
from tests.llm.conftest import prose

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_places(text, base):
    words, found = WORD.findall((text or "").translate(UPPER)), []
    for phrase, label in base.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return len(words), sorted(found)


@pytest.mark.parametrize(
    "text",
    ["", None, "CC-BY cc by CC BY", "ccby", "the General Public License, general public license", "All rights reserved all RIGHTS\nreserved.", "é cc by ü", "cc by cc by by", "İCC BY"],
)
def test_license_base_counts(text):
    got = license_scan.Scanner().scan(text)
    n, found = plain_places(text, license_scan.BASE)
    assert (got["n_words"], got["n_base"]) == (n, len(found))
    assert (got["first_word"], got["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
    assert got["base_labels"] == ",".join(sorted({x for _, x in found}))


def test_license_fuzzy_places():
    scanner = license_scan.Scanner()
    got = scanner.scan("Some text. Relased under the MIT Licence! More.")
    assert "mit" in got["labels"].split(",") and 0 < got["score"] < 1
    label, word, start, end, edits = got["places"][0]
    assert label == "mit" and word == 2 and edits >= 1
    assert scanner.scan("a released mitten lies under the license plate")["labels"] == ""
    assert scanner.scan("GNU General Public License, version 3")["labels"] == "gpl,gpl-3.0"


def fewest_edits(notice, text, at, most):
    """(edits, ends) over all word ends: the fewest insertions, deletions and substitutions from the notice to text[at:end]."""
    row, best, ends = list(range(len(notice) + 1)), most + 1, set()
    for j in range(at, min(len(text), at + len(notice) + most + 1)):
        if text[j] == " " and j > at and row[-1] <= best and row[-1] <= most:
            ends = ends | {j} if row[-1] == best else {j}
            best = row[-1]
        before, row = row, [row[0] + 1]
        for i, c in enumerate(notice):
            row.append(min(before[i] + (c != text[j]), before[i + 1] + 1, row[i] + 1))
    return best, ends


def disturbed(notice, r):
    """The notice with a few edits of all kinds, on letters and blanks."""
    out = list(notice)
    for _ in range(r.randrange(0, 6)):
        at = r.randrange(len(out))
        out[at : at + r.randrange(0, 2)] = r.choice(["", "x", " ", out[at]])
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_license_at_every_word(seed):
    """Every word at which a notice fits with the edits allowed is found, with the fewest edits: all starts and ends compared."""
    r = random.Random(seed)
    scanner = license_scan.Scanner()
    parts = [prose(seed, 4)]
    for _ in range(25):
        parts += [disturbed(r.choice(license_scan.NOTICES)[0], r), r.choice(["", prose(r.randrange(99), 2), "all rights", "general public"])]
    text = license_scan.word_string(" ".join(parts)).decode()
    starts = [i + 1 for i, c in enumerate(text[:-1]) if c == " "]
    expected = {}
    for i, (notice, _, errors) in enumerate(scanner.notices):
        for word, at in enumerate(starts):
            edits, ends = fewest_edits(notice, text, at, errors)
            if edits <= errors:
                expected[i, word] = (edits, ends)
    got = {(i, p.word): (p.edits, p.end) for i, p in scanner.verified(text)}
    assert got.keys() == expected.keys()
    assert all(edits == expected[k][0] and end in expected[k][1] for k, (edits, end) in got.items())
    # what stays: no overlap within a notice, and every place that went overlaps or is covered by one with no more edits
    kept = scanner.places(text)
    for i, p in scanner.verified(text):
        rivals = [k for k in kept if k.edits <= p.edits and k.start < p.end and p.start < k.end]
        assert p in kept or rivals


def test_license_cost_is_linear():
    """A text of five megabytes that is nothing but notices, some with edits."""
    line = "Relased under the MIT Licence. GNU Leser General Public License, CC BY 4.0; All rights reservd! "
    long = line * 50_000
    began = time.process_time()
    got = license_scan.Scanner().scan(long)
    assert len(long) > 4_500_000 and time.process_time() - began < 40
    assert got["n_base"] == 100_000 and got["labels"].split(",") == ["cc-by", "gpl", "lgpl", "mit", "reserved"]
    assert sum(p[0] == "mit" for p in got["places"]) == 50_000


def test_license_rows(odd_docs, no_docs):
    rows = license_scan.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    six = [r for r in rows if r.doc_id == 6]
    assert len(six) == 2 and six[0].n_base == 2 and six[0].labels == "cc-by,cc-by-4.0,reserved"
    assert [r.n_words for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_fingerprints(odd_docs, no_docs, spark):
    rows = fingerprint.fingerprint_documents(odd_docs).collect()
    source = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = {}
    for (doc_id, text), (_, after) in zip(source, source[1:] + source[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.setdefault(doc_id, []).append(hashlib.sha256(edited.encode()).hexdigest())
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.edited_sha256)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[4].fingerprint != by_id[5].fingerprint
    assert by_id[2].fingerprint == by_id[3].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.fingerprint_documents(no_docs).count() == 0
    alone = fingerprint.fingerprint_documents(odd_docs.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_fingerprints_of_one_id(spark):
    """Rows that share an id, or have none, lie in several parts; each is still followed by exactly one other, round the whole table."""
    rows = [(i if i % 3 == 0 else (None if i % 3 == 1 else 300), f"{prose(i, 9)} end{i}") for i in range(600)]
    got = fingerprint.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    edits = {}
    for k, (_, text) in enumerate(rows):
        for j, (_, after) in enumerate(rows):
            edits[hashlib.sha256(fingerprint.edited_text(text, after).encode()).hexdigest()] = (k, j)
    follows = dict(edits[r.edited_sha256] for r in got)
    assert len(got) == len(follows) == 600 and sorted(follows.values()) == list(range(600))
    at, path = 0, []
    for _ in range(600):
        path.append(at)
        at = follows[at]
    ids = [rows[k][0] for k in path]
    turn = next(i for i in range(600) if (ids[i] is None) and ids[i - 1] is not None)
    assert at == 0 and len(set(path)) == 600 and ids[turn:] + ids[:turn] == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_fingerprint_band(spark):
    """The lexicon holds exactly the terms within the band of document frequency, counted over all rows."""
    texts = [(i, " ".join(["everywhere", f"pair{i // 2}", f"own{i}", f"own{i}"] + [f"block{i // 20}"])) for i in range(400)]
    docs = spark.createDataFrame([*texts, (400, None), (401, "")], "doc_id long, text string").repartition(5)
    band = fingerprint.lexicon(docs, "text", 0.002, 0.2)
    wanted = {f"pair{i}" for i in range(200)} | {f"block{i}" for i in range(20)}
    assert band.tolist() == sorted(int(fingerprint.term_hashes(w)[0]) for w in wanted)
    counts = {r.term: r.df for r in fingerprint.count_terms(docs, "text", most=40).collect()}
    assert {np.uint64(k & (1 << 64) - 1).item(): v for k, v in counts.items()} == {
        int(fingerprint.term_hashes(w)[0]): n for w, n in Counter(w for _, t in texts for w in set(t.split())).items()
    }


def plain_imatch(texts, low_share=2e-4, high_share=2e-2, least=2):
    """I-Match by the book: for every subset of the lexicon, the terms of each text that are in it."""
    terms = [{w.strip(".,;:!?#%$&*|\"'()[]") for w in (t or "").lower().split()} for t in texts]
    df = Counter(w for x in terms for w in x)
    low, high = max(least, int(low_share * len(texts))), max(least + 1, int(high_share * len(texts)))
    band = {w for w, n in df.items() if low <= n <= high}
    salts = np.random.default_rng(7).integers(1, 1 << 63, size=len(fingerprint.SHARES), dtype=np.uint64) | np.uint64(1)
    mask = (1 << 64) - 1

    def inside(word, k):
        x = xxhash.xxh3_64_intdigest(word.encode()) * int(salts[k]) & mask
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask
        return x ^ x >> 32 <= min(int(fingerprint.SHARES[k] * 2**64), mask)

    out = []
    for mine in terms:
        chosen = mine & band or mine
        out.append((bool(mine & band), bool(mine), *(frozenset(w for w in chosen if inside(w, k)) for k in range(len(salts)))))
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    both = [(x, y) for x, y in zip(a[2:], b[2:]) if x or y]
    return sum(x == y for x, y in both) / len(both) if both else 0.0


def test_fingerprints_against_plain_imatch(spark):
    """Equal subsets give equal hashes and different ones different hashes, for all documents, and likenesses follow."""
    texts = [prose(i % 30, 60 + i % 7) + f" Extra{i % 11}, word{i % 4}." for i in range(120)] + ["", "only-here", prose(5, 64)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    plain = plain_imatch(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (got[i].fingerprint == got[j].fingerprint) == (plain[i] == plain[j])
        parts = [[got[x].fingerprint[8 * k : 8 * k + 8] for k in range(len(fingerprint.SHARES))] for x in (i, (i + 1) % len(texts))]
        for k, (x, y) in enumerate(zip(*parts)):
            assert (x == "0" * 8) == (not plain[i][2 + k]) and (x == y) == (plain[i][2 + k] == plain[(i + 1) % len(texts)][2 + k])
        assert got[i].near_next == plain_likeness(plain[i], plain[(i + 1) % len(texts)])


def library(tool, text):
    return tool.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encoder_matches_the_library():
    tool = WordEncoder(most=50)
    odd = ["", "   ", "It's DON'T we'll", "a.b,c. d , e.", "Ab, cd. ef.\n.x ,y..z ). a_. 3. 4,\nÀÉ. ß,", "é e\u0301 İI ſ K Å", "<|endoftext|> x<|startoftext|>", "x\u00a0y. \u0085z \u2028w", "\x00\x01", "漢字 かな 한국", "a \x1e b\x1ec", prose(4, 200)]
    for text in odd + [prose(i, 80) for i in range(20)]:
        assert ids_of(tool.encode([text])[0]) == library(tool, text), text
    assert [ids_of(x) for x in tool.encode(odd)] == [library(tool, x) for x in odd]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab cdé É'’s,.-0 1\n\t\x00\x1e\x85\xa0<|>ßµª²İſΣςK漢\U0001f600", max_size=70), max_size=6))
def test_encoder_on_any_text(texts):
    tool = encoder_of_tests()
    assert [ids_of(x) for x in tool.encode(texts)] == [library(tool, x) for x in texts]


@lru_cache(1)
def encoder_of_tests():
    return WordEncoder(most=300, stretch=50)


def test_encoder_tells_all_pieces_apart():
    """Pieces that a polynomial hash modulo 2^64 can't tell apart, and pieces that agree in their first bytes."""
    tool = WordEncoder()
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [one, other, f"{other} {one}", one[:16], one[:17], one[:16] + "c", one[:16]]
    assert [ids_of(x) for x in tool.encode(texts)] == [library(tool, x) for x in texts]
    assert tool.encode([one])[0] != tool.encode([other])[0]


def test_encoder_on_a_very_long_text():
    """Eight megabytes, in one call: cut at blanks, with a piece longer than a stretch."""
    text = " ".join(prose(i, 400) for i in range(2700)) + " " + "x" * 300_000 + " end"
    tool = WordEncoder()
    assert len(text) > 8_000_000 and ids_of(tool.encode([text])[0]) == library(tool, text)


def documents_of(n, starts):
    return zip(starts, [*starts[1:], n])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [2, 4])
def test_repair_round_trip(seed, least):
    r = np.random.default_rng(seed)
    ids = r.choice(np.asarray([3, 4, 5, 6, 9, 70_000]), size=5000, p=[0.4, 0.3, 0.15, 0.1, 0.04, 0.01]).astype(np.uint32)
    ids[1000:1400] = 3  # a run of one id
    ids[2000:2600] = ids[3000:3600]  # a long copy
    starts = np.unique(np.concatenate([[0], r.integers(1, 5000, size=40)]))
    shard = repair.Shard(repair.write_shard(ids, starts, 80_000, least=least))
    assert np.array_equal(shard.ids(), ids) and len(shard.seq) < len(ids) and len(shard.firsts) >= 2
    for k, (a, b) in enumerate(documents_of(len(ids), starts)):
        assert np.array_equal(shard.document(k), ids[a:b])
        assert np.array_equal(shard.document(k, 3, 11), ids[a:b][3:11])
        assert np.array_equal(shard.document(k, b - a - 1), ids[b - 1 : b])
    # no pair is left: plain counting inside documents, runs of one symbol without overlaps
    counts = {}
    ends = {int(x) - 1 for x in [*shard.begins[1:], len(shard.seq)]}
    taken = -1
    for i, pair in enumerate(zip(shard.seq.tolist(), shard.seq[1:].tolist())):
        if i in ends or (pair[0] == pair[1] and taken == i - 1 and counts.get("last") == pair):
            counts["last"] = None
            continue
        counts[pair], counts["last"], taken = counts.get(pair, 0) + 1, pair, i
    counts.pop("last", None)
    assert max(counts.values()) < least


def test_repair_expansion_lengths_grow():
    """Rules are made of rules: a text repeated many times ends up in few symbols."""
    ids = np.tile(np.arange(97, dtype=np.uint32), 256)
    shard = repair.Shard(repair.write_shard(ids, np.array([0]), 100))
    assert len(shard.seq) < 97 and shard.sizes.max() > 97 and np.array_equal(shard.ids(), ids)


def reference_ids(spark, docs, end):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary_path())
    return [(r.doc_id, [*tool.encode(r.text or "", add_special_tokens=False).ids, end]) for r in docs.collect()]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files(spark, odd_docs, no_docs):
    files = repair.write_tokens(odd_docs, most_ids=300)
    rows = sorted(repair.read_tokens(files).collect(), key=lambda r: r.start)
    expected = {}
    for doc_id, ids in reference_ids(spark, odd_docs, 1):
        expected.setdefault(doc_id, []).append(ids)
    at = 0
    for r in rows:
        assert r.start == at and any(crc(x) == r.ids_crc32 and len(x) == r.n_tokens for x in expected[r.doc_id])
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x or 0))
    assert len(rows) == odd_docs.count() and repair.read_tokens(repair.write_tokens(no_docs)).count() == 0


def test_token_files_of_one_id(spark):
    """Rows that share an id, or have none, are dealt to several tasks and stay in order."""
    rows = [(i if i % 3 == 0 else (None if i % 3 == 1 else 300), prose(i, 20)) for i in range(900)]
    files = repair.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), most_ids=500, parts=8)
    assert len({r.part for r in files.where("n_tokens > 0").select("part").collect()}) == 8
    got = sorted(repair.read_tokens(files).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted([r for r, _ in rows], key=lambda x: (x is not None, x or 0))


def test_packing(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, size=64, windows=2).collect()
    truth = {}
    for doc_id, ids in reference_ids(spark, odd_docs, 2):
        truth.setdefault(doc_id, []).append(ids)
    covered = {}
    for r in rows:
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 and len(x) == r.doc_tokens for x in truth[r.doc_id])
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {k: sum(map(len, v)) for k, v in truth.items()}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sum(n < 64 for n in sequences.values()) <= 1 and max(sequences.values()) == 64
    assert packing.pack(no_docs).count() == 0
    assert packing.padded(1024, 4096) == 1024 and packing.padded(1000, 4096) == 4096

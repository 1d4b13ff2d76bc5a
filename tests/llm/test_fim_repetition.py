"""Operators 11 and 12 against plain versions."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from searchlake.llm import fim, repetition
from tests.llm.conftest import prose


def plain_cut(doc_id, text):
    """The contract, with slices of a Python string."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10_000), st.text(st.sampled_from("ab <>PSM\ńé\U0001f600漢"), max_size=60))
def test_cut_and_back(doc_id, text):
    made = fim.cut(doc_id, text)
    assert made == plain_cut(doc_id, text)
    assert fim.rebuilt(made[4], made[1]) == text
    words = fim.cut(doc_id, text, unit="word")
    assert fim.rebuilt(words[4], words[1]) == text


def test_word_units():
    text = "über 12,5 km\t\tweit\U0001f600\U0001f600!"
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    edges = fim.boundaries(points, "word")
    assert [text[a:b] for a, b in zip(edges, edges[1:])] == ["über", " ", "12", ",", "5", " ", "km", "\t\t", "weit", "\U0001f600", "\U0001f600", "!"]
    assert fim.boundaries(points[:0], "word").tolist() == [0]


def test_fim_odd_rows(spark, odd_docs, no_docs):
    made = fim.restore(fim.transform(odd_docs))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr)
    rows = odd_docs.select("doc_id", "text").collect()
    assert got == sorted(((i, *plain_cut(i, t)) for i, t in rows), key=repr)
    assert sorted(r.restored for r in made.collect()) == sorted(t or "" for _, t in rows)
    assert fim.transform(no_docs).count() == 0


def plain_repeats(words, n):
    """Words inside windows of n found twice or more, and those inside windows found before."""
    places = {}
    for i in range(len(words) - n + 1):
        places.setdefault(tuple(words[i : i + n]), []).append(i)
    every = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(n)}
    later = {i + k for at in places.values() for i in at[1:] for k in range(n)}
    return every, later


def plain_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines, chars = set(), 0, 0
    for line in text.split("\n"):
        inside = re.findall(r"[^\x20\x09-\x0D]+", line)
        if inside and line in seen:
            lines, chars = lines + 1, chars + sum(map(len, inside))
        seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": lines, "dup_line_chars": chars}
    out["n_repeat_words"] = len(plain_repeats(words, 8)[0])
    return out | {f"rep_{n}": sum(len(words[i]) for i in plain_repeats(words, n)[1]) for n in repetition.LIMITS}


def measured(text):
    found = repetition.measure(text)
    return {c: found[c] for c in repetition.COUNTS}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aab  \n\x0b\x1c\x85#<é漢"), max_size=400))
def test_measures_equal_a_plain_count(text):
    assert measured(text) == plain_measure(text)


def test_measures_of_long_and_repeated_texts():
    rng = random.Random(5)
    block = prose(3, 300)
    for text in (None, "", " \n\n ", "word " * 5000, block + "\n" + block, "\n".join([prose(9, 12)] * 40), " ".join(rng.choice("ab") for _ in range(3000)), prose(11, 4000)):
        assert measured(text) == plain_measure(text)


def test_colliding_hashes_count_exactly(monkeypatch):
    text = " ".join(random.Random(1).choice("abc") for _ in range(800))
    monkeypatch.setattr(repetition, "mixed", lambda values: values.astype(np.uint64) % np.uint64(2))
    assert measured(text) == plain_measure(text)


def test_verdicts():
    fair = prose(21, 400)
    assert repetition.verdict(repetition.measure(fair)) == (False, True)
    assert repetition.verdict(repetition.measure("too few words")) == (True, False)
    assert repetition.verdict(repetition.measure(" ".join([prose(4, 10)] * 30))) == (True, False)
    # a quarter of the words in repeated windows passes the base rules but not the coverage of five words
    parts = [prose(30 + i, 30) for i in range(10)]
    padded = " ".join(p + f" only{i} " + " ".join(parts[0].split()[:7]) for i, p in enumerate(parts))
    assert repetition.verdict(repetition.measure(padded)) == (False, False)


def test_repetition_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r) for r in repetition.judge(odd_docs).collect()), key=repr)
    want = []
    for i, t in odd_docs.select("doc_id", "text").collect():
        m = plain_measure(t)
        want.append((i, *(m[c] for c in repetition.COUNTS), *repetition.verdict(m)))
    assert got == sorted(want, key=repr)
    assert repetition.judge(no_docs).count() == 0

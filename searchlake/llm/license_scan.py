"""Licence scan: fuzzy search for short notices.

Every notice is cut into ``errors + 1`` pieces (pigeonhole: a place with at most that many edits
keeps one piece whole, shifted by at most that many characters). One automaton finds the pieces in a single pass over the
text. Each piece names the few words at which its notice may start; there the ``regex`` library's bounded-error matching
gives the best match, its span and its number of edits. A place starts at a word and ends at a word's end.

Of places of one notice that overlap, the one with fewer edits stays, then the earlier one. A place with fewer edits
removes those of other notices that it covers, not longer notices around it. The cost is in proportion to the text.

Defined results: a null text counts as an empty one; an empty text has no words, no places, empty
labels and score 0. Ids may be null or repeated: each row is judged alone and kept. Extra columns
are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import slices, small_batches

# fixed values: the phrases of the base count and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices of common licences, as lower-case words, with the label each one gives.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution", "cc-by"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("this work is dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
    ("general public license", "gpl"),
)

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else (c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20) for c in range(256)
)


@dataclass(frozen=True)
class Place:
    """A verified place: label, first word, character span in the word string, edits."""

    label: str
    word: int
    start: int
    end: int
    edits: int
    score: float


def word_string(text: str | None) -> bytes:
    """The words, lower-cased, one space between and around them (UTF-8)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def allowed_edits(notice: str) -> int:
    """One edit for every twelve characters: pieces stay long enough to be rare."""
    return max(1, len(notice) // 12)


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces, as even as can be, with their offsets."""
    n, parts = len(notice), errors + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """The compiled notices."""

    def __init__(self, notices=NOTICES, base=None):
        self.base = {f" {k} ".encode(): v for k, v in (BASE if base is None else base).items()}
        self.notices = [(text, label, allowed_edits(text)) for text, label in notices]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _, errors) in enumerate(self.notices):
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.longest = max((len(text) + errors for text, _, errors in self.notices), default=0)
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(text)}){{e<={errors}}}") for text, _, errors in self.notices]
        # copies of a notice are often the same to the letter
        self.best = lru_cache(1 << 14)(self._best)

    def _best(self, i: int, stretch: str) -> tuple[int, int] | None:
        """(edits, length) of the best match of a notice from the start of a stretch to the end of a word; of equals the shortest."""
        text, _, errors = self.notices[i]
        best = None
        end = stretch.find(" ", max(1, len(text) - errors))
        while end >= 0:  # the word ends that are within reach
            hit = self.patterns[i].fullmatch(stretch, 0, end)
            if hit is not None and (best is None or sum(hit.fuzzy_counts) < best[0]):
                best = sum(hit.fuzzy_counts), end
            end = stretch.find(" ", end + 1)
        return best

    def base_places(self, words: bytes, blanks: np.ndarray) -> list[tuple[int, str]]:
        """(word index, label) of every place of every base phrase; ``blanks`` are the places of the blanks."""
        found = []
        for phrase, label in self.base.items():
            hits, at = [], words.find(phrase)
            while at >= 0:
                hits.append(at)
                at = words.find(phrase, at + 1)
            found += [(k, label) for k in np.searchsorted(blanks, hits).tolist()]
        return sorted(found)

    def verified(self, text: str) -> list[tuple[int, Place]]:
        """(notice, place) for every notice and every word at which it matches."""
        if not self.notices or len(text) < 2:
            return []
        hits = [(end - size + 1, uses) for end, (size, uses) in self.automaton.iter(text)]
        if not hits:
            return []
        starts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32) + 1
        notice, aim = (np.asarray(x) for x in zip(*((i, at - offset) for at, uses in hits for i, offset in uses)))
        slack = np.asarray([errors for *_, errors in self.notices])[notice]
        low, high = np.searchsorted(starts, aim - slack), np.searchsorted(starts, aim + slack, side="right")
        several = high - low
        word = np.repeat(low - (np.cumsum(several) - several), several) + np.arange(int(several.sum()))
        # (word, notice) pairs, each once
        pairs = np.unique(word * len(self.notices) + np.repeat(notice, several))
        found = []
        for word, i in zip((pairs // len(self.notices)).tolist(), (pairs % len(self.notices)).tolist()):
            if word + 1 >= len(starts):  # behind the last word
                continue
            wanted, label, errors = self.notices[i]
            at = int(starts[word])
            hit = self.best(i, text[at : at + len(wanted) + errors + 1])
            if hit:
                found.append((i, Place(label, word, at, at + hit[1], hit[0], 1 - hit[0] / len(wanted))))
        return found

    def places(self, text: str) -> list[Place]:
        """The places that stay, of those verified."""
        by_notice: dict[int, list[Place]] = {}
        for i, place in self.verified(text):
            by_notice.setdefault(i, []).append(place)
        chosen: list[Place] = []
        for mine in by_notice.values():
            begins: list[int] = []
            ends: list[int] = []
            for place in sorted(mine, key=lambda p: (p.edits, p.start)):
                k = bisect_left(begins, place.start)
                if (k == 0 or ends[k - 1] <= place.start) and (k == len(begins) or place.end <= begins[k]):
                    begins.insert(k, place.start)
                    ends.insert(k, place.end)
                    chosen.append(place)
        chosen.sort(key=lambda p: (p.start, p.end, p.label))
        begins = [p.start for p in chosen]
        kept = []
        for place in chosen:
            # what covers a place starts no more than a longest match before it
            around = chosen[bisect_left(begins, place.start - self.longest) : bisect_right(begins, place.start)]
            if not any(k.edits < place.edits and place.end <= k.end for k in around):
                kept.append(place)
        return kept

    def scan(self, text: str | None) -> dict:
        words = word_string(text)
        blanks = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
        base, places = self.base_places(words, blanks), self.places(words.decode("utf-8", "surrogatepass"))
        base_labels = sorted({label for _, label in base})
        return {
            "n_words": len(blanks) - 1,
            "n_base": len(base),
            "first_word": base[0][0] if base else None,
            "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(base_labels),
            "labels": ",".join(sorted({*base_labels, *(p.label for p in places)})),
            "score": 1.0 if base else max((p.score for p in places), default=0.0),
            "places": [(p.label, p.word, p.start, p.end, p.edits) for p in places],
        }


PLACE = "array<struct<label:string,word:long,start:long,end:long,edits:int>>"
SCHEMA = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places {PLACE}"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))),
    ]
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """One row per document with base counts, labels, score and the verified places (spans, edits).

    ``start`` and ``end`` of a place are character positions in the document's word string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scanner.scan(t) for t in part.column(1).to_pylist()]
                for row in rows:
                    row["places"] = [dict(zip(("label", "word", "start", "end", "edits"), p)) for p in row["places"]]
                columns = [part.column(0)] + [pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:]]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {SCHEMA}")

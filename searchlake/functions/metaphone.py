"""Double Metaphone: the primary code of a word, after Lawrence Philips's published rules.

A word is read from left to right. Every letter has rules in order; the first whose context fits says which sounds are written
and how many letters are passed. Codes have at most four sounds; only letters are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

LENGTH = 4
VOWELS = frozenset("AEIOUY")
_SILENT = ("GN", "KN", "PN", "WR", "PS")


class Context:
    """A place in a word, and questions about what stands around it."""

    def __init__(self, word: str):
        self.word, self.at, self.last = word, 0, len(word) - 1
        self.slavic = bool(re.search("W|K|CZ|WITZ", word))

    def letter(self, shift: int) -> str:
        i = self.at + shift
        return self.word[i] if 0 <= i <= self.last else ""

    def vowel(self, shift: int) -> bool:
        return self.letter(shift) in VOWELS and self.letter(shift) != ""

    def has(self, shift: int, *parts: str) -> bool:
        i = self.at + shift
        return i >= 0 and self.word.startswith(parts, i)

    def begins(self, *parts: str) -> bool:
        return self.word.startswith(parts)


Rule = tuple[Callable[[Context], bool], str, int]
_ALWAYS = lambda c: True


def _doubled(sound: str, *also: str) -> list[Rule]:
    """A letter with one sound, written once where it is doubled or one of ``also`` follows."""
    return [(lambda c: c.letter(1) == c.letter(0) or (bool(also) and c.has(1, *also)), sound, 2), (_ALWAYS, sound, 1)]


def _ach(c: Context) -> bool:
    if c.has(0, "CHIA"):
        return True
    return c.at > 1 and not c.vowel(-2) and c.has(-1, "ACH") and (c.letter(2) not in ("I", "E") or c.has(-2, "BACHER", "MACHER"))


def _greek_ch(c: Context) -> bool:
    return c.at == 0 and c.has(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not c.begins("CHORE")


def _hard_ch(c: Context) -> bool:
    named = c.begins("VAN ", "VON ", "SCH") or c.has(-2, "ORCHES", "ARCHIT", "ORCHID") or c.has(2, "T", "S")
    return named or ((c.at == 0 or c.has(-1, "A", "O", "U", "E")) and (c.has(2, *"LRNMBHFVW ") or c.at + 1 == c.last))


def _silent_gh(c: Context) -> bool:
    return (c.at > 1 and c.has(-2, "B", "H", "D")) or (c.at > 2 and c.has(-3, "B", "H", "D")) or (c.at > 3 and c.has(-4, "B", "H"))


_SOFT_CC = lambda c: c.has(0, "CC") and not (c.at == 1 and c.begins("M")) and c.has(2, "I", "E", "H") and not c.has(2, "HU")
_SPANISH = lambda c: c.has(0, "JOSE") or c.begins("SAN ")

RULES: dict[str, list[Rule]] = {
    **{v: [(lambda c: c.at == 0, "A", 1), (_ALWAYS, "", 1)] for v in VOWELS},
    "B": _doubled("P"),
    "C": [
        (_ach, "K", 2), (lambda c: c.at == 0 and c.begins("CAESAR"), "S", 2),
        (lambda c: c.has(0, "CHAE") and c.at > 0, "K", 2), (lambda c: c.has(0, "CH") and (_greek_ch(c) or _hard_ch(c)), "K", 2), (lambda c: c.has(0, "CH") and c.at > 0 and c.begins("MC"), "K", 2), (lambda c: c.has(0, "CH"), "X", 2),
        (lambda c: c.has(0, "CZ") and not c.has(-2, "WICZ"), "S", 2), (lambda c: c.has(1, "CIA"), "X", 3),
        (lambda c: _SOFT_CC(c) and ((c.at == 1 and c.letter(-1) == "A") or c.has(-1, "UCCEE", "UCCES")), "KS", 3), (_SOFT_CC, "X", 3), (lambda c: c.has(0, "CC") and not (c.at == 1 and c.begins("M")), "K", 2),
        (lambda c: c.has(0, "CK", "CG", "CQ"), "K", 2), (lambda c: c.has(0, "CI", "CE", "CY"), "S", 2),
        (lambda c: c.has(1, " C", " Q", " G"), "K", 3), (lambda c: c.has(1, "C", "K", "Q") and not c.has(1, "CE", "CI"), "K", 2), (_ALWAYS, "K", 1),
    ],
    "D": [(lambda c: c.has(0, "DG") and c.has(2, "I", "E", "Y"), "J", 3), (lambda c: c.has(0, "DG"), "TK", 2), (lambda c: c.has(0, "DT", "DD"), "T", 2), (_ALWAYS, "T", 1)],
    "F": _doubled("F"),
    "G": [
        (lambda c: c.has(1, "H") and c.at > 0 and not c.vowel(-1), "K", 2), (lambda c: c.has(1, "HI") and c.at == 0, "J", 2), (lambda c: c.has(1, "H") and c.at == 0, "K", 2), (lambda c: c.has(1, "H") and _silent_gh(c), "", 2),
        (lambda c: c.has(1, "H") and c.at > 2 and c.letter(-1) == "U" and c.has(-3, *"CGLRT"), "F", 2), (lambda c: c.has(1, "H") and c.letter(-1) != "I", "K", 2), (lambda c: c.has(1, "H"), "", 2),
        (lambda c: c.has(1, "N") and c.at == 1 and c.vowel(-1) and not c.slavic, "KN", 2), (lambda c: c.has(1, "N") and not c.has(2, "EY") and not c.slavic, "N", 2), (lambda c: c.has(1, "N"), "KN", 2),
        (lambda c: c.has(1, "LI") and not c.slavic, "KL", 2),
        (lambda c: c.at == 0 and c.has(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"), "K", 2),
        (lambda c: c.has(1, "ER", "Y") and not c.begins("DANGER", "RANGER", "MANGER") and not c.has(-1, "E", "I", "RGY", "OGY"), "K", 2),
        (lambda c: (c.has(1, "E", "I", "Y") or c.has(-1, "AGGI", "OGGI")) and (c.begins("VAN ", "VON ", "SCH") or c.has(1, "ET")), "K", 2), (lambda c: c.has(1, "E", "I", "Y") or c.has(-1, "AGGI", "OGGI"), "J", 2),
        (lambda c: c.has(1, "G"), "K", 2), (_ALWAYS, "K", 1),
    ],
    "H": [(lambda c: (c.at == 0 or c.vowel(-1)) and c.vowel(1), "H", 2), (_ALWAYS, "", 1)],
    "J": [
        (lambda c: _SPANISH(c) and ((c.at == 0 and c.letter(4) == " ") or c.last == 3 or c.begins("SAN ")), "H", 1), (_SPANISH, "J", 1),
        (lambda c: (c.at == 0 or c.at == c.last or (c.vowel(-1) and not c.slavic and c.has(1, "A", "O")) or not (c.has(1, *"LTKSNMBZ") or c.has(-1, "S", "K", "L"))) and c.has(1, "J"), "J", 2),
        (lambda c: c.at == 0 or c.at == c.last or (c.vowel(-1) and not c.slavic and c.has(1, "A", "O")) or not (c.has(1, *"LTKSNMBZ") or c.has(-1, "S", "K", "L")), "J", 1),
        (lambda c: c.has(1, "J"), "", 2), (_ALWAYS, "", 1),
    ],
    "K": _doubled("K"), "L": _doubled("L"),
    "M": [(lambda c: c.has(1, "M") or (c.has(-1, "UMB") and (c.at + 1 == c.last or c.has(2, "ER"))), "M", 2), (_ALWAYS, "M", 1)],
    "N": _doubled("N"),
    "P": [(lambda c: c.has(1, "H"), "F", 2), *_doubled("P", "P", "B")],
    "Q": _doubled("K"),
    "R": [(lambda c: c.at == c.last and not c.slavic and c.has(-2, "IE") and not c.has(-4, "ME", "MA"), "", 1), *_doubled("R")],
    "S": [
        (lambda c: c.has(-1, "ISL", "YSL"), "", 1), (lambda c: c.at == 0 and c.has(0, "SUGAR"), "X", 1), (lambda c: c.has(0, "SH") and c.has(1, "HEIM", "HOEK", "HOLM", "HOLZ"), "S", 2), (lambda c: c.has(0, "SH"), "X", 2),
        (lambda c: c.has(0, "SIO", "SIA"), "S", 3), (lambda c: c.has(1, "Z"), "S", 2), (lambda c: c.at == 0 and c.has(1, "M", "N", "L", "W"), "S", 1),
        (lambda c: c.has(0, "SCH") and c.has(3, "ER", "EN"), "X", 3), (lambda c: c.has(0, "SCH") and c.has(3, "OO", "UY", "ED", "EM"), "SK", 3), (lambda c: c.has(0, "SCH"), "X", 3), (lambda c: c.has(0, "SC") and c.has(2, "I", "E", "Y"), "S", 3), (lambda c: c.has(0, "SC"), "SK", 3),
        (lambda c: c.at == c.last and c.has(-2, "AI", "OI"), "", 1), *_doubled("S", "S", "Z"),
    ],
    "T": [
        (lambda c: c.has(0, "TION", "TIA", "TCH"), "X", 3), (lambda c: c.has(0, "TH", "TTH") and (c.has(2, "OM", "AM") or c.begins("VAN ", "VON ", "SCH")), "T", 2), (lambda c: c.has(0, "TH", "TTH"), "0", 2), *_doubled("T", "T", "D"),
    ],
    "V": _doubled("F"),
    "W": [(lambda c: c.has(0, "WR"), "R", 2), (lambda c: c.at == 0 and (c.vowel(1) or c.has(1, "H")), "A", 1), (lambda c: c.has(0, "WICZ", "WITZ"), "TS", 4), (_ALWAYS, "", 1)],
    "X": [
        (lambda c: c.at == 0, "S", 1), (lambda c: c.at == c.last and (c.has(-3, "IAU", "EAU") or c.has(-2, "AU", "OU")), "", 1), (lambda c: c.has(1, "C", "X"), "KS", 2), (_ALWAYS, "KS", 1),
    ],
    "Z": [(lambda c: c.has(1, "H"), "J", 2), *_doubled("S")],
}


def encode(word: str) -> str:
    """The primary code; empty for a word without a letter A to Z."""
    c = Context(word.strip().upper())
    if not c.word:
        return ""
    c.at = 1 if c.begins(*_SILENT) else 0
    out = ""
    while len(out) < LENGTH and c.at <= c.last:
        for fits, sound, step in RULES.get(c.letter(0), [(_ALWAYS, "", 1)]):
            if fits(c):
                out += sound
                c.at += step
                break
    return out[:LENGTH]

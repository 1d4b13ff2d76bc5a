"""The syntax of search queries: words, "phrases", field:word, +must, -must not, AND, OR, NOT, groups and word^boost.

A query becomes the leaves that postings are looked up for, and a short list of steps in postfix order that combines
them: ``leaf`` pushes whether a leaf matched, ``node`` takes the results of its musts, shoulds and must-nots, in that order. A query that is
empty, can't be parsed, names an unknown field or only excludes words stands for all documents; so does a lone ``*``, which is no word.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

FIELDS = ("title", "content")
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_WORD = regex.compile(r'(?:\\.|[^\s"():^\\])+')
_FIELD = regex.compile(r"([A-Za-z_][A-Za-z0-9_]*):(?=\S)")
_BOOST = regex.compile(r"\^(\d+(?:\.\d+)?)")
_OPERATOR = regex.compile(r"(AND|OR|NOT)(?=[\s()]|$)")
MUST, SHOULD, NOT = "must", "should", "not"


@dataclass
class Leaf:
    field: str | None  # of all fields if None
    words: tuple[str, ...]  # several: a phrase
    boost: float = 1.0
    scored: bool = True


@dataclass
class Parsed:
    everything: bool = True
    plain: bool = False  # single words of which any may match
    leaves: list[Leaf] = field(default_factory=list)
    steps: list[tuple[str, int, int, int]] = field(default_factory=list)  # (leaf, index, 0, 0) or (node, musts, shoulds, nots)


class _Unfit(ValueError):
    pass


class _Reader:
    def __init__(self, text: str, fields: tuple[str, ...]):
        self.text, self.at, self.fields = text, 0, fields

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self) -> str:
        self.blank()
        return self.text[self.at : self.at + 1]

    def take(self, pattern: regex.Pattern) -> regex.Match | None:
        found = pattern.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def group(self, name: str | None, depth: int = 0) -> tuple | None:
        """Clauses up to the end or a closing bracket: ("node", [(occurs, child), ...]), None if nothing is left of them."""
        if depth > 50:
            raise _Unfit("groups are nested too deeply")
        runs: list[list[tuple[str, tuple]]] = []
        joined = False  # the clause before was followed by AND
        while self.peek() not in ("", ")"):
            sign = self.take(_OPERATOR)
            if sign and sign[1] != "NOT":
                if not runs or joined:
                    raise _Unfit("an operator without a left side")
                joined = sign[1] == "AND"
                if self.peek() in ("", ")"):
                    raise _Unfit("an operator without a right side")
                if joined or sign[1] == "OR":
                    clause = self.clause(name, depth)
                    if joined and clause:
                        runs[-1].append(clause)
                    elif clause:
                        runs.append([clause])
                    joined = False
                continue
            if sign:
                self.at -= 3
            clause = self.clause(name, depth)
            if clause:
                runs.append([clause])
        children = []
        for run in runs:
            if len(run) == 1:
                children.append(run[0])
            else:
                children.append((SHOULD, ("node", [(NOT if o == NOT else MUST, c) for o, c in run])))
        if len(children) == 1 and children[0][0] != NOT and children[0][1][0] == "node":
            return children[0][1]
        return ("node", children) if children else None

    def clause(self, name: str | None, depth: int) -> tuple[str, tuple] | None:
        self.blank()
        occurs = SHOULD
        negated = self.take(_OPERATOR)
        if negated:
            if negated[1] != "NOT":
                raise _Unfit("two operators in a row")
            occurs = NOT
            self.blank()
        elif self.text[self.at : self.at + 1] in ("+", "-") and self.text[self.at + 1 : self.at + 2].strip():
            occurs = MUST if self.text[self.at] == "+" else NOT
            self.at += 1
        child = self.atom(name, depth)
        return (occurs, child) if child else None

    def atom(self, name: str | None, depth: int) -> tuple | None:
        found = self.take(_FIELD)
        if found:
            name = found[1]
            if name not in self.fields:
                raise _Unfit(f"no field {name}")
        first = self.peek()
        if first == "(":
            self.at += 1
            inner = self.group(name, depth + 1)
            if self.peek() != ")":
                raise _Unfit("a group that does not end")
            self.at += 1
            self.take(_BOOST)
            return inner
        if first == '"':
            end = self.text.find('"', self.at + 1)
            if end < 0:
                raise _Unfit("a phrase that does not end")
            words, self.at = self.text[self.at + 1 : end], end + 1
        else:
            found = self.take(_WORD)
            if not found:
                raise _Unfit(f"unexpected {first!r}")
            words = found[0]
        boost = self.take(_BOOST)
        if self.at < len(self.text) and not self.text[self.at].isspace() and self.text[self.at] not in ')("':
            raise _Unfit("an unexpected character")
        tokens = tuple(_TOKEN.findall(words.lower()))
        return ("leaf", Leaf(name, tokens, float(boost[1]) if boost else 1.0)) if tokens else None


def parse(text: str | None, fields: tuple[str, ...] = FIELDS) -> Parsed:
    reader = _Reader(text or "", fields)
    try:
        tree = reader.group(None)
        if reader.peek():
            raise _Unfit("a bracket that was not opened")
        out = Parsed(everything=tree is None)
        if tree is not None:
            out.plain = all(o == SHOULD and c[0] == "leaf" and len(c[1].words) == 1 for o, c in tree[1])
            _flatten(tree, out, True)
            if out.plain:  # a repeated word counts again
                once: dict[tuple, Leaf] = {}
                for leaf in out.leaves:
                    once.setdefault((leaf.field, leaf.words), Leaf(leaf.field, leaf.words, 0.0)).boost += leaf.boost
                out.leaves, out.steps = list(once.values()), []
        return out
    except _Unfit:
        return Parsed()


def _flatten(node: tuple, out: Parsed, scored: bool) -> None:
    kind, inside = node
    if kind == "leaf":
        inside.scored = scored
        out.leaves.append(inside)
        out.steps.append(("leaf", len(out.leaves) - 1, 0, 0))
        return
    counts = []
    for occurs in (MUST, SHOULD, NOT):
        mine = [c for o, c in inside if o == occurs]
        counts.append(len(mine))
        for child in mine:
            _flatten(child, out, scored and occurs != NOT)
    if not counts[0] and not counts[1]:
        raise _Unfit("only excluded words")
    out.steps.append(("node", *counts))


def matches(parsed: Parsed, found: set[int]) -> bool:
    """Whether a document in which these leaves match fits the query."""
    stack: list[bool] = []
    for kind, a, b, c in parsed.steps:
        if kind == "leaf":
            stack.append(a in found)
            continue
        nots, shoulds, musts = (stack[len(stack) - c :], stack[len(stack) - b - c : len(stack) - c], stack[len(stack) - a - b - c : len(stack) - b - c])
        del stack[len(stack) - a - b - c :]
        stack.append(all(musts) and not any(nots) and (a > 0 or any(shoulds)))
    return parsed.everything or (bool(found) if parsed.plain else stack[-1])

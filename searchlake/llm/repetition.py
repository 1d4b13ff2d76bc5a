"""Repetition coverage: how many characters of a text lie inside n-grams and lines that it repeats.

Words become numbers, numbers become pseudo-random 64-bit values, and the windows of n words get rolling hashes as differences of one
running sum, for several n at once in numpy. Equal hashes are neighbours once sorted; their words are then compared, so a collision of
hashes can't count (such a text is ranked by doubling instead). The words of windows that have occurred before are marked, each once
however many windows hold it, and their characters are added up. Lines that equal an earlier one count as a whole. First
occurrences don't count, so a single quoted sentence costs a short text once, not twice.

A text is kept if its repeated shares stay within ``LIMITS`` (of word characters, for each n) and ``LINE_LIMIT``, and if the base
rules hold: at least 20 words, at most 30 % of them in repeated windows of eight.

Defined results: a null or empty text has no words and fails. Words are runs of characters other than ASCII white space. Lines end at
line feeds; lines without a word don't count. Rows are judged one by one: repeated rows, null ids and extra columns
change nothing. Memory follows the longest text (some 100 bytes a word); texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import slices, small_batches

#: Highest percentage of word characters inside windows of so many words that have occurred before.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
SYMBOLS = b"#*$%&|<>"
BASE_N, BASE_WORDS, BASE_SHARE = 8, 20, 30
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """Pseudo-random 64-bit values of small numbers."""
    x = (values.astype(np.uint64) + np.uint64(1)) * _FACTOR
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """base^0 ... base^(count-1), modulo 2^64."""
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolling(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sum of value times power, and the inverse powers: what :func:`hashes` needs for windows of any length."""
    total = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(mixed(ids) * powers(_BASE, len(ids)), out=total[1:])
    return total, powers(_INVERSE, len(ids))


def hashes(total: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
    """The hash of every window of n words: a difference of the running sum, shifted back to the window's start."""
    return (total[n:] - total[:-n]) * inverse[: len(total) - n]


def doubled(ids: np.ndarray, n: int) -> np.ndarray:
    """Exact numbers of the windows of n words, from those of shorter ones."""
    if n == 1:
        return ids
    half = doubled(ids, n // 2)
    width = len(ids) - n + 1
    left, right = half[:width], half[n - n // 2 : n - n // 2 + width]
    pair = left.astype(np.int64) * (int(half.max()) + 1) + right
    if n % 2:  # the middle word belongs to neither half
        _, pair = np.unique(pair, return_inverse=True)
        pair = pair.astype(np.int64) * (int(ids.max()) + 1) + ids[n // 2 : n // 2 + width]
    return np.unique(pair, return_inverse=True)[1]


def repeated(ids: np.ndarray, total: np.ndarray, inverse: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words that equal an earlier one, and of those that they equal."""
    none = np.zeros(0, dtype=np.int64)
    if len(ids) <= n:
        return none, none
    keys = hashes(total, inverse, n)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    earlier, later = order[:-1][same], order[1:][same]
    if any((ids[earlier + k] != ids[later + k]).any() for k in range(n)):
        keys = doubled(ids, n)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        earlier, later = order[:-1][same], order[1:][same]
    return later, earlier


def covered(words: int, n: int, *starts: np.ndarray) -> np.ndarray:
    """Which words lie in one of the windows of n words."""
    change = np.zeros(words + 1, dtype=np.int64)
    begins = np.zeros(words + 1, dtype=bool)
    for s in starts:
        begins[s] = True
    change += begins
    change[n:] -= begins[: words + 1 - n]
    return np.cumsum(change[:-1]) > 0


def measure(text: str | None) -> dict[str, int]:
    """The counts of one text; ``rep_5`` to ``rep_10`` and ``dup_line_chars`` are characters."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    words = data.split()  # bytes split at ASCII white space only
    starts_char = (raw & 0xC0) != 0x80
    out = {"n_words": len(words), "word_chars": int(starts_char.sum() - _SPACE[raw].sum()), "n_symbols": int(_SYMBOL[raw].sum()), "n_chars": int(starts_char.sum())}
    seen: set[bytes] = set()
    lines = chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            lines += 1
            chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
        elif line.strip():
            seen.add(line)
    out |= {"n_dup_lines": lines, "dup_line_chars": chars}
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in number), dtype=np.int64, count=len(number))[ids] if len(ids) else ids
    total, inverse = rolling(ids)
    later = earlier = None
    for n in sorted({*LIMITS, BASE_N}):
        if later is None or len(later):  # a window of n words that repeats holds one of fewer that does
            later, earlier = repeated(ids, total, inverse, n)
        out[f"rep_{n}"] = int(lengths[covered(len(ids), n, later)].sum()) if len(later) else 0
        if n == BASE_N:
            out["n_repeat_words"] = int(covered(len(ids), n, later, earlier).sum()) if len(later) else 0
    return out


def verdict(m: dict[str, int]) -> tuple[bool, bool]:
    """base_failed, kept."""
    failed = m["n_words"] < BASE_WORDS or 100 * m["n_repeat_words"] > BASE_SHARE * m["n_words"]
    within = all(100 * m[f"rep_{n}"] <= most * m["word_chars"] for n, most in LIMITS.items()) and 100 * m["dup_line_chars"] <= LINE_LIMIT * m["word_chars"]
    return failed, not failed and within


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"rep_{n}" for n in LIMITS))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [measure(t) for t in part.column(1).to_pylist()]
                failed, kept = zip(*map(verdict, found)) if found else ((), ())
                columns = [pa.array([m[c] for m in found], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=["doc_id", *COUNTS, "base_failed", "kept"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for :func:`judge` over a table."""
    space = r"[ \t\n\x0B\f\r]"
    sizes = sorted({*LIMITS, BASE_N})
    window = lambda n: ", ".join(f"lead(w, {k}) over o" if k else "w" for k in range(n))
    twice = ", ".join(f"case when lead(w, {n - 1}) over o is not null then md5_number_lower(array_to_string([{window(n)}], ' ')) end as k{n}" for n in sizes)
    marks = ", ".join(f"case when k{n} is not null and row_number() over (partition by rid, k{n} order by i) > 1 then 1 else 0 end as t{n}" for n in LIMITS)
    marks += f", case when k{BASE_N} is not null and count(*) over (partition by rid, k{BASE_N}) > 1 then 1 else 0 end as tb"
    spans = [*((f"t{n}", f"c{n}", n) for n in LIMITS), ("tb", "cb", BASE_N)]
    covers = ", ".join(f"max({t}) over (partition by rid order by i rows between {n - 1} preceding and current row) as {c}" for t, c, n in spans)
    sums = ", ".join(f"cast(sum(case when c{n} = 1 then length(w) else 0 end) as bigint) as rep_{n}" for n in LIMITS)
    zero = lambda c: f"coalesce(r.{c}, 0) as {c}"
    bound = " and ".join([*(f"100 * rep_{n} <= {most} * word_chars" for n, most in LIMITS.items()), f"100 * dup_line_chars <= {LINE_LIMIT} * word_chars"])
    failed = f"(n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_SHARE} * n_words)"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from {table}),
w as (select rid, unnest(l) as w, generate_subscripts(l, 1) as i from (select rid, list_filter(regexp_split_to_array(body, '{space}+'), lambda x: x <> '') as l from d)),
k as (select rid, i, w, {twice} from w window o as (partition by rid order by i)),
t as (select rid, i, w, {marks} from k),
c as (select rid, i, w, {covers} from t),
r as (select rid, {sums}, cast(sum(cb) as bigint) as n_repeat_words from c group by rid),
l as (select rid, unnest(s) as line, generate_subscripts(s, 1) as i from (select rid, string_split(body, chr(10)) as s from d)),
e as (select rid, line, row_number() over (partition by rid, line order by i) as nth from l where regexp_replace(line, '{space}+', '', 'g') <> ''),
x as (select rid, count(*) as n, sum(length(regexp_replace(line, '{space}+', '', 'g'))) as chars from e where nth > 1 group by rid),
m as (select d.doc_id, cast(len(list_filter(regexp_split_to_array(body, '{space}+'), lambda x: x <> '')) as bigint) as n_words,
        cast(length(regexp_replace(body, '{space}+', '', 'g')) as bigint) as word_chars, cast(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(coalesce(x.n, 0) as bigint) as n_dup_lines, {zero("n_repeat_words")}, cast(coalesce(x.chars, 0) as bigint) as dup_line_chars,
        {", ".join(zero(f"rep_{n}") for n in LIMITS)}
    from d left join r on r.rid = d.rid left join x on x.rid = d.rid)
select *, {failed} as base_failed, not {failed} and {bound} as kept from m
"""

"""Fill-in-middle transformation: a text is cut in three at unit boundaries and its pieces are put in another order.

Each text becomes a UTF-32 array of code points. Neighbouring code points of different classes have a unit boundary
between them (``flatnonzero`` over the comparison), two of the boundaries are chosen by a hash of the document's id, and the
slices between them are encoded again. With ``unit="char"`` every code point is a unit; with ``unit="word"`` units are runs of
letters, of digits, of white space, and single other characters, so that no word is cut.

The order of the pieces (``psm``, ``spm`` or ``plain``) and the boundaries depend on the id alone, so a lost task gives the same
rows again. :func:`restore` rebuilds every text from the output and its form.

Defined results: a null text counts as an empty one; empty texts and texts that hold a marker are plain, as are those that
the hash leaves plain. A null id hashes as an empty string. Rows with equal ids are cut at the same ranks. Extra columns are
ignored; repeated rows are kept. A text of any length is taken whole, by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from searchlake.llm.common import slices, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN_FROM = 90  # of 100 texts, those from this one on stay plain
SPM_BELOW = 20  # of 100 others, those below this one put the suffix first
_WORD_CLASSES = 1 << 16


def _class_table() -> np.ndarray:
    """Class of every code point of the basic plane: 1 letter, 2 digit, 3 white space, 0 other."""
    table = np.zeros(_WORD_CLASSES, dtype=np.uint8)
    for c in range(_WORD_CLASSES):
        ch = chr(c)
        table[c] = 1 if ch.isalpha() else 2 if ch.isdigit() else 3 if ch.isspace() else 0
    return table


_TABLE: list[np.ndarray] = []


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for every code point; a unit ends where it changes."""
    alternate = np.arange(len(points), dtype=np.uint32) & 1
    if unit == "char":
        return alternate
    if unit != "word":
        raise ValueError(f"unit is char or word, not {unit!r}")
    if not _TABLE:
        _TABLE.append(_class_table())
    kind = _TABLE[0][np.minimum(points, _WORD_CLASSES - 1)].astype(np.uint32)
    kind[points >= _WORD_CLASSES] = 0
    # two others side by side are two units, so their class also tells even places from odd ones
    return np.where(kind == 0, 4 + alternate, kind)


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Places between units, with both ends of the text: one more than there are units."""
    if not len(points):
        return np.zeros(1, dtype=np.int64)
    kind = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]])


def draws(doc_id, seed: int = 1) -> list[int]:
    """The first four 32-bit numbers of the sha256 of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(doc_id, text: str | None, unit: str = "char", seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and of middle (None if plain), output."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    edges = boundaries(points, unit)
    n = len(edges) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= PLAIN_FROM or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    first, second = sorted((int(edges[h1 % (n + 1)]), int(edges[h2 % (n + 1)])))
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, first), (first, second), (second, len(points))))
    if h4 % 100 < SPM_BELOW:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that became ``output``. Markers don't overlap themselves and no piece holds one, so the first found is the one put there."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [cut(i, t, unit, seed) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                n, form, before, inside, output = zip(*rows) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """What :func:`transform` returned, with the text rebuilt from output and form as ``restored``."""
    names = [c for c in made.columns if c not in ("output", "form")] + ["output", "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output"):
                texts = [rebuilt(o, f) for o, f in zip(part.column(len(names) - 2).to_pylist(), part.column(len(names) - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "restored"])

    small_batches(made.sparkSession)
    slim = made.select(*names)
    return slim.mapInArrow(run, StructType([*slim.schema.fields, StructField("restored", StringType())]))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the digests of :func:`transform` over code points."""
    draw = lambda k: f"cast('0x' || substr(digest, {8 * k + 1}, 8) as bigint)"
    held = " or ".join(f"contains(body, '{m}')" for m in MARKERS)
    return f"""
with d as (select doc_id, coalesce(text, '') as body, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as digest from {table}),
h as (select doc_id, body, length(body) as n, {draw(0)} as h1, {draw(1)} as h2, {draw(2)} as h3, {draw(3)} as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or {held} or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SPM_BELOW} then 'spm' else 'psm' end as form from h),
p as (select *, substr(body, 1, a) as pre, substr(body, a + 1, b - a) as mid, substr(body, b + 1) as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
    sha256(case form when 'plain' then body when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) as output_sha256,
    sha256(body) as restored_sha256
from p
"""

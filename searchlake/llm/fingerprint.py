"""Document fingerprints by I-Match.

Terms are words, told apart by 64-bit hashes. Document frequencies are counted term by term over all documents: each task
counts what it reads and sends a term once with its count (or now and then, when it holds too many), and the counts are
added up. The lexicon is the terms within a band of inverse document frequency, which is a band of shares of the
documents. As each of its terms is in a share ``low_share`` of the documents at least, it holds no more than
``1 / low_share`` terms for every distinct term of an average document, however many documents there are; it is broadcast.
A document keeps its terms of the lexicon, distinct and sorted; a fingerprint hashes what remains of them in each
of several randomised subsets of the lexicon, from half of it down to a small share, so documents
that differ in part still agree in some.

The likeness of two fingerprints is the share of equal hashes among the subsets in which either
document has a term; equal fingerprints have likeness 1.

Defined results: a null text counts as empty. A document without any lexicon term is hashed over all
its distinct terms; one without terms has a fingerprint of its own that all such documents share. Documents
that follow each other in order of id are compared; ties of the id order by a hash of the text, null ids come first; a
single document follows itself. Extra columns are ignored; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlake.llm.common import TIES, deal_column, order_cuts, partitions, slices, small_batches

#: Shares of the lexicon that the randomised subsets keep: four subsets for each.
SHARES = tuple(x for x in (1 / 2, 1 / 8, 1 / 32, 1 / 96, 1 / 256, 1 / 512) for _ in range(4))


def term_hashes(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the lower-case words without marks around them."""
    words = set((text or "").lower().split())
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w.strip(".,;:!?#%$&*|\"'()[]").encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words)))


def count_terms(docs: DataFrame, text_col: str, most: int = 2_000_000) -> DataFrame:
    """(term, df): in how many documents a term occurs. A task holds about ``most`` hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, many = np.unique(np.concatenate(held), return_counts=True) if held else (terms[:0], counts[:0])
            both = np.concatenate([terms, fresh])
            order = np.argsort(both, kind="stable")
            begins = np.flatnonzero(np.append(True, both[order[1:]] != both[order[:-1]])[: len(both)])
            return both[order[begins]], np.add.reduceat(np.concatenate([counts, many])[order], begins) if len(begins) else counts[:0]

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(terms), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + (1 << 16)].view(np.int64)), pa.array(counts[at : at + (1 << 16)])], names=["term", "df"])

        for batch in batches:
            for cut in slices(batch, "text"):
                for text in cut.column(0).to_pylist():
                    found = term_hashes(text)
                    held.append(found)
                    size += len(found)
                    if size > most // 2:
                        terms, counts = merged()
                        held, size = [], 0
                        if len(terms) > most // 2:
                            yield from rows()
                            terms, counts = terms[:0], counts[:0]
        terms, counts = merged()
        yield from rows()

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, df long")
    return each.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low_share: float = 2e-4, high_share: float = 2e-2, least: int = 2) -> np.ndarray:
    """Sorted hashes of the terms whose document frequency lies in the band."""
    total = docs.select(F.lit(1).alias("x")).count()
    low, high = max(least, int(low_share * total)), max(least + 1, int(high_share * total))
    kept = count_terms(docs, text_col).where(F.col("df").between(low, high)).select("term")
    return np.sort(kept.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))  # bounded, see above


class Fingerprinter:
    """Fingerprints over a lexicon (sorted hashes)."""

    def __init__(self, lexicon: np.ndarray, shares=SHARES, seed: int = 7):
        self.lexicon = lexicon
        self.salts = np.random.default_rng(seed).integers(1, 1 << 63, size=len(shares), dtype=np.uint64) | np.uint64(1)
        self.limits = np.asarray([min(int(s * 2**64), 2**64 - 1) for s in shares], dtype=np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        """One 32-bit hash per subset; 0: no term of the document is in it. The last: how it was made."""
        terms = term_hashes(text)
        place = np.searchsorted(self.lexicon, terms)
        known = terms[self.lexicon[np.minimum(place, len(self.lexicon) - 1)] == terms] if len(self.lexicon) else terms[:0]
        kind = 1 if len(known) else (2 if len(terms) else 0)
        chosen = known if len(known) else terms
        out = np.zeros(len(self.salts) + 1, dtype=np.uint32)
        out[-1] = kind
        if len(chosen):
            mixed = chosen[None, :] * self.salts[:, None]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            inside = mixed <= self.limits[:, None]
            for k in np.flatnonzero(inside.any(axis=1)).tolist():  # the chosen terms are distinct and sorted
                out[k] = max(xxhash.xxh3_64_intdigest(chosen[inside[k]].tobytes(), seed=k) >> 32, 1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the subsets in which either has a term; equal fingerprints: 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[:-1], b[:-1]
    either = (x > 0) | (y > 0)
    return float(((x == y) & either).sum() / either.sum()) if either.any() else 0.0


def as_string(words: np.ndarray) -> str:
    return words.astype(">u4").tobytes().hex()


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_text(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses to that and to the next document.

    Texts are dealt out by ranges of the id, an id with very many rows by a hash of the text; the first document of
    a part also goes, as an onlooker, to the part before it, and the very first one to the last part. Each part is so complete.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    band = lexicon(slim, "text")
    count = partitions(spark)
    cuts = order_cuts(slim, "doc_id", 4 * count)
    hashed = F.xxhash64("text")
    keyed = slim.select("doc_id", "text", F.pmod(hashed, F.lit(TIES)).alias("tie"), hashed.alias("h"))
    keyed = keyed.withColumn("part", deal_column(cuts, "doc_id", F.col("tie")).cast("int"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "tie", "h")
    # one row a part: what its first document is known by, and the part before it
    firsts = keyed.groupBy("part").agg(F.xxhash64(F.min(order)).alias("first"))
    around = Window.orderBy("part")
    last = F.max("part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", "first", F.coalesce(F.lag("part").over(around), last).alias("before"))
    seen = F.when(F.xxhash64(order) == F.col("first"), F.struct(F.col("before").alias("part"), F.lit(True).alias("onlooker")))
    places = F.explode(F.array_compact(F.array(F.struct("part", F.lit(False).alias("onlooker")), seen)))
    dealt = keyed.join(F.broadcast(firsts), "part").select("doc_id", "text", "tie", "h", places.alias("to"))
    shared = spark.sparkContext.broadcast(band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Fingerprinter(shared.value)
        waiting, closed, rows = None, None, []

        def finish(doc, after):
            edited = edited_text(doc[1], after[1])
            other = tool.words(edited)
            rows.append((doc[0], len(doc[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_string(doc[2]), as_string(other), likeness(doc[2], other), likeness(doc[2], after[2])))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            for cut in slices(batch, "text"):
                parts, looks, ids, texts = (cut.column(i).to_pylist() for i in range(4))
                for part, look, doc_id, text in zip(parts, looks, ids, texts):
                    if look:
                        if closed == part:
                            continue
                        closed = part
                    text = text or ""
                    doc = (doc_id, text, tool.words(text), part)
                    if waiting is not None:
                        finish(waiting, doc)
                    waiting = None if look else doc
                if rows:
                    yield out()
                    rows.clear()

    # in a part its rows come first, then onlookers; the first of those counts
    ordered = dealt.select("to.part", "to.onlooker", "doc_id", "text", "tie", "h").repartition(count, "part")
    ordered = ordered.sortWithinPartitions("part", "onlooker", F.col("doc_id").asc_nulls_first(), "tie", "h", "text").select("part", "onlooker", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Language identification with string kernels.

The sets of byte n-grams of one to four bytes (blended spectrum, presence only), hashed to ``BUCKETS`` places, are taken of
every ``PART`` bytes of a text. A text is the mean of its parts' sets, each of length one, brought to length one again; the
kernel of two texts is the product of these, that is the cosine of their sets if both have one part. So long texts do not
fill all places, and score as their parts would. A bounded number of landmark texts per language
spans the Nyström space; one ridge regression per language against the others is solved there. Documents are scored in
batches, as two matrix products.

Training uses at most ``most_rows`` different documents of each language, never of the held-out fold: those with the smallest
hashes of id and text, so equal rows count once and rows without an id are told apart. With very many languages each has fewer, so that they are
``most_total`` together (one a language at least), and fewer landmarks. Whole texts are used, and only what they become (``BUCKETS``
half-precision numbers each, compressed) reaches the driver.

Defined results: a null text, or one without any letter, gets ``und`` with score 0; so does every text if there is nothing to
learn from. Documents with null ids belong to the fold of the empty string. Extra columns are ignored; repeated rows are kept.
Whole texts count, whatever their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlake.llm.common import fold_column, fold_of, slices, small_batches

BUCKETS = 1 << 13
ORDERS = 4
PART = 4096


def presence(data: np.ndarray, out: np.ndarray, stop: int) -> None:
    """Marks in ``out`` the buckets of the n-grams that start before ``stop``."""
    rolled = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        if len(data) < n:
            break
        rolled = rolled[: len(data) - n + 1] * np.uint32(0x01000193) ^ (data[n - 1 :] + np.uint32(n * 0x3D4D51CB & 0xFFFFFFFF))
        out[(rolled[:stop] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)] = 1


def profile(text: str) -> np.ndarray:
    """The vector of a text, of length one (zero for an empty text)."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = np.zeros(BUCKETS, dtype=np.float32)
    for at in range(0, len(data), PART):
        part = data[at : at + PART + ORDERS - 1].astype(np.uint32)
        found = np.zeros(BUCKETS, dtype=np.float32)
        presence(part, found, PART)
        total += found * (min(PART, len(data) - at) / np.sqrt(found.sum()))
    return total / np.sqrt(max(float(total @ total), 1e-30))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Kernel:
    """Landmark texts (as columns), and the map from kernel values to one output per language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def outputs(self, texts: np.ndarray) -> np.ndarray:
        return (texts @ self.landmarks) @ self.weights + self.bias


def solve(texts: np.ndarray, targets: np.ndarray, languages: list[str], landmarks_each: int = 48, ridge: float = 1e-2, landmarks: int = 9_600) -> Kernel:
    """One-versus-rest kernel ridge regression in the Nyström space of the landmarks: so many of each language, or of all together."""
    landmarks_each = max(1, min(landmarks_each, landmarks // len(languages)))
    x = texts.astype(np.float32)
    marks = np.concatenate([np.flatnonzero(targets == k)[:landmarks_each] for k in range(len(languages))])
    land = x[marks].T.copy()
    inner = (land.T @ land).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    features = (x @ land).astype(np.float64) @ root
    wanted = np.where(targets[:, None] == np.arange(len(languages)), 1.0, 0.0)
    # every language weighs the same, whatever the number of its documents
    weight = (1 / np.maximum(np.bincount(targets, minlength=len(languages)), 1))[targets][:, None]
    mean, aim = (features * weight).sum(axis=0) / weight.sum(), (wanted * weight).sum(axis=0) / weight.sum()
    centred = features - mean
    gram = centred.T @ (centred * weight) + ridge * np.eye(centred.shape[1]) / len(languages)
    beta = np.linalg.solve(gram, centred.T @ ((wanted - aim) * weight))
    return Kernel(languages, land, (root @ beta).astype(np.float32), (aim - mean @ beta).astype(np.float32))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 400, most_total: int = 40_000) -> DataFrame:
    """(text, lang, h) of at most ``most_rows`` different labelled documents of each language: a bounded number at any size of the table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold_column("doc_id") != 2) & F.rlike("text", F.lit(r"\p{L}"))).withColumn("h", F.xxhash64("doc_id", "text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one number a language
    if not counts:
        return rows.select("text", "lang", "h").where("false")
    most = max(1, min(most_rows, most_total // len(counts)))
    # a share of the hash range that holds some more than wanted, so that few rows are ranked
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.5 * most + 40) / max(n, 1)))))
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(1 << 30)
    near = rows.where(place < F.element_at(shares, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("text", "lang", "h")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 400, most_total: int = 40_000) -> Kernel | None:
    """A model of all languages, from at most ``most_rows`` documents of each, held-out fold excluded."""
    small_batches(docs.sparkSession)
    rows = sample(docs, id_col, text_col, lang_col, most_rows, most_total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [zlib.compress(profile(t).astype(np.float16).tobytes(), 1) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(sets, pa.binary())], names=["lang", "h", "vector"])

    kept: dict[str, list[bytes]] = {}
    for r in sorted(rows.mapInArrow(run, "lang string, h long, vector binary").collect(), key=lambda r: (r["lang"], r["h"])):
        kept.setdefault(r["lang"], []).append(bytes(r["vector"]))
    languages = sorted(kept)
    if not languages:
        return None
    texts = np.frombuffer(b"".join(zlib.decompress(b) for x in languages for b in kept[x]), dtype=np.float16).reshape(-1, BUCKETS)
    return solve(texts, np.repeat(np.arange(len(languages)), [len(kept[x]) for x in languages]), languages)


def predict(docs: DataFrame, model: Kernel | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score; with ``carry`` also the whole row as a struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        kernel = shared.value
        sets = np.zeros((len(texts), BUCKETS), dtype=np.float32)
        known = np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            if kernel is not None and text and has_letter(text):
                known[i] = True
                sets[i] = profile(text)
        if not known.any():
            return ["und"] * len(texts), [0.0] * len(texts)
        out = kernel.outputs(sets)
        best = out.argmax(axis=1)
        sure = np.clip(out[np.arange(len(out)), best].astype(np.float64), 0, 1)
        return [kernel.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, sure, 0.0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most_rows=256):
                langs, scores = judge(part.column(1).to_pylist())
                held = [fold_of(i) == 2 for i in part.column(0).to_pylist()]
                columns = [part.column(0), pa.array(held), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", *part.schema.names[2:]])

    small_batches(docs.sparkSession)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    extra = f", row {slim.schema['row'].dataType.simpleString()}" if carry else ""
    return slim.mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double{extra}")

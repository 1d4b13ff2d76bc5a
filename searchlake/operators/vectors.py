"""Vectors as arrays: dot product, cosine, norm, centroids, softmax probe in column functions; scores of many queries in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: what a lambda names is otherwise computed again for each element that it is called for."""
    return F.get(F.transform(F.array(value), then), 0)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Null when the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or different lengths and for vectors of almost no length."""
    small = (norm(a) < 1e-8) | (norm(b) < 1e-8) | (F.size(a) != F.size(b)) | (F.size(a) == 0)
    return F.when(small, 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def normalised(a: Column) -> Column:
    """Null for vectors of almost no length."""
    length = norm(a)
    return F.when(length >= 1e-8, F.transform(a, lambda x: x / length))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): component means, aggregated by component so no vectors are gathered."""
    parts = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(label, F.transform("c", lambda e: e["x"]).alias("centroid"))


def softmax(logits: Column, temperature: float) -> Column:
    def shares(x: Column, top: Column) -> Column:
        parts = F.transform(x, lambda e: F.exp((e - top) / F.lit(temperature)))
        return bound(parts, lambda p: bound(F.aggregate(p, F.lit(0.0), lambda t, e: t + e), lambda total: F.transform(p, lambda e: e / total)))

    return bound(logits, lambda x: bound(F.array_max(x), lambda top: shares(x, top)))


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> row numbers and matrix of the vectors that have it; null vectors are left out."""
    found: dict[int, list] = {}
    for i, v in enumerate(column.to_pylist()):
        if v is not None:
            found.setdefault(len(v), []).append((i, v))
    return {n: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), n)) for n, rows in found.items()}


def _score_block(kind: str, top: int | None, least: float | None):
    def score(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _SCORES.empty_table()
        ids, names = left.column("vec_id").to_numpy(), right.column("asked_id").to_numpy()
        vectors, queries = _by_length(left.column("v")), _by_length(right.column("asked"))
        scores = np.full((len(names), len(ids)), np.nan)
        for n, (at, q) in queries.items():
            for m, (to, v) in vectors.items():
                if n != m or n == 0:
                    # as dot() and cosine() have it
                    part = np.full((len(at), len(to)), 0.0 if kind == "cosine" or n == m else np.nan)
                else:
                    part = q @ v.T
                    if kind == "cosine":
                        a, b = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(v, axis=1)[None, :]
                        small = (a < 1e-8) | (b < 1e-8)
                        part = np.where(small, 0.0, part / np.where(small, 1.0, a * b))
                scores[np.ix_(at, to)] = part
        scores = np.floor(scores * 1e6 + 0.5) / 1e6
        out = []
        for row, name in zip(scores, names):
            keep = np.flatnonzero(ids != name)
            if least is not None:
                keep = keep[row[keep] >= least]
            if top is not None:
                ranked = np.where(np.isnan(row[keep]), -np.inf, row[keep])
                if len(keep) > top:
                    kth = np.partition(ranked, len(keep) - top)[len(keep) - top]
                    keep, ranked = keep[ranked >= kth], ranked[ranked >= kth]
                keep = keep[np.lexsort((ids[keep], -ranked))[:top]]
            out.append((np.full(len(keep), name), ids[keep], row[keep]))
        q, v, s = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64(), from_pandas=True)], schema=_SCORES)

    return score


def block_scores(rows: DataFrame, queries: DataFrame, kind: str, top: int | None = None, least: float | None = None, vectors: int = 8192, asked: int = 1024) -> DataFrame:
    """(query_id, vec_id, score) of every query against all other rows: blocks of about ``asked`` queries meet blocks of about ``vectors`` rows.

    Both tables are (vec_id, v). ``least`` keeps scores from there on; ``top`` keeps the best of each block, among which a query's best are.
    """
    rows, queries = (t.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v") for t in (rows, queries))
    many, few = (max(1, -(-t.count() // size)) for t, size in ((rows, vectors), (queries, asked)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", block(many).alias("b"), every(few).alias("a"))
    right = queries.select(F.col("vec_id").alias("asked_id"), F.col("v").alias("asked"), block(few).alias("a"), every(many).alias("b"))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_score_block(kind, top, least), "query_id long, vec_id long, score double")

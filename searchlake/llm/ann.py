"""Approximate nearest neighbours by collision counting.

Vectors are dealt out to blocks by a hash; each block projects its unit vectors on the lines of random orthonormal
bases and sorts each projection. Around a query's own projections windows grow by virtual rehashing: a window of radius R is
``width`` standard deviations of what a difference of length R leaves on a line, nothing is hashed anew. A vector
collides with the query on the lines in whose windows it lies. How many collisions a vector at some distance reaches with the
probability ``sure`` is known from the lines alone (measured once on random directions), and that is the collision threshold.

A first, narrow window gives the vectors with most collisions; their distances are verified. The windows then grow to the
radius of the k-th nearest of them, and every vector whose collisions reach the threshold of that distance is verified with its
exact cosine, in order of collisions, the threshold rising as nearer vectors are found. Nothing else stops the search: no share
of the vectors bounds what is verified. The nearest of all blocks are merged.

Equal vectors of a block are handled as one with its smallest ids: of those, only the ``k + 1`` smallest can be
among the nearest ``k``.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither as query nor as candidate; finite ones of any length do (they are scaled by powers of two first). A query compares only with vectors of its own length. Ties go
to the smaller id; rows without an id take no part; repeated ids count once for each different vector, and all vectors of a
query's id share one list. Extra columns are ignored. A query without any candidate gives no row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that their largest components lie in [0.5, 1): squares neither overflow nor vanish, and no bit of a cosine changes."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("n_verified", pa.int64()), ("lead", pa.bool_())])


class Lines:
    """The lines of random orthonormal bases, and how many of them see a vector at a given distance collide."""

    def __init__(self, dim: int, projections: int, width: float, sure: float, seed: int = 11):
        r = np.random.default_rng(seed)
        bases = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
        self.lines = np.concatenate(bases, axis=1)[:, :projections].astype(np.float32)
        self.half = width / dim**0.5  # of a window of radius 1
        # collisions that a vector at distance x reaches with probability ``sure`` in windows of radius 1
        ways = r.standard_normal((1000, dim))
        seen = np.sort(np.abs(ways / np.sqrt((ways * ways).sum(axis=1))[:, None] @ self.lines), axis=1)
        self.steps = np.linspace(0, 1, 101)[1:]
        counts = np.stack([(seen <= self.half / x).sum(axis=1) for x in self.steps])
        self.needed = np.quantile(counts, 1 - sure, axis=1, method="lower").astype(np.int64)

    def threshold(self, distance: float, radius: float) -> int:
        """Collisions to ask for in windows of ``radius``, so that vectors within ``distance`` are found."""
        if distance > radius:
            return 0
        step = np.searchsorted(self.steps, distance / radius - 1e-9)
        return int(self.needed[min(step, len(self.steps) - 1)])


@lru_cache(4)
def _lines(dim: int, projections: int, width: float, sure: float) -> Lines:
    return Lines(dim, projections, width, sure)


class BlockIndex:
    """Sorted projections of the vectors of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, projections: int = 128, width: float = 1.5, sure: float = 0.97):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float64) + 0.0
        rows = vectors.view([("", f"V{vectors.shape[1] * 8}")]).ravel()
        _, first, same = np.unique(rows, return_index=True, return_inverse=True)
        self.vectors = scaled(vectors[first])
        by_class = np.argsort(same, kind="stable")
        begins = np.searchsorted(same[by_class], np.arange(len(first) + 1))
        self.ids = [np.unique(ids[by_class[a:b]])[: k + 1] for a, b in zip(begins, begins[1:])]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.lines = _lines(vectors.shape[1], projections, width, sure)
        shadow = np.ascontiguousarray(((self.vectors / self.norms[:, None]).astype(np.float32) @ self.lines.lines).T)
        self.order = np.argsort(shadow, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(shadow, self.order, axis=1)
        self.k = k

    def _edges(self, shadow: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and line, the window's places in the sorted projection."""
        half = (self.lines.half * radius).astype(np.float32)
        low = np.stack([np.searchsorted(s, shadow[:, j] - half, side="left") for j, s in enumerate(self.sorted)], axis=1)
        high = np.stack([np.searchsorted(s, shadow[:, j] + half, side="right") for j, s in enumerate(self.sorted)], axis=1)
        return low, high

    def _collisions(self, low: np.ndarray, high: np.ndarray, before: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Of every vector, the lines in whose windows it lies: counted inside windows, what they grew by, or outside, whichever is less."""
        n = len(self.vectors)
        inside = int((high - low).sum())
        grown = inside - int((before[2] - before[1]).sum()) if before else inside
        if n * len(low) - inside < grown:
            rows = [o[:a] for o, a in zip(self.order, low.tolist())] + [o[b:] for o, b in zip(self.order, high.tolist())]
            return len(low) - np.bincount(np.concatenate(rows), minlength=n)
        if before is None:
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist())]), minlength=n)
        rows = [o[a:b] for o, a, b in zip(self.order, low.tolist(), before[1].tolist())] + [o[a:b] for o, a, b in zip(self.order, before[2].tolist(), high.tolist())]
        return before[0] + np.bincount(np.concatenate(rows), minlength=n)

    def search(self, names: np.ndarray, queries: np.ndarray, group: int = 256):
        """Rows (query id, vector id, cosine, number verified, whether it is the query's first) of the nearest found, at most ``k`` per query."""
        out = []
        for at in range(0, len(queries), group):
            out += self._search(names[at : at + group], queries[at : at + group])
        return out

    def _search(self, names: np.ndarray, queries: np.ndarray):
        n, k = len(self.vectors), self.k
        queries = scaled(np.ascontiguousarray(queries, dtype=np.float64) + 0.0)
        lengths = np.sqrt((queries * queries).sum(axis=1))
        shadow = (queries / lengths[:, None]).astype(np.float32) @ self.lines.lines
        # a narrow window first: a tenth of each projection on either side
        middle = np.stack([np.searchsorted(s, shadow[:, j]) for j, s in enumerate(self.sorted)], axis=1)
        low, high = np.maximum(middle - n // 10 - k, 0), np.minimum(middle + n // 10 + k + 1, n)
        narrow, kept, radius = [], [], np.empty(len(queries))
        for q in range(len(queries)):
            counts = self._collisions(low[q], high[q])
            few = min(n, 4 * (k + 1))
            verified = {}
            self._verify(np.argpartition(-counts, few - 1)[:few], queries[q], lengths[q], verified)
            narrow.append(counts.astype(np.int32))
            kept.append(verified)
            radius[q] = self._reach(names[q], verified)
        wide = self._edges(shadow, np.minimum(radius, 2.0))
        out = []
        for q, (a, b) in enumerate(zip(*wide)):
            verified, r = kept[q], min(radius[q], 2.0)
            # windows of the radius may be narrower than the first ones on some lines
            grows = (a <= low[q]) & (b >= high[q])
            counts = self._collisions(a, b, (narrow[q], low[q], high[q]) if grows.all() else None)
            order = np.argsort(-counts[(rest := np.flatnonzero(counts >= self._need(radius[q], r)))], kind="stable")
            rest, begin, size = rest[order], 0, 4 * (k + 1)
            while begin < len(rest):
                # nearer vectors found by now let the threshold rise
                least = self._need(self._reach(names[q], verified), r)
                stop = begin + int(np.searchsorted(-counts[rest[begin : begin + size]], -least, side="right"))
                if stop == begin:
                    break
                self._verify(rest[begin:stop], queries[q], lengths[q], verified)
                begin, size = stop, 2 * size
            out.extend((int(names[q]), v, -s, len(verified), i == 0) for i, (s, v) in enumerate(self._nearest(names[q], verified)))
        return out

    def _need(self, distance: float, radius: float) -> int:
        return self.lines.threshold(distance, radius)

    def _verify(self, which: np.ndarray, query: np.ndarray, length: float, verified: dict[int, float]) -> None:
        which = np.asarray([c for c in which.tolist() if c not in verified], dtype=np.int64)
        dots = (self.vectors[which] * query).sum(axis=1)
        verified.update(zip(which.tolist(), (dots / (self.norms[which] * length)).tolist()))

    def _nearest(self, name: int, verified: dict[int, float]) -> list[tuple[float, int]]:
        """(minus cosine, id) of the ``k`` nearest of the verified vectors; ties go to smaller ids."""
        if not verified:
            return []
        which, scores = np.fromiter(verified, dtype=np.int64), np.fromiter(verified.values(), dtype=np.float64)
        few = min(len(scores), self.k + 1)
        bound = np.partition(scores, len(scores) - few)[len(scores) - few]
        near = np.flatnonzero(scores >= bound)
        return sorted({(-scores[c], v) for c in near.tolist() for v in self.ids[which[c]].tolist() if v != name})[: self.k]

    def _reach(self, name: int, verified: dict[int, float]) -> float:
        """Distance of the k-th nearest so far; without k of them, beyond all."""
        found = self._nearest(name, verified)
        return 4.0 if len(found) < self.k else float(np.sqrt(max(0.0, 2 + 2 * found[-1][0]))) + 1e-6


def _matrix(table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column(0).to_numpy()
    flat = table.column(1).combine_chunks()
    values = (flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False)
    return ids, values.reshape(-1, dim)


def _matcher(k: int, projections: int, width: float, sure: float):
    def match(key, left, right):
        dim = key[2].as_py()
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        index = BlockIndex(*_matrix(left, dim), k, projections, width, sure)
        rows = index.search(*_matrix(right, dim))
        columns = list(zip(*rows)) if rows else [[]] * len(_OUT)
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    return match


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 128, width: float = 1.5, sure: float = 0.97, block: int = 16_384, query_block: int = 4_096) -> DataFrame:
    """The ``k`` nearest found for every row whose id is divisible by ``every``: query_id, rank, vec_id, score, n_verified.

    Blocks of queries meet blocks of vectors; both are bounded, so is every task. ``n_verified`` is how many vectors
    (equal ones of a block counted once) the query was compared with, over all blocks.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fit).withColumn("dim", F.size("v"))
    asked = F.col("vec_id") % every == 0
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).first()
    blocks = max(1, -(-sizes["n"] // block))
    # large blocks of queries spare copies of the vectors; a small table is cut further, for all cores to have work
    few = max(1, min(-(-sizes["q"] // 256), -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks)))
    query_blocks = max(few, -(-sizes["q"] // query_block))
    spread = F.xxhash64("vec_id", "v")
    data = rows.withColumn("b", F.pmod(spread, F.lit(blocks).cast("long"))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where(asked).dropDuplicates(["vec_id", "v"]).withColumn("qb", F.pmod(F.shiftright(spread, 20), F.lit(query_blocks)).cast("int"))
    queries = queries.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["b", "qb", "dim"]
    data = data.select("vec_id", "v", *keys)
    queries = queries.select(F.col("vec_id").alias("asked_id"), F.col("v").alias("asked"), *keys)
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_matcher(k, projections, width, sure), "query_id long, vec_id long, score double, n_verified long, lead boolean")
    # a block gives each query k rows at most
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    verified = F.sum(F.when(F.col("lead"), F.col("n_verified"))).over(Window.partitionBy("query_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .withColumn("n_verified", verified)
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_verified")
    )

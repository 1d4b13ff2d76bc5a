"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved with learned filters at every second byte of the whole
document. Chunks of ``CHUNK`` bytes (each reads on into the next one, so no place is missed) keep the maximum of
each filter; a small hidden layer gives a log-odds per chunk, and their mean, weighted by how many of a
chunk's bytes are text, is the document's log-odds.

Training uses at most ``most_rows`` labelled documents of each class, never of the held-out fold, chosen by a hash of the id,
and of these, in that order, as many as have ``most_bytes`` of text together (a document longer than what is left is passed
over). Of a document that is used the whole text is. The share of the classes among all labels of the training folds
shifts the log-odds.

Defined results: a null text counts as empty; an empty one is scored as a chunk without text. Documents with null ids belong to
the fold of the empty string and are scored. Ids that labels contradict themselves about, and null labels, are not learned from.
Without any label every score is 0.5. Extra columns are ignored; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch, fold_column, fold_of, slices, small_batches

CHUNK, WIDTH, STRIDE, SIZE, FILTERS, HIDDEN = 256, 8, 2, 6, 40, 16
LIMIT = 0.7


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``CHUNK + WIDTH`` bytes, the share of text in each, and the first row of every text."""
    counts = np.asarray([max(1, -(-len(t) // CHUNK)) for t in texts])
    firsts = np.cumsum(counts) - counts
    data = np.zeros((int(counts.sum()), CHUNK), dtype=np.uint8)
    fill = np.ones(len(data), dtype=np.float32)
    flat = data.reshape(-1)
    for text, first, count in zip(texts, firsts.tolist(), counts.tolist()):
        flat[first * CHUNK : first * CHUNK + len(text)] = np.frombuffer(text, dtype=np.uint8)
        fill[first + count - 1] = (len(text) - (count - 1) * CHUNK) / CHUNK
    after = np.zeros((len(data), WIDTH), dtype=np.uint8)
    after[:-1] = data[1:, :WIDTH]
    after[firsts + counts - 1] = 0
    return np.concatenate([data, after], axis=1), fill, firsts


class ByteNet:
    """The network: embedding, filters, hidden layer, output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        self.p = {
            "emb": f32(r.normal(0, 0.5, (256, SIZE))),
            "w": f32(r.normal(0, (2 / (WIDTH * SIZE)) ** 0.5, (WIDTH * SIZE, FILTERS))),
            "b": np.zeros(FILTERS, dtype=np.float32),
            "h": f32(r.normal(0, (2 / (FILTERS + 1)) ** 0.5, (FILTERS + 1, HIDDEN))),
            "c": np.zeros(HIDDEN, dtype=np.float32),
            "o": f32(r.normal(0, HIDDEN**-0.5, HIDDEN)),
            "d": np.zeros(1, dtype=np.float32),
        }
        self.shift = 0.0

    def _pool(self, rows: np.ndarray, where: bool = False):
        places = CHUNK // STRIDE
        embedded = self.p["emb"][rows]  # rows, bytes, SIZE
        n, s = len(rows), embedded.strides
        windows = np.lib.stride_tricks.as_strided(embedded, (n, places, WIDTH * SIZE), (s[0], s[1] * STRIDE, s[2]))
        values = (windows.reshape(-1, WIDTH * SIZE) @ self.p["w"]).reshape(n, places, FILTERS)
        if where:
            at = values.argmax(axis=1)
            return np.take_along_axis(values, at[:, None, :], axis=1)[:, 0] + self.p["b"], at
        return values.max(axis=1) + self.p["b"], None

    def chunk_logits(self, rows: np.ndarray, fill: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=np.float32)
        for a in range(0, len(rows), 512):
            pooled, _ = self._pool(rows[a : a + 512])
            x = np.concatenate([np.maximum(pooled, 0), fill[a : a + 512, None]], axis=1)
            out[a : a + 512] = np.maximum(x @ self.p["h"] + self.p["c"], 0) @ self.p["o"] + self.p["d"][0]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows, fill, firsts = chunked(texts)
        weight = fill + 1e-3
        total = np.add.reduceat(self.chunk_logits(rows, fill) * weight, firsts) / np.add.reduceat(weight, firsts)
        return 1 / (1 + np.exp(-(np.clip(total + self.shift, -30, 30).astype(np.float64))))

    def gradients(self, rows: np.ndarray, fill: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of chunks, for every parameter."""
        pooled, at = self._pool(rows, True)
        x = np.concatenate([np.maximum(pooled, 0), fill[:, None]], axis=1)
        hidden = x @ self.p["h"] + self.p["c"]
        active = np.maximum(hidden, 0)
        error = (1 / (1 + np.exp(-np.clip(active @ self.p["o"] + self.p["d"][0], -30, 30))) - labels) / len(rows)
        back = (error[:, None] * self.p["o"]) * (hidden > 0)
        into = (back @ self.p["h"].T)[:, :FILTERS] * (pooled > 0)
        # each filter learns from the window that gave its maximum
        places = at[:, :, None] * STRIDE + np.arange(WIDTH)
        seen = np.take_along_axis(rows[:, None, :], places, axis=2)  # chunk, filter, byte
        window = self.p["emb"][seen].reshape(len(rows), FILTERS, WIDTH * SIZE)
        spread = (into[:, :, None] * self.p["w"].T[None]).reshape(-1, SIZE)
        flat = seen.reshape(-1)
        return {
            "o": active.T @ error, "d": error.sum(keepdims=True), "h": x.T @ back, "c": back.sum(axis=0), "b": into.sum(axis=0),
            "w": np.einsum("cf,cfk->kf", into, window, optimize=True),
            "emb": np.stack([np.bincount(flat, spread[:, k], minlength=256) for k in range(SIZE)], axis=1),
        }

    def train(self, rows: np.ndarray, fill: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam steps over chunks in random order."""
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for a in range(0, len(rows), batch):
                pick = order[a : a + batch]
                t += 1
                step = rate * min(1, 2 * (1 - t / (steps + 1)))
                for k, g in self.gradients(rows[pick], fill[pick], labels[pick]).items():
                    g = g.astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 1500, most_bytes: int = 1 << 22) -> ByteNet | None:
    """A network trained on at most ``most_rows`` documents and ``most_bytes`` of each class, held-out fold excluded."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.where(fold_column("doc_id") != 2).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    order: dict[int, int] = {}  # of at most 2 * most_rows ids
    for y in (0, 1):
        first = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
        order.update((r["doc_id"], y) for r in first.select("doc_id").collect())
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # one pass over all documents: what may be learned from is few texts, which are read again from a table of their own
    scratch = Scratch(spark)
    named = F.broadcast(spark.createDataFrame([(i,) for i in order], "doc_id long"))
    few = scratch.save(slim.join(named, "doc_id", "left_semi"), "labelled")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + CHUNK)
    sizes = {r["doc_id"]: r["n"] for r in few.groupBy("doc_id").agg(size.alias("n")).collect()}
    chosen, left = {}, {0: most_bytes, 1: most_bytes}
    for name, y in order.items():
        if sizes.get(name, most_bytes + 1) <= left[y]:
            left[y] -= sizes[name]
            chosen[name] = y
    if not chosen:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, chunks, fills = [], [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows, fill, _ = chunked([_utf8(text)])
                    names += [name] * len(rows)
                    chunks += [row.tobytes() for row in rows]
                    fills += fill.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(chunks, pa.binary()), pa.array(fills, pa.float32())], names=["doc_id", "chunk", "fill"])

    wanted = few.join(F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id", "left_semi").select("doc_id", "text")
    got = wanted.mapInArrow(cut, "doc_id long, chunk binary, fill float").orderBy("doc_id", "chunk").collect()  # most_bytes a class, as counted above
    scratch.drop()
    if not got:
        return None
    rows = np.frombuffer(b"".join(bytes(r["chunk"]) for r in got), dtype=np.uint8).reshape(len(got), -1)
    truth = np.asarray([chosen[r["doc_id"]] for r in got], dtype=np.float32)
    if truth.min() == truth.max():
        return None
    net = ByteNet()
    net.train(rows, np.asarray([r["fill"] for r in got], dtype=np.float32), truth)
    net.shift = float(np.log(counts[1] / counts[0]) - np.log(truth.sum() / (len(truth) - truth.sum())))
    return net


def score_documents(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``carry`` also the whole row as a struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else (net.p, net.shift))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if shared.value is not None:
            model = ByteNet()
            model.p, model.shift = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = list(map(_utf8, part.column(1).to_pylist()))
                scores = model.score(texts) if model else np.full(len(texts), 0.5)
                held = [fold_of(i) == 2 for i in part.column(0).to_pylist()]
                columns = [part.column(0), pa.array(held), pa.array(scores), pa.array((scores >= LIMIT).astype(np.int32))]
                names = [*schema.names, *part.schema.names[2:]]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=names)

    small_batches(docs.sparkSession)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    extra = f", row {slim.schema['row'].dataType.simpleString()}" if carry else ""
    return slim.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int{extra}")

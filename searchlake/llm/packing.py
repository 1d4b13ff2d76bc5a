"""Bounded-space online packing of token ids into fixed-length sequences.

A task keeps at most ``windows`` open sequences. A document gives full sequences while it has enough
ids; its rest goes to the open window it fits best. If it fits none and all windows are open, the
fullest one is topped up with a cut of it and emitted, so that emitted sequences have no gap. What
is open at the end of a task is merged, first within the task, then over groups of tasks, level by
level, so that one partial sequence remains in all. It is padded unless its length is a power of two.

Defined results: a null text counts as empty; an empty one gives one piece, its end id. Repeated ids
give pieces for each row. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch, slices, small_batches
from searchlake.llm.tokens import encoder, vocabulary_path

GROUP = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")] + [("ids", pa.binary()), ("part", pa.int64())])


def padded(length: int, size: int) -> int:
    """Length after padding: a power of two stays, anything else grows to ``size``."""
    return length if length and length & (length - 1) == 0 else size


class Packer:
    """Open windows of one task. A piece is (doc_id, start, raw ids, doc_tokens)."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.most, self.next_id = size, windows, first_id
        self.open: list[list] = []  # [used, pieces]
        self.done: list[tuple] = []  # rows of emitted sequences

    def emit(self, pieces: list[tuple], used: int) -> None:
        at, total = 0, padded(used, self.size)
        for doc_id, start, raw, doc_tokens in pieces:
            n = len(raw) // 4
            self.done.append((doc_id, start, n, zlib.crc32(raw), doc_tokens, self.next_id, at, total, raw, None))
            at += n
        self.next_id += 1

    def add(self, doc_id, raw: bytes, start: int, doc_tokens: int) -> None:
        size, at, n = self.size, 0, len(raw) // 4
        while n - at >= size:
            self.emit([(doc_id, start + at, raw[4 * at : 4 * (at + size)], doc_tokens)], size)
            at += size
        while at < n:
            rest = n - at
            best = min((w for w in self.open if size - w[0] >= rest), key=lambda w: size - w[0], default=None)
            take = rest
            if best is None:
                if len(self.open) < self.most:
                    best = [0, []]
                    self.open.append(best)
                else:
                    best = max(self.open, key=lambda w: w[0])
                    take = size - best[0]
            best[1].append((doc_id, start + at, raw[4 * at : 4 * (at + take)], doc_tokens))
            best[0] += take
            at += take
            if best[0] == size:
                self.emit(best[1], size)
                self.open.remove(best)

    def close(self) -> list[tuple]:
        """Merges the open windows; full ones are emitted, the pieces of the last partial one returned."""
        merged = Packer(self.size, 1, self.next_id)
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc_id, start, raw, doc_tokens in pieces:
                merged.add(doc_id, raw, start, doc_tokens)
        self.done += merged.done
        self.next_id, self.open = merged.next_id, []
        return merged.open[0][1] if merged.open else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _merger(size: int, lowest: int, last: bool):
    """Merges the partial sequences of a group of at most ``GROUP`` tasks."""

    def merge(key, table):
        group = key[0].as_py()
        packer = Packer(size, 1, lowest | (group << 16))
        for row in table.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist():
            packer.add(row["doc_id"], row["ids"], row["start"], row["doc_tokens"])
        pieces = packer.close()
        if last and pieces:
            packer.emit(pieces, sum(len(p[2]) // 4 for p in pieces))
            pieces = []
        return pa.Table.from_batches([_batch(packer.done + [(d, s, len(raw) // 4, None, n, None, None, None, raw, group) for d, s, raw, n in pieces])])

    return merge


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, windows: int = 16, end_id: int = 2, vocabulary: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length, ids."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(path), TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype="<u4").tobytes()
        packer = Packer(size, windows, part << 32)
        for batch in batches:
            for cut in slices(batch, "text"):
                for doc_id, raw in zip(cut.column(0).to_pylist(), tool.encode(cut.column(1).to_pylist())):
                    packer.add(doc_id, raw + end, 0, len(raw) // 4 + 1)
                if len(packer.done) >= 512:
                    yield _batch(packer.done)
                    packer.done = []
        rest = packer.close()
        rows = packer.done + [(d, s, len(raw) // 4, None, n, None, None, None, raw, part) for d, s, raw, n in rest]
        if rows:
            yield _batch(rows)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    full_schema = f"{SCHEMA}, part long"
    first = scratch.save(slim.mapInArrow(run, full_schema), "packed-0")
    out = first.where("part is null").drop("part")
    rest = first.where("part is not null")
    top = rest.agg(F.max("part")).first()[0]
    level = 0
    while top is not None:
        level += 1
        lowest, last = (1 << 62) | (level << 54), top < GROUP
        merged = scratch.save(rest.groupBy(F.floor(F.col("part") / GROUP).alias("_g")).applyInArrow(_merger(size, lowest, last), full_schema), f"packed-{level}")
        out = out.unionByName(merged.where("part is null").drop("part"))
        rest, top = merged.where("part is not null"), None if last else top // GROUP
    return out

"""Token-id output with Re-Pair grammar compression.

The ids of a shard are rewritten round by round: frequent adjacent pairs become nonterminals, wherever they stand (never
across the end of a document), the more frequent pair first where two overlap, until no pair occurs ``least`` times. A
rule takes twelve bytes and each use of it saves three, so pairs that are rarer than four make a file larger; with ``least=2``
the rounds go on until no pair repeats. There is no bound on rounds or symbols. A shard file keeps the rules, the length
each rule expands to, the rewritten sequence and where every document starts, so any document, or any stretch of one, is decoded
without the others.

File layout (little endian): magic ``RPG2``; u32 counts of rules, rounds, documents, and u64 of
symbols and of ids; u32 vocabulary size; rule pairs (u32, u32); expansion length of every rule (u32); first rule of every
round (u32); start of every document in the symbols (u64) and in the ids (u64); low halves of the symbols (u16), and their high
halves (u8 or u16) if they need more. Document ids travel beside the file, in its table row.

Defined results: a null text counts as empty, and an empty one holds the end id alone; equal ids
order by a hash of the text, then the text; null ids come first; an empty table gives no files. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import TIES, Scratch, deal_column, order_cuts, partitions, prefix_starts, slices, small_batches
from searchlake.llm.tokens import encoder, vocabulary_path

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIIIQQI")
_BITS = 18
SPREAD = 64  # a round takes pairs down to this part of the most frequent one


def _pair_slot(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    mixed = left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B) + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return mixed >> np.uint32(32 - _BITS)


def _frequent(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """Pairs that occur ``least`` times or more, the most frequent first; those far behind the first one wait for another round."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    counts = np.diff(np.append(begins, len(keys)))
    heavy = np.flatnonzero(counts >= least)
    if not len(heavy):
        return keys[:0]
    heavy = heavy[counts[heavy] >= counts[heavy].max() // SPREAD]
    return keys[begins[heavy[np.argsort(-counts[heavy], kind="stable")[:most]]]]


def _places(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places to rewrite, with their ranks: no two overlap, and lower ranks win over their neighbours."""
    close = at[1:] == at[:-1] + 1
    loses = np.zeros(len(at), dtype=bool)
    loses[1:] |= close & (rank[:-1] < rank[1:])
    loses[:-1] |= close & (rank[1:] < rank[:-1])
    at, rank = at[~loses], rank[~loses]
    # neighbours that are left have equal ranks (runs of one symbol): every other one of them, from the left
    fresh = np.append(True, at[1:] != at[:-1] + 1)[: len(at)]
    order = np.arange(len(at))
    keep = (order - np.maximum.accumulate(np.where(fresh, order, 0))) & 1 == 0
    return at[keep], rank[keep]


def compress(ids: np.ndarray, starts: np.ndarray, vocabulary: int, least: int = 4, batch: int = 1 << 14):
    """Rules, first rule of each round, symbols and the documents' starts in them.

    A round rewrites up to ``batch`` pairs that occur ``least`` times or more; the rounds end when there is none. A pair's
    count never grows, so places whose pair was rarer are looked at again only when one of their symbols changes.
    """
    least = max(2, least)
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), dtype=bool)  # the symbol ends a document
    if len(starts):
        last[np.append(starts[1:], len(seq)).astype(np.int64) - 1] = True
    rules, firsts, total, turn, most = [], [], vocabulary, 0, batch
    alive = ~last  # the pair that starts here may be frequent
    while True:
        at = np.flatnonzero(alive)
        left, right = seq[at], seq[at + 1]
        turn += 1
        slot = _pair_slot(left, right, turn)
        often = np.bincount(slot, minlength=1 << _BITS)[slot] >= least
        alive[at[~often]] = False
        at, slot = at[often], slot[often]
        keys = (left[often].astype(np.uint64) << np.uint64(32)) | right[often]
        pairs = _frequent(keys, least, most)
        if not len(pairs):
            break
        table = np.full(1 << _BITS, -1, dtype=np.int32)
        # of two pairs for one slot the rarer waits for another round
        table[_pair_slot((pairs[::-1] >> np.uint64(32)).astype(np.uint32), pairs[::-1].astype(np.uint32), turn)] = np.arange(len(pairs), dtype=np.int32)[::-1]
        rank = table[slot]
        fit = (rank >= 0) & (pairs[rank] == keys)
        same = at[fit]
        at, rank = _places(same, rank[fit])
        used = np.bincount(rank, minlength=len(pairs))
        good = used >= 2
        if not good.any():
            if most == 1:  # it only overlaps itself
                alive[same] = False
            most = 1 if most > 1 else batch  # pairs stand in each other's way: the most frequent one goes alone
            continue
        most = batch
        fit = good[rank]
        at, rank = at[fit], rank[fit]
        number = (total + np.cumsum(good) - 1).astype(np.uint32)
        rules.append(np.stack([(pairs[good] >> np.uint64(32)).astype(np.uint32), pairs[good].astype(np.uint32)], axis=1))
        firsts.append(total - vocabulary)
        seq[at] = number[rank]
        last[at] = last[at + 1]
        alive[at] = ~last[at]
        before = np.maximum(at - 1, 0)
        # a symbol before that was rewritten too is gone or has its own new pair
        alive[before] = ~last[before]
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq, last, alive = seq[stay], last[stay], alive[stay]
        total += int(good.sum())
    ends = np.flatnonzero(last) + 1
    begins = np.concatenate([[0], ends[:-1]]).astype(np.uint64) if len(starts) else np.zeros(0, dtype=np.uint64)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)
    return table, np.asarray(firsts, dtype=np.uint32), seq, begins


def lengths(rules: np.ndarray, firsts: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each rule stands for (a round's rules use earlier symbols only)."""
    size = np.ones(vocabulary + len(rules), dtype=np.uint32)
    bounds = [*firsts.tolist(), len(rules)]
    for a, b in zip(bounds, bounds[1:]):
        size[vocabulary + a : vocabulary + b] = size[rules[a:b, 0]] + size[rules[a:b, 1]]
    return size[vocabulary:]


class Grammar:
    """Rules ready for decoding: what short rules stand for is kept as one array."""

    def __init__(self, rules: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, vocabulary: int, short: int = 64):
        self.rules, self.vocabulary, self.short = rules, vocabulary, short
        self.size = np.concatenate([np.ones(vocabulary, dtype=np.int64), sizes])
        kept = np.where(self.size <= short, self.size, 0)
        self.at = np.cumsum(kept) - kept
        self.flat = np.zeros(int(kept.sum()), dtype=np.uint32)
        self.flat[:vocabulary] = np.arange(vocabulary, dtype=np.uint32)
        bounds = [*firsts.tolist(), len(rules)]
        for a, b in zip(bounds, bounds[1:]):  # a round's rules use earlier symbols only
            rows = np.arange(a, b)[sizes[a:b] <= short]
            if len(rows):
                done = self._gather(rules[rows].reshape(-1))
                self.flat[self._spread(self.at[vocabulary + rows], self.size[vocabulary + rows])] = done

    @staticmethod
    def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """first, first + 1, ... for each, ``count`` of them."""
        ends = np.cumsum(count)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)

    def _gather(self, seq: np.ndarray) -> np.ndarray:
        return self.flat[self._spread(self.at[seq], self.size[seq])]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for; symbols of long rules are split until only short ones are left."""
        seq = seq.astype(np.int64)
        while True:
            long = self.size[seq] > self.short
            if not long.any():
                return self._gather(seq)
            wide = np.repeat(seq, long.astype(np.int64) + 1)
            at = np.flatnonzero(long)
            which = self.rules[seq[at] - self.vocabulary]
            at += np.arange(len(at))
            wide[at], wide[at + 1] = which[:, 0], which[:, 1]
            seq = wide


def _high_kind(symbols: int) -> str | None:
    """Type of the symbols' high halves, if they need any."""
    return None if symbols <= 1 << 16 else ("<u1" if symbols <= 1 << 24 else "<u2")


def write_shard(ids: np.ndarray, starts: np.ndarray, vocabulary: int, **options) -> bytes:
    rules, firsts, seq, begins = compress(ids, starts, vocabulary, **options)
    highs = _high_kind(vocabulary + len(rules))
    return b"".join(
        [
            _HEAD.pack(MAGIC, len(rules), len(firsts), len(starts), len(seq), len(ids), vocabulary),
            rules.astype("<u4").tobytes(),
            lengths(rules, firsts, vocabulary).astype("<u4").tobytes(),
            firsts.astype("<u4").tobytes(),
            begins.astype("<u8").tobytes(),
            np.asarray(starts).astype("<u8").tobytes(),
            seq.astype("<u2").tobytes(),
            (seq >> np.uint32(16)).astype(highs).tobytes() if highs else b"",
        ]
    )


class Shard:
    """A shard file in memory."""

    def __init__(self, data: bytes):
        magic, n_rules, n_rounds, n_docs, n_seq, self.n_ids, self.vocabulary = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.sizes = take("<u4", n_rules)
        self.firsts = take("<u4", n_rounds)
        self.begins = take("<u8", n_docs)
        self.starts = take("<u8", n_docs)
        self.seq = take("<u2", n_seq).astype(np.uint32)
        highs = _high_kind(self.vocabulary + n_rules)
        if highs:
            self.seq |= take(highs, n_seq).astype(np.uint32) << np.uint32(16)
        self.grammar = Grammar(self.rules, self.sizes, self.firsts, self.vocabulary)

    def ids(self) -> np.ndarray:
        return self.grammar.expand(self.seq)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``k``; expands only the symbols that cover them."""
        high = int(self.begins[k + 1]) if k + 1 < len(self.begins) else len(self.seq)
        part = self.seq[int(self.begins[k]) : high].astype(np.int64)
        ends = np.cumsum(self.grammar.size[part])
        total = int(ends[-1]) if len(ends) else 0
        start, stop = min(start, total), total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.grammar.expand(part[a:b])[skip : skip + stop - start]


_FILES = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("data", pa.binary())])


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocabulary: str | None = None, most_ids: int = 500_000, scratch: Scratch | None = None, parts: int | None = None) -> DataFrame:
    """Encode all documents and write shard files in ascending id order.

    Returns the file table (part, block, doc_ids, n_tokens, data), written to a new folder of the shared one, where it stays; files
    hold at most ``most_ids`` ids, or one document.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, keep=True)
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, block = encoder(path), TaskContext.get().partitionId(), 0
        size = tool.tokenizer.get_vocab_size()
        end = np.asarray([end_id], dtype="<u4").tobytes()
        names, held, count = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter((len(x) // 4 for x in held), dtype=np.int64, count=len(held))
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            data = write_shard(ids, np.cumsum(sizes) - sizes, size)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, block, names, count, data), _FILES)], schema=_FILES)

        for batch in batches:
            for cut in slices(batch, "text"):
                for name, raw in zip(cut.column(0).to_pylist(), tool.encode(cut.column(1).to_pylist())):
                    raw += end
                    if held and count + len(raw) // 4 > most_ids:
                        yield flush()
                        names, held, count, block = [], [], 0, block + 1
                    names.append(name)
                    held.append(raw)
                    count += len(raw) // 4
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = order_cuts(slim, "doc_id", parts or partitions(spark))
    tie = F.pmod(F.xxhash64("text"), F.lit(TIES))
    dealt = slim.repartitionById(max(1, sum(cuts.values())), deal_column(cuts, "doc_id", tie).cast("int"))
    ordered = dealt.sortWithinPartitions("doc_id", tie, "text")
    return scratch.save(ordered.mapInArrow(run, "part int, block int, doc_ids array<long>, n_tokens long, data binary"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, ids."""
    starts = prefix_starts(files.select("part", "block", "n_tokens"), "part", "block", "n_tokens", "first").select("part", "block", "first")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, data, first = (batch.column(i)[k].as_py() for i in range(3))
                shard = Shard(data)
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                cuts = [*(int(x) for x in shard.starts), shard.n_ids]
                for at in range(0, len(names), 256):
                    spans = list(zip(cuts[at : at + 256], cuts[at + 1 : at + 257]))
                    parts = [raw[4 * a : 4 * b] for a, b in spans]
                    columns = [names[at : at + 256], [first + a for a, _ in spans], [b - a for a, b in spans], [zlib.crc32(x) for x in parts], parts]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    rows = files.join(starts, ["part", "block"]).select("doc_ids", "data", "first")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")

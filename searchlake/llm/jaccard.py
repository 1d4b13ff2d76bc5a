"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct five-word shingles (64-bit hashes); equal sets form a class, and the join
runs over classes. If two sets are similar enough they share a shingle among the first
``n - ceil(t n) + 1`` of each under *any* global order. Three orders are used, all of them by rarity first
(levels of how often a shingle was seen; a table of fixed size) and by a different permutation within a level. Pairs that meet
under the first order, with sizes, positions and bit signatures that leave enough overlap possible, must also meet under the
second and third: the prefixes of these orders are compared first, and only for pairs that meet in all of them do whole sets
travel and are verified.

A shingle's level counts what every task met twice or more, and an estimate from every ``EVERY``-th occurrence for
shingles that tasks meet only once. Levels set the order, never what is found.

No group's pairs are all written out. First every set is compared with two of those that it meets: in each of its
shingles' groups a pivot of like size and a neighbour are at hand, and of all these the one met most often and the one that
holds a shared shingle earliest are taken. Groups of frequent shingles are cut into buckets of some thousand rows, whose pivots are
compared with each other. What is similar is merged into components. Only groups that
still hold several components go on: the rows outside the group's main component are compared with the rows of other
components of like size. The smaller set of a pair must hold the shared shingle in the shorter prefix that sets of equal size need, so
groups in which no set does give no pairs. Every pair that could be similar is so either verified or already connected.

Classes have 64-bit keys; two of a billion different sets share one with a probability of 3 %.

Defined results: a null or wordless text has an empty set and links with nothing; under five words the whole sequence is
the one shingle. Rows with a null id are kept, take no part in components' numbering unless all ids of a component are
null, and get the component of their text. Rows with equal ids are separate documents. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch, slices, small_batches

WIDTH, PERCENT = 5, 80
SLOTS, BLOCK = 1 << 22, 1 << 14
EVERY = 128
BAND = 1.12  # sets whose sizes differ by less than this factor are of like size
CROWD = 12  # levels above this are cut into buckets
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    count = len(words) - width + 1
    total = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        total = (total ^ (each[k : k + count] * _MIX[k % len(_MIX)])) * _MIX[(k + 1) % len(_MIX)]
        total ^= total >> np.uint64(31)
    return np.unique(total)


def class_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def order_keys(hashes: np.ndarray, levels: np.ndarray, which: int) -> np.ndarray:
    """Sort keys of order ``which``: the rarity level above a permutation of the hash."""
    mixed = (hashes ^ _MIX[which]) * _MIX[(which + 2) % len(_MIX)]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[(which + 3) % len(_MIX)]
    return (mixed >> np.uint64(6)) | (level_of(hashes, levels).astype(np.uint64) << np.uint64(58))


def prefix(hashes: np.ndarray, levels: np.ndarray, which: int, length: int) -> np.ndarray:
    """The first ``length`` elements of a set in order ``which``, in no order themselves."""
    return hashes[np.argpartition(order_keys(hashes, levels, which), length - 1)[:length]] if length < len(hashes) else hashes


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


SIGNATURE = 8  # 64-bit words


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements that fall to each of ``64 * SIGNATURE`` bits.

    Two sets differ in at least as many elements as their signatures in bits, which bounds their overlap.
    """
    place = ((hashes * _MIX[4]) >> np.uint64(20)) % np.uint64(64 * SIGNATURE)
    odd = np.bincount(place.astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("sig", pa.list_(pa.int64())), ("h", pa.int64()), ("seen", pa.int32()), ("hits", pa.int32())])


def _describe(width: int, most: int = 4_000_000):
    """doc rows (doc_id, n, c, sig), and rows (h, seen, hits) of shingles: met in several sets, or one of ``EVERY`` met in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known, turn = [], 0, set(), TaskContext.get().partitionId() << 20

        def repeated() -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            drawn = (values ^ np.uint64(xxhash.xxh3_64_intdigest(turn.to_bytes(8, "little")))) * _MIX[0]
            hit = (counts == 1) & ((drawn >> np.uint64(32)) % np.uint64(EVERY) == 0)
            kept = (counts > 1) | hit
            n = int(kept.sum())
            none = pa.nulls(n, pa.int64())
            seen = np.where(hit, 0, counts)[kept].astype(np.int32)
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(n, pa.list_(pa.int64())), pa.array(as_long(values[kept])), pa.array(seen), pa.array(hit[kept].astype(np.int32))], schema=_SETS)

        for batch in batches:
            for cut in slices(batch, "text"):
                sizes, keys, signs = [], [], []
                for text in cut.column(1).to_pylist():
                    found = shingles(text, width)
                    sizes.append(len(found))
                    key = class_key(found) if len(found) else None
                    keys.append(key)
                    signs.append(signature(found) if len(found) else None)
                    if key is not None and key not in known:
                        known.add(key)
                        held.append(found)
                        size += len(found)
                n = cut.num_rows
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], schema=_SETS)
                if size > most:
                    yield repeated()
                    held, size, known = [], 0, set()
        if held:
            yield repeated()

    return run


def _levels(seen: DataFrame) -> bytes:
    """Rarity level of every slot (0: rare), a table of ``SLOTS`` bytes whatever the input."""

    def pack(key, table):
        level = np.zeros(BLOCK, dtype=np.uint8)
        at = table.column("at").to_numpy()
        np.maximum.at(level, at, table.column("level").to_numpy().astype(np.uint8))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["block", "data"])

    slot = F.pmod(F.col("h"), F.lit(SLOTS))  # SLOTS is a power of two, so the sign does not matter
    counted = seen.groupBy("h").agg(F.sum("seen").alias("total"), F.sum("hits").alias("hits"))
    # a single hit may be all there is of a shingle
    counted = counted.select("h", (F.col("total") + F.when(F.col("hits") >= 2, F.col("hits") * EVERY).otherwise(0)).alias("total")).where(F.col("total") >= 2)
    counted = counted.groupBy(slot.cast("int").alias("slot")).agg(F.floor(F.log2(F.max("total").cast("double"))).cast("int").alias("level"))
    counted = counted.select((F.col("slot") / BLOCK).cast("int").alias("block"), (F.col("slot") % BLOCK).alias("at"), F.least("level", F.lit(31)).alias("level"))
    table = np.zeros(SLOTS, dtype=np.uint8)
    for row in counted.groupBy("block").applyInArrow(pack, "block int, data binary").collect():  # SLOTS bytes at most
        table[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row["data"]), dtype=np.uint8)
    return zlib.compress(table.tobytes(), 1)


def _read_levels(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


_TOKENS = pa.schema([("token", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("buckets", pa.int32()), ("bucket", pa.int32())])


def level_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(hashes % np.uint64(SLOTS)).astype(np.int64)]


def _prefixes(width: int, percent: int, shared, crowd: int):
    """The first order's prefix of every set that the task has not met yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, known = _read_levels(shared.value), set()
        for batch in batches:
            for cut in slices(batch, "text"):
                tokens, keys, sizes, places, buckets, mine = [], [], [], [], [], []
                for text in cut.column(0).to_pylist():
                    found = shingles(text, width)
                    if not len(found):
                        continue
                    key = class_key(found)
                    if key in known:
                        continue
                    if len(known) < 1_000_000:
                        known.add(key)
                    n = len(found)
                    p = prefix_length(n, percent)
                    order = order_keys(found, levels, 0)
                    first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                    first = first[np.argsort(order[first], kind="stable")]
                    tokens.append(found[first])
                    keys.append(np.full(p, key, dtype=np.int64))
                    sizes.append(np.full(p, n, dtype=np.int32))
                    places.append(np.arange(p, dtype=np.int32))
                    cut_in = (1 << np.maximum(level_of(found[first], levels).astype(np.int32) - crowd, 0)).astype(np.int32)
                    buckets.append(cut_in)
                    mine.append(((key >> 20 & 0x7FFFFFFF) % cut_in).astype(np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(tokens))), *(pa.array(np.concatenate(x)) for x in (keys, sizes, places, buckets, mine))], schema=_TOKENS)

    return run


def _whole_sets(width: int, percent: int, shared, bits):
    """(c, whole set, short hashes of its prefixes in the second and third order) of documents whose id may be asked for."""
    schema = pa.schema([("c", pa.int64()), ("items", pa.list_(pa.int64())), ("second", pa.list_(pa.int32())), ("third", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, asked, known = _read_levels(shared.value), bits.value, set()
        for batch in batches:
            for cut in slices(batch, "text"):
                keep = asked[cut.column(1).to_numpy()]
                keys, items, firsts = [], [], ([], [])
                for text in cut.column(0).filter(pa.array(keep)).to_pylist():
                    found = shingles(text, width)
                    if not len(found):
                        continue
                    key = class_key(found)
                    if key in known:
                        continue
                    if len(known) < 1_000_000:
                        known.add(key)
                    p = prefix_length(len(found), percent)
                    keys.append(key)
                    items.append(as_long(found))
                    for which in (1, 2):
                        firsts[which - 1].append(prefix(found, levels, which, p).view(np.uint32)[::2].view(np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(items, pa.list_(pa.int64())), *(pa.array(x, pa.list_(pa.int32())) for x in firsts)], schema=schema)

    return run


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of sets of n and m elements: ceil(p (n + m) / (100 + p))."""
    return F.ceil((F.lit(percent) * (n + m)) / F.lit(100 + percent) - F.lit(1e-9))


def _possible(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Sizes and positions leave enough overlap, if this is the first element shared."""
    sizes = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    return sizes & (F.least(n - pos, m - at) >= _needed(n, m, percent))


def _early(n: Column, pos: Column, percent: int) -> Column:
    """The element stands early enough for the set to be the smaller one of a pair."""
    return n - pos >= _needed(n, n, percent)


def _close(n: Column, sig: Column, m: Column, other: Column, percent: int) -> Column:
    """The signatures leave enough overlap possible."""
    apart = sum((F.bit_count(sig[i].bitwiseXOR(other[i])) for i in range(1, SIGNATURE)), F.bit_count(sig[0].bitwiseXOR(other[0])))
    return (n + m - apart) * (100 + percent) >= (n + m) * (2 * percent)


SLOT_BITS = 24


def _id_slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << SLOT_BITS))


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.spark, self.percent, self.width = docs.sparkSession, percent, width
        self.docs, self.scratch = docs, Scratch(docs.sparkSession)

    def asked(self, classes: DataFrame) -> np.ndarray:
        """Bit map over hashed ids of the classes' first documents (2 MB whatever the input)."""
        place = _id_slot("rep") + 1  # bucket b of the bitmap functions holds the values from 32768 (b - 1) + 1 on
        words = classes.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
        keep = np.zeros(1 << SLOT_BITS, dtype=bool)
        for row in words.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():
            at = (row["b"] - 1) * 32768
            keep[at : at + 32768] = np.unpackbits(np.frombuffer(row["m"], dtype=np.uint8), bitorder="little").astype(bool)
        return keep

    def verify(self, pairs: DataFrame, classes: DataFrame, levels, name: str) -> DataFrame:
        """Links (a, b) among candidate pairs: signatures, second and third order, then the whole sets."""
        left = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        right = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        near = pairs.join(left, "a").join(right, "b").where(_close(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), self.percent))
        pairs = self.scratch.save(near.select("a", "b"), f"near-{name}")
        involved = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes, "c").select("c", "rep")
        bits = self.spark.sparkContext.broadcast(self.asked(involved))
        texts = self.docs.select("text", _id_slot("doc_id").alias("slot"))
        sets = self.scratch.save(texts.mapInArrow(_whole_sets(self.width, self.percent, levels, bits), "c long, items array<long>, second array<int>, third array<int>"), f"sets-{name}")
        # prefixes of the other orders first; whole sets move only for pairs that meet in all orders
        first = lambda c: sets.select(F.col("c").alias(c), F.struct("second", "third").alias(f"p{c}"))
        meet = pairs.join(first("a"), "a").join(first("b"), "b").where(F.arrays_overlap("pa.second", "pb.second") & F.arrays_overlap("pa.third", "pb.third"))
        whole = lambda c: sets.select(F.col("c").alias(c), F.col("items").alias(f"x{c}"))
        joined = meet.select("a", "b").join(whole("a"), "a").join(whole("b"), "b")
        na, nb, both = F.size("xa"), F.size("xb"), F.size(F.array_intersect("xa", "xb"))
        links = joined.where(both * 100 >= (na + nb - both) * self.percent)
        out = self.scratch.save(links.select("a", "b").distinct(), f"links-{name}")
        self.scratch.drop(f"sets-{name}")
        bits.unpersist()
        return out


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, label): smallest node of each component, by alternating large and small stars.

    Minima are aggregated before they are shuffled, so a node with very many edges needs no one task.
    """
    current = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        step += 1
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(small_least.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        row = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        current = after
        if tuple(row) == state or row[0] == 0:
            return current.select(F.col("u").alias("c"), F.col("v").alias("label"))
        state = tuple(row)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) and class_key of every document."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    job = _Join(slim, width, percent)
    scratch = job.scratch
    found = scratch.save(slim.mapInArrow(_describe(width), "doc_id long, n long, c long, sig array<long>, h long, seen int, hits int"), "described")
    rows = found.where("h is null").select("doc_id", "n", "c")
    classes = scratch.save(found.where("h is null").where("c is not null").groupBy("c").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sig").alias("sig")), "classes")
    levels = spark.sparkContext.broadcast(_levels(found.where("h is not null")))

    tokens = slim.select("text").mapInArrow(_prefixes(width, percent, levels, crowd), "token long, c long, n int, pos int, buckets int, bucket int")
    # sets of like size side by side, and of these the ones with the shingle early on first: they are likeliest to be similar
    tokens = tokens.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int"))
    group = Window.partitionBy("token", "bucket").orderBy("s", "pos", "c")
    alike = Window.partitionBy("token", "bucket", "s").orderBy("pos", "c").rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct("c", "n", "pos")
    crowded = F.col("buckets") > 1
    tokens = tokens.select("token", "c", "n", "pos", "s", "buckets", F.lag(row).over(group).alias("one"), F.lead("c").over(group).alias("after"), F.first(row).over(alike).alias("pivot"), F.coalesce(F.lag("c", 2).over(group), F.lead("c", 2).over(group)).alias("third"))
    tokens = tokens.where(F.col("one").isNotNull() | F.col("after").isNotNull() | crowded)
    three = F.col("third").isNotNull() | (F.col("one").isNotNull() & F.col("after").isNotNull()) | crowded
    shared = scratch.save(tokens.withColumn("three", three).drop("after", "third"), "shared")

    others = F.explode(F.array_distinct(F.array("pivot", "one")))
    pairs = shared.where("one is not null").select("c", "n", "pos", others.alias("o")).where(F.col("o.c") != F.col("c"))
    pairs = pairs.where(_possible(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent))
    # two partners for each set: the one it meets most often, and one with a shared shingle early on
    met = pairs.groupBy("c", "o.c").agg(F.count(F.lit(1)).alias("k"), F.min("o.pos").alias("at")).toDF("c", "oc", "k", "at")
    met = met.groupBy("c").agg(F.max_by("oc", F.struct("k", "oc")).alias("x"), F.min_by("oc", F.struct("at", "oc")).alias("y"))
    pairs = met.select("c", F.explode(F.array_distinct(F.array("x", "y"))).alias("o"))
    # the pivots of a crowd's buckets with each other
    heads = Window.partitionBy("token").orderBy("s", "pos", "c")
    leader = Window.partitionBy("token", "s").orderBy("pos", "c").rowsBetween(Window.unboundedPreceding, 0)
    tops = shared.where(crowded & (F.col("pivot.c") == F.col("c"))).select("c", "n", "pos", F.array(F.lag(row).over(heads), F.first(row).over(leader)).alias("o"))
    tops = tops.select("c", "n", "pos", F.explode(F.array_distinct("o")).alias("o"))
    tops = tops.where(F.col("o").isNotNull() & (F.col("o.c") != F.col("c"))).where(_possible(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent))
    pairs = pairs.union(tops.select("c", "o.c"))
    pairs = scratch.save(pairs.select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).distinct(), "pairs-1")
    links = job.verify(pairs, classes, levels, "1")
    stars = connected(links, scratch, "stars-1")

    # a group of two is one pair, which is at hand
    one = F.col("one")
    twos = shared.where(~F.col("three") & one.isNotNull()).where((one["c"] != F.col("c")) & _possible(F.col("n"), F.col("pos"), one["n"], one["pos"], percent))
    twos = twos.select(F.least("c", one["c"]).alias("a"), F.greatest("c", one["c"]).alias("b"))
    labelled = shared.where("three").select("token", "c", "n", "pos", "s").join(stars, "c", "left").withColumn("label", F.coalesce("label", "c"))
    kinds = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = kinds.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main")).where("labels > 1")
    labelled = labelled.join(mixed.select("token", "main"), "token").join(classes.select("c", "sig"), "c")
    labelled = scratch.save(labelled, "mixed")
    # the smaller set of a pair, with the bands that the larger one may be in; one of both is outside the main component
    bands = F.explode(F.sequence(F.col("s"), F.col("s") + math.ceil(math.log(100 / percent) / math.log(BAND))))
    side = lambda k: [F.col(x).alias(f"{x}{k}") for x in ("c", "n", "pos", "label", "sig")]
    small = labelled.where(_early(F.col("n"), F.col("pos"), percent)).select("token", bands.alias("s"), (F.col("label") != F.col("main")).alias("out"), *side(1))
    large = labelled.select("token", "s", "main", *side(2))
    on = (small["token"] == large["token"]) & (small["s"] == large["s"]) & (F.col("label1") != F.col("label2")) & (F.col("out") | (F.col("label2") != F.col("main")))
    on = on & (((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("c1") < F.col("c2"))))) & _possible(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), percent)
    on = on & _close(F.col("n1"), F.col("sig1"), F.col("n2"), F.col("sig2"), percent)
    more = small.join(large, on).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).union(twos).distinct()
    more = scratch.save(more.join(pairs, ["a", "b"], "left_anti"), "pairs-2")
    extra = job.verify(more, classes, levels, "2")
    stars = connected(stars.toDF("a", "b").union(extra), scratch, "stars-2")

    labels = classes.join(stars, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = labels.join(least, "label").select("c", "component_id")
    for name in ("shared", "mixed", "pairs-1", "pairs-2"):
        scratch.drop(name)
    return rows.join(by_class, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("c").alias("class_key"))


def oracle(table: str = "documents", width: int = WIDTH, percent: int = PERCENT) -> str:
    """DuckDB SQL for doc_id, n_shingles and component_id of tables whose ids are distinct: every shared shingle, then all that links reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {table}),
s as (select distinct doc_id, case when len(w) < {width} then array_to_string(w, ' ') else array_to_string(w[i:i + {width - 1}], ' ') end as sh
    from (select doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1)::int + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= {percent} * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as d, doc_id as m from w union select e.y, r.m from r join e on e.x = r.d)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(m) from r where r.d = w.doc_id) as component_id from w left join n on n.doc_id = w.doc_id
"""

"""An inverted index as tables, and ranked search of parsed queries in it.

The index of a table is built once for a session and the files it was read from: postings, document frequencies and the mean
length of every field, written below the shared folder. A document's postings are counted in its row and lie in one row, so they are not shuffled.
Queries are parsed once each. The postings of their words and of their phrases are dealt into blocks of documents, which the queries stream through;
in a block, sums and matches are vectors over its documents, and only what is wanted of them leaves it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlake.functions.querysyntax import parse
from searchlake.functions.text import words_of
from searchlake.operators.vectors import bound
from searchlake.sources.folders import fresh_folder

K1, B = 1.2, 0.75
DEPTH = 50
_PARSED = """query_id long, everything boolean, plain boolean,
    leaves array<struct<field:string,words:array<string>,boost:double,scored:boolean>>, steps array<struct<kind:string,a:int,b:int,c:int>>"""

_STEPS = "array<struct<kind:string,a:int,b:int,c:int>>"
_WORDS = 4_000_000  # as many as the documents of a block have together
_FOUND = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Index:
    docs: DataFrame  # doc_id and the text of every field
    postings: DataFrame  # field, term, doc_id, dl, tf
    terms: DataFrame  # field, term, df, cf
    lists: DataFrame  # field, doc_id, dl, counts: the postings of a document in a row
    fields: tuple[str, ...]
    count: int
    means: dict[str, float]  # mean length of a field in words
    folder: str = ""


_KEPT: dict[tuple, Index] = {}


def stamp(df: DataFrame) -> tuple:
    """What the files of a table are: changes when one is added, replaced or removed."""
    m = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    row = df.select(F.xxhash64(*m).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return tuple(map(str, row))


def index_of(spark: SparkSession, source: DataFrame, docs: DataFrame, fields: tuple[str, ...], name: str) -> Index:
    """The index of ``docs``, which are made of the files of ``source`` in the way that ``name`` stands for; kept for the session."""
    key = (spark.sparkContext.applicationId, name, *stamp(source))
    if key not in _KEPT or not all(exists(spark, f"{_KEPT[key].folder}/{part}/_SUCCESS") for part in ("docs", "postings", "terms")):
        _KEPT[key] = build(docs, fields)
    return _KEPT[key]


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def build(docs: DataFrame, fields: tuple[str, ...]) -> Index:
    """Writes postings, frequencies and texts. A null text counts as an empty one; the rows of one id as one document each."""
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "index")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    docs = written(docs.select("doc_id", *(F.coalesce(f, F.lit("")).alias(f) for f in fields)), "docs")
    words = [docs.select("doc_id", F.lit(f).alias("field"), F.explode(F.array(words_of(F.col(f)))).alias("w")) for f in fields]  # a generator's only row, so a text is cut once
    rows = words[0]
    for more in words[1:]:
        rows = rows.unionByName(more)
    rows = rows.where(F.size("w") > 0)
    ids = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    twice = ids.where("n > 1").select("id")
    if twice.limit(1).count():  # rows of one id and length count together
        same = F.col("doc_id").eqNullSafe(F.col("id"))
        many = rows.join(twice, same, "left_semi").select("field", "doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("field", "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        lists = _listed(rows.join(twice, same, "left_anti")).unionByName(many.groupBy("field", "doc_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("counts")))
    else:
        lists = _listed(rows)
    lists = written(lists, "postings")
    postings = lists.select("field", "doc_id", "dl", F.inline("counts")).select("field", "term", "doc_id", "dl", "tf")
    terms = written(postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "terms")
    count = docs.count()
    lengths = {r["field"]: r["n"] for r in terms.groupBy("field").agg(F.sum("cf").alias("n")).collect()}  # one number a field
    return Index(docs, postings, terms, lists, fields, count, {f: (lengths.get(f, 0) / count if count else 0.0) or 1.0 for f in fields}, folder)


def _listed(rows: DataFrame) -> DataFrame:
    """(field, doc_id, dl, counts) of (field, doc_id, w): a text's words are sorted and runs of equal ones counted in its row, so no word is shuffled."""

    def runs(s: Column, at: Column) -> Column:
        return F.transform(at, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("long").alias("tf")))

    def counts(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return bound(starts, lambda at: runs(s, at))

    return rows.select("field", "doc_id", F.size("w").alias("dl"), bound(F.sort_array("w"), counts).alias("counts"))


def parse_queries(queries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every query's leaves and steps, see :mod:`searchlake.functions.querysyntax`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(t, fields) for t in batch["text"]]
            yield pd.DataFrame({
                "query_id": batch["query_id"], "everything": [p.everything for p in found], "plain": [p.plain for p in found],
                "leaves": [[{"field": x.field, "words": list(x.words), "boost": x.boost, "scored": x.scored} for x in p.leaves] for p in found],
                "steps": [[dict(zip(("kind", "a", "b", "c"), s)) for s in p.steps] for p in found],
            })

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "text").mapInPandas(run, _PARSED)


def _part(index: Index) -> Column:
    """What a word that a field holds ``tf`` times among its ``dl`` counts, before its rarity."""
    mean = F.lit(index.means[index.fields[0]])
    for f in index.fields[1:]:
        mean = F.when(F.col("field") == f, F.lit(index.means[f])).otherwise(mean)
    tf = F.col("tf").cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / mean))


def idf_of(index: Index) -> Column:
    return F.log(1 + (F.lit(float(index.count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def query_words(parsed: DataFrame, index: Index) -> DataFrame:
    """(query_id, plain, leaf, words, boost, scored, term, field, idf): every word of every leaf in the fields that hold it."""
    leaves = parsed.select("query_id", "plain", F.posexplode("leaves").alias("leaf", "l")).select("query_id", "plain", "leaf", F.col("l.field").alias("only"), "l.words", "l.boost", "l.scored")
    words = leaves.withColumn("term", F.explode(F.array_distinct("words")))
    found = words.join(index.terms, "term").where(F.col("only").isNull() | (F.col("only") == F.col("field")))
    return found.withColumn("idf", idf_of(index)).drop("only", "df", "cf")


def _phrases(words: DataFrame, index: Index) -> DataFrame:
    """(field, key, doc_id, dl, tf) of the phrases among ``words``: runs of as many words of a text meet them in an equi-join."""
    asked = words.where(F.size("words") > 1).select("field", F.size("words").alias("n"), F.array_join("words", " ").alias("term")).distinct()
    out = None
    for n in sorted(r["n"] for r in asked.select("n").distinct().collect()):  # one number a length
        mine = asked.where(F.col("n") == n).select("field", "term")
        for f in index.fields:
            w = index.docs.select("doc_id", F.explode(F.array(words_of(F.col(f)))).alias("w")).where(F.size("w") >= n)
            runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))  # noqa: B023
            rows = w.select(F.lit(f).alias("field"), "doc_id", F.size("w").alias("dl"), F.explode(runs).alias("term")).join(mine, ["field", "term"], "left_semi")
            out = rows if out is None else out.unionByName(rows)
    return None if out is None else out.groupBy("field", "term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _fit(steps: list[dict], leaves: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` documents fit a query's steps, and their scores; what has no part in the match counts nothing."""
    none, stack = (np.zeros(n, dtype=bool), np.zeros(n)), []
    for x in steps:
        if x["kind"] == "leaf":
            stack.append(leaves.get(x["a"], none))
            continue
        size = x["a"] + x["b"] + x["c"]
        parts = stack[len(stack) - size :]
        del stack[len(stack) - size :]
        musts, shoulds, nots = parts[: x["a"]], parts[x["a"] : x["a"] + x["b"]], parts[x["a"] + x["b"] :]
        fit = np.ones(n, dtype=bool) if musts else np.zeros(n, dtype=bool)
        for hit, _ in shoulds if not musts else ():
            fit |= hit
        for hit, _ in musts:
            fit &= hit
        for hit, _ in nots:
            fit &= ~hit
        stack.append((fit, np.where(fit, sum((score for _, score in musts + shoulds), np.zeros(n)), 0.0)))
    return stack[-1]


def _arranged(held: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, dict[str, slice]]:
    """A block's documents, and its postings sorted by key and document: the document and the part of each, and where a key's are."""
    ids = pc.dictionary_encode(held.column("doc_id").combine_chunks(), null_encoding="encode")
    keys = held.column("key").combine_chunks().dictionary_encode()
    n = len(ids.dictionary)
    both, at = np.unique(keys.indices.to_numpy().astype(np.int64) * n + ids.indices.to_numpy(), return_inverse=True)
    part, at = np.bincount(at, held.column("part").to_numpy(), len(both)), both % n
    ends = np.searchsorted(both, np.arange(len(keys.dictionary) + 1, dtype=np.int64) * n)
    return ids.dictionary, at, part, {k: slice(ends[i], ends[i + 1]) for i, k in enumerate(keys.dictionary.to_pylist())}


def _search_block(top: int | None, least: float | None, queries: int):
    def answer(q: dict, docs: np.ndarray, at: np.ndarray, part: np.ndarray, where: dict[str, slice]) -> tuple[np.ndarray, np.ndarray]:
        n, leaves = len(docs), {}
        for key, weight, leaf in zip(q["keys"], q["weights"], q.get("leaves") or repeat(0)):
            s = where.get(key)
            if s is not None:
                if leaf not in leaves:
                    leaves[leaf] = np.zeros(n, dtype=bool), np.zeros(n)
                hit, score = leaves[leaf]
                hit[at[s]] = True
                score[at[s]] += float(weight) * part[s]
        if not leaves:
            return np.empty(0, dtype=np.int64), np.empty(0)
        hit, score = _fit(q["steps"], leaves, n) if q.get("steps") else leaves[0]
        keep = np.flatnonzero(hit)
        score = np.floor(score[keep] * 1e6 + 0.5) / 1e6
        if least is not None:
            keep, score = keep[score >= least], score[score >= least]
        if top is not None and len(keep) > top:
            kth = np.partition(score, len(keep) - top)[len(keep) - top]
            keep, score = keep[score >= kth], score[score >= kth]
            best = np.lexsort((docs[keep], -score))[:top]
            keep, score = keep[best], score[best]
        return keep, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:  # postings come before queries
            asked = batch.column("asked")
            mine = asked.null_count
            if mine:
                held.append(batch.slice(0, mine).select(["doc_id", "key", "part"]))
            if mine == len(asked) or (block is None and not held):
                continue
            if block is None:
                ids, *block = _arranged(pa.Table.from_batches(held))
                docs, held = pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False), []
            for first in range(mine, len(asked), queries):
                some = [json.loads(q) for q in asked[first : first + queries].to_pylist()]
                found = [answer(q, docs, *block) for q in some]
                who = np.repeat(np.array([q["query_id"] for q in some], dtype=np.int64), [len(keep) for keep, _ in found])
                keep, score = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(who), ids.take(pa.array(keep)), pa.array(score)], schema=_FOUND)

    return run


def met(asked: DataFrame, held: DataFrame, count: int, top: int | None = None, least: float | None = None, docs: int = 4096, queries: int = 64) -> DataFrame:
    """(query_id, doc_id, score): all queries meet blocks of about ``docs`` of the ``count`` documents, ``queries`` at a time.

    ``asked`` is (query_id, plain, units, steps), where a unit has a leaf, a key and a weight; ``held`` is (doc_id, key, part). A document's score is the sum of weight times
    part of what it shares with the query. ``top`` keeps the best of each block, among which a query's best are; ``least`` scores from there on. Only the postings
    of the queries' words are shuffled, each once; queries follow them in the stream of every block, so a task holds one block and a batch of queries.
    """
    cores = held.sparkSession.sparkContext.defaultParallelism
    many = max(1, -(-count // docs), min(2 * cores, -(-count // 1024)))  # a small table has work for all cores
    held = held.join(asked.select(F.explode("units").alias("u")).select("u.key").distinct(), "key", "left_semi")
    left = held.select(F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int").alias("b"), F.col("doc_id").cast("long").alias("doc_id"), "key", "part")
    # a query is one string, since postings pass with few flat columns only; plain ones have one leaf and no steps
    some = lambda c: F.when(~F.col("plain"), c)
    text = F.to_json(F.struct("query_id", F.col("units.key").alias("keys"), F.col("units.weight").alias("weights"), some(F.col("units.leaf")).alias("leaves"), some(F.col("steps")).alias("steps")))
    right = asked.select(text.alias("asked")).select(F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("b"), "asked")
    both = left.unionByName(right, allowMissingColumns=True).repartition(2 * many, "b").sortWithinPartitions("b", F.col("asked").isNotNull())
    return both.groupBy("b").applyInArrow(_search_block(top, least, queries), "query_id long, doc_id long, score double")


def _docs(index: Index, fields: list[str]) -> int:
    """How many documents of a block hold about ``_WORDS`` words in these fields."""
    return int(min(max(_WORDS // max(sum(index.means[f] for f in fields), 1.0), 1024), 32768))


def shared(topics: DataFrame, index: Index, least: int) -> DataFrame:
    """(query_id, doc_id, score): how many of a query's distinct (query_id, term) a document has, from ``least`` on."""
    unit = F.struct(F.lit(0).alias("leaf"), F.col("term").alias("key"), F.lit(1.0).alias("weight"))
    asked = topics.groupBy("query_id").agg(F.lit(True).alias("plain"), F.collect_list(unit).alias("units")).withColumn("steps", F.array().cast(_STEPS))
    asked = kept(asked, "topics")
    return met(asked, index.postings.select("doc_id", F.col("term").alias("key"), F.lit(1.0).alias("part")), index.count, least=least, docs=_docs(index, index.fields))


def kept(df: DataFrame, name: str) -> DataFrame:
    """A small table, written, so that what reads it knows its size."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scores(queries: DataFrame, index: Index, depth: int = DEPTH, top: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all documents that fit, or of the ``top`` best of each block of them; for a query that stands for all, the ``depth`` smallest ids, each with 1."""
    parsed = kept(parse_queries(queries, index.fields), "queries")
    kinds = parsed.agg(F.count_if("everything").alias("all"), F.count_if(~F.col("everything") & ~F.col("plain")).alias("some")).first()
    words = query_words(parsed, index)
    key = lambda term: F.concat_ws(":", "field", term)
    weight = F.when(F.col("scored"), F.col("idf") * F.col("boost")).otherwise(0.0)
    units = words.where(F.size("words") == 1).select("query_id", F.struct("leaf", key("term").alias("key"), weight.alias("weight")).alias("u"))
    fields = [r["field"] for r in words.select("field").distinct().collect()]  # as many as the index has
    held = index.postings.where(F.col("field").isin(fields)).select("doc_id", key("term").alias("key"), _part(index).alias("part"))
    phrases = _phrases(words, index) if kinds["some"] else None
    if phrases is not None:
        whole = words.where(F.size("words") > 1).groupBy("query_id", "leaf", "field", "words", "boost", "scored").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("idf"))
        whole = whole.where(F.col("n") == F.size(F.array_distinct("words")))
        units = units.unionByName(whole.select("query_id", F.struct("leaf", key(F.array_join("words", " ")).alias("key"), weight.alias("weight")).alias("u")))
        held = held.unionByName(phrases.select("doc_id", key("term").alias("key"), _part(index).alias("part")))
    asked = kept(units.groupBy("query_id").agg(F.collect_list("u").alias("units")).join(parsed.select("query_id", "plain", "steps").dropDuplicates(["query_id"]), "query_id"), "units")
    out = met(asked, held, index.count, top, docs=_docs(index, fields))
    if kinds["all"]:
        first = [r[0] for r in index.docs.select("doc_id").orderBy("doc_id").limit(depth).collect()]  # as many as a list takes
        out = out.unionByName(parsed.where("everything").select("query_id", F.explode(F.array(*map(F.lit, first)).cast("array<bigint>")).alias("doc_id"), F.lit(1.0).alias("score")))
    return out


def ranked(queries: DataFrame, index: Index, depth: int = DEPTH) -> DataFrame:
    """The ``depth`` best of every query with their ranks; ties go to smaller ids."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores(queries, index, depth, depth).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)

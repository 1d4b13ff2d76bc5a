"""Corpus pipeline: language ID, quality, near-duplicate removal, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of documents. :func:`run` writes what a stage returns as Parquet in the shared
folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.llm import jaccard, language, mixing, packing, quality
from searchlake.llm.common import Scratch, partitions
from searchlake.session import spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives no language (``und``) go; all stay if there is nothing to learn from.

    Low scores are kept: they come from very short texts and from texts in two languages.
    """
    model = language.fit(docs)
    return docs if model is None else language.predict(docs, model, carry=True).where("lang_pred <> 'und'").select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as low quality go; all stay if there is nothing to learn from."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs if net is None else quality.score_documents(docs, net, carry=True).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays.

    Rows that share that id but not the text all stay; so does one row of each text among those without an id,
    which the join's result cannot name.
    """
    kept = jaccard.join_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule."""
    return mixing.mix(docs, carry=True).orderBy("position").select("row.*")


def in_schedule_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in the order of the Pfair schedule: even ranges of positions, sorted inside.

    A written table is read back in any order of its files, so the positions are computed from the rows again.
    """
    total, parts = docs.count(), partitions(docs.sparkSession)
    placed = mixing.mix(docs.select("doc_id", "source", "text"), carry=True).select("position", "row.doc_id", "row.text")
    part = F.floor(F.col("position") * parts / max(total, 1)).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions("position").select("doc_id", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids; sequences are filled in the order of the schedule."""
    return packing.pack(in_schedule_order(docs))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The stages train models and pack ids, which SQL can't express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of the whole corpus."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs

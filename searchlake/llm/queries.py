"""The queries of the operators: opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.llm import ann, drift, fim, fingerprint, jaccard, language, license_scan, mixing, packing, quality, repair, repetition, url_rules
from searchlake.session import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, labels and score; ``n_places`` counts the places of the fuzzy search."""
    return license_scan.scan_licenses(_docs(spark, sf_dir)).withColumn("n_places", F.size("places")).drop("places")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return fingerprint.fingerprint_documents(_docs(spark, sf_dir))


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, as read back from the grammar-compressed files."""
    files = repair.write_tokens(_docs(spark, sf_dir))
    return repair.read_tokens(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component of similar documents."""
    return jaccard.join_components(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and position in the mixture."""
    return mixing.mix(_docs(spark, sf_dir))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, base rule and verdict."""
    return url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found for every fiftieth vector, and how many vectors were verified for it."""
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in its document and in its sequence."""
    return packing.pack(_docs(spark, sf_dir)).drop("ids")


def op9_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, by a network trained on the folds that are not held out."""
    docs = _docs(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the folds that are not held out."""
    docs = _docs(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cut over code points, with digests of the output and of the text rebuilt from it."""
    made = fim.restore(fim.transform(_docs(spark, sf_dir)))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, the characters that it repeats, and whether it is kept."""
    return repetition.judge(_docs(spark, sf_dir))


def op13_drift_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every final file of the clients, as read back from the new folder."""
    return drift.rewrite_drifted(spark.read.parquet(f"{sf_dir}/clients.parquet"))


_ALL = (
    op1_license_scan, op2_imatch, op3_repair_tokens, op4_ngram_join, op5_pfair_mix, op6_url_rules, op7_collision_counting, op8_packing, op9_byte_quality, op10_kernel_language,
    op11_fill_in_middle, op12_repetition, op13_drift_rewrite,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op4_ngram_join": jaccard.oracle(), "op5_pfair_mix": mixing.oracle(), "op6_url_rules": url_rules.oracle(), "op11_fill_in_middle": fim.oracle(), "op12_repetition": repetition.oracle(),
}

"""From raw documents to a training mix: quality, near-duplicates, repeated passages, benchmark leaks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import decontamination, mixing, near_dedup, passages, site_quality
from quarrystone.llm.queries import table
from quarrystone.llm.shared import removed, scratch, written  # noqa: F401


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the doc_ids of ``ids``; rows with a null doc_id stay."""
    d, gone = docs.alias("d"), ids.select("doc_id").distinct().alias("gone")
    return d.join(gone, F.col("d.doc_id") == F.col("gone.doc_id"), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier rejects go; host is the source, path the language."""
    judged = site_quality.classify(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where(~F.col("kept")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays, once.

    Rows that share a doc_id are one document: of them the one with the smallest
    text stays, of equal texts the one with the smallest hash of the other columns.
    """
    seen = near_dedup.near_duplicates(docs).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("times"))
    d, k = docs.alias("d"), seen.where("stays").alias("k")
    named = d.join(k, F.col("d.doc_id") == F.col("k.doc_id")).select(F.struct("d.*").alias("row"), F.col("k.times").alias("times"))
    once = named.where("times = 1").select("row")
    order = F.struct(F.col("row.text"), F.xxhash64(F.to_json("row")))
    again = named.where("times > 1").groupBy("row.doc_id").agg(F.min_by("row", order).alias("row")).select("row")
    nameless = docs.where(F.col("doc_id").isNull())
    return once.unionByName(again).select("row.*").unionByName(nameless)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; n_chars follows the text."""
    cut = passages.remove_repeated_passages(docs)
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs, in its own words or re-parameterised, go."""
    return _without(docs, decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
]

#: SQL cannot express the classifier or the cut passages; tests/llm holds near-dedup, passages and sizes against
#: brute force, and the other two stages against their operators, which have such tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's rows are written as Parquet and read again by the next.

    What a stage writes for itself is removed when its rows are written, and these when the next stage's are.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.split()[0].lower())
        if last is not None:
            removed(spark, last)
        last = keep.path
    return docs

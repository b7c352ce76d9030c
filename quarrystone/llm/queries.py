"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_pairs, collocations, licences, mixing, periodic_runs, perspectives
from .decontamination import contamination
from .lang_id import held_out_languages
from .near_dedup import near_duplicates
from .passages import digests as passage_digests
from .quality_lm import quality
from .site_quality import classify
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(table(spark, sf_dir, "documents"))


def op2_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.digest(perspectives.rotate(table(spark, sf_dir, "conversations")))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_hits(table(spark, sf_dir, "documents"))


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.wound(table(spark, sf_dir, "documents"))))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_perplexity_bands": op2_perplexity_bands,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op4_site_quality": op4_site_quality,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_weighted_fair_mix": op7_weighted_fair_mix,
    "op8_licence_dice": op8_licence_dice,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_pairs": op13_byte_pairs,
}
ORACLE_SQL: dict[str, str] = {
    "op3_perspective_rotation": perspectives.ORACLE_SQL,
    "op8_licence_dice": licences.oracle_sql(),
    "op7_weighted_fair_mix": mixing.ORACLE_SQL.format(docs="documents"),
    "op11_phrase_collocations": collocations.ORACLE_SQL,
}

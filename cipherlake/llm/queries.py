"""Queries of the training-data operators: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm.common import table
from cipherlake.llm.decontaminate import find_contamination
from cipherlake.llm.imatch import imatch_fingerprints
from cipherlake.llm.language import identify_languages, text_model
from cipherlake.llm.licenses import scan_licenses
from cipherlake.llm.merkle import manifest
from cipherlake.llm.minhash import near_duplicates
from cipherlake.llm.mixing import mix_sources
from cipherlake.llm.simhash import simhash_duplicates
from cipherlake.llm.spelling import spelling_variants
from cipherlake.llm.token_counts import count_tokens
from cipherlake.llm.token_shards import write_and_read
from cipherlake.llm.toxicity import score_toxicity
from cipherlake.llm.warc import archive_round_trip


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=49407)


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_fingerprints(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, k=5, rows=4, bands=9)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id; their source takes the place of a host) and pages (page_id) in one table."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    null = F.lit(None).cast("string")
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("source://"), "source").alias("url"), null.alias("html"), "text")
    rows = rows.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "url", "html", null.alias("text")))
    return identify_languages(rows, text_model(docs))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"), radius=4, k=4)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_token_id_output": op2_token_id_output,
        "op3_source_mixing": op3_source_mixing,
        "op4_token_counts": op4_token_counts,
        "op5_warc_index_merge": op5_warc_index_merge,
        "op6_imatch_fingerprints": op6_imatch_fingerprints,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_language_id": op9_language_id,
        "op10_license_scan": op10_license_scan,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_simhash_near_dedup": op12_simhash_near_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }

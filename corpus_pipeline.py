"""Corpus pipeline: documents to token ids, stage by stage; each stage is written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) with docs (doc_id, text, lang, source, n_chars); all but the last
return the same columns. In every stage null and empty texts, null ids, repeated rows and empty tables
have the result that its operator's docstring gives: only the mix and what a stage looks for drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cipherlake.llm.common import discard, staged, table
from cipherlake.llm.decontaminate import decontaminate
from cipherlake.llm.minhash import without_near_duplicates
from cipherlake.llm.mixing import mixed
from cipherlake.llm.queries import vocabulary
from cipherlake.llm.token_shards import write_and_read
from cipherlake.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5 by a machine trained on `labels`; empty texts stay, equal texts stay or go together."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at similarity 0.8; texts without words and rows without an id stay."""
    return without_near_duplicates(docs, percent=80, k=5, rows=3, bands=9)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no item of `benchmark`; rows are judged by their own text, with or without an id."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; each repeated row by its own count, texts without words never."""
    return mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id shards with a keyed index, read back: doc_id, start, n_tokens, ids_crc32, a row for each row of docs."""
    return write_and_read(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_documents),
    ("mixing", mix),
    ("token_output", write_token_ids),
]

#: SQL can't express the machine, the latent search or the files; tests/llm/test_brute_force.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table; a stage's table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
            if i:
                discard(before)
    return docs

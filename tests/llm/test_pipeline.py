"""The corpus pipeline, and the near-duplicate query against its SQL, on the smallest tables."""

import duckdb

import __spark_entry__
import corpus_pipeline
from cipherlake.llm.oracles import OP8

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= n
            n = docs.count()
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert out.count() == docs.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_near_duplicates_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {(r[0], r[1], r[2], r[3]) for r in db.execute(OP8).fetchall()}
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in __spark_entry__.queries()["op8_minhash_near_dedup"](spark, SF).collect()}
    assert got == want

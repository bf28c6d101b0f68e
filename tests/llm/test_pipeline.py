"""The pipeline's stages keep the columns of documents, act on what came before, and end in ids that decode."""

import hashlib

import corpus_pipeline
from ledgerloom.llm import toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).withColumnRenamed("n_chars", "score").cache()
    columns, before = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.dtypes == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_stages_empty(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(toxicity, "fit", lambda *a: None)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0

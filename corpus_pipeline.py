"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir), and the next one reads what it wrote.

toxicity       documents scored 0.3 or more go
exact_dedup    of equal texts one document stays
near_dedup     of each near-duplicate group (five words, similarity 0.8) one document stays
decontaminate  documents that hold a benchmark item go
byte_bpe       ids of each text left, and the digest of the bytes they decode to
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, exact_dedup, minhash, toxicity
from ledgerloom.llm.common import cut, fresh

#: SQL can't state the network, so there is none for run()'s rows; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = docs
    if "score" in {c.lower() for c in docs.columns}:
        named = docs.withColumnRenamed("score", fresh(docs, "score"))
    scored = toxicity.scores(named, model, named.columns)
    return scored.where(F.col("score") < 0.3).drop("score").toDF(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.keep(docs)


def drop_near_copies(spark, docs, sf_dir):
    return minhash.keep(docs, width=5, percent=80)


def drop_leaks(spark, docs, sf_dir):
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                      ["doc_id"], ids=True, digests=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_leaks), ("byte_bpe", encode)]


def run(spark, sf_dir):
    """All stages over the documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = cut(docs, name)
    return docs

"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

Frequent digests are found by Misra-Gries counters (`freqItems`, at most 1 / support of them), counted exactly, and the
verified winners, a table of at most 1 / support rows, are broadcast: rows of frequent texts are settled where they are
read. All other digests go through an ordinary shuffle, in which no group exceeds that share of the rows.

Texts are equal when identical after deleting ASCII white space (space, tab to carriage return). Null counts as empty.
Of equal texts the one with most code points stays, then the smallest doc_id (null last). Rows that repeat a doc_id and
its text are one document: `decisions` gives each of them the same verdict, `keep` returns one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import NO_ID, cut, fresh

#: Share of the rows from which a digest counts as frequent; 1 / SUPPORT bounds what is broadcast.
SUPPORT = 1e-3
WHITE = " \t\n\u000b\f\r"


def normalised(text):
    """The text without ASCII white space."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, digest of the normalised text, code points of the text, and the rank for staying (larger wins)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.sha2(normalised(body), 256).alias("digest"),
                       rank(body, F.col(id)).alias("rank"))


def rank(body, id):
    return F.struct(F.char_length(body).cast("long").alias("chars"), id.isNotNull().alias("named"),
                    (-F.coalesce(id.cast("long"), F.lit(NO_ID + 1))).alias("back"))


def frequent(marks: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests that Misra-Gries counters leave, with their true counts and winners: at most 1 / support rows."""
    found = marks.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return marks.join(F.broadcast(found), "digest").groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max("rank").alias("best"))


def keep_id(best):
    return F.when(best["named"], -best["back"])


def decisions(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    marks = cut(digests(docs), "digests")
    hot = cut(frequent(marks, support), "frequent")
    settled = marks.join(F.broadcast(hot), "digest")
    cold = marks.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    cold = cold.withColumns({"group_size": F.count("*").over(group), "best": F.max("rank").over(group)})
    return settled.unionByName(cold).select(
        "doc_id", keep_id(F.col("best")).alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents with one row of every group of equal texts, all columns as they were.

    Losers of frequent texts go before the shuffle; what is left is grouped with partial aggregates, so that a row
    repeated without end is combined where it is read.
    """
    d, r, row, best = (fresh(docs, x) for x in ("digest_", "rank_", "row_", "best_"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = cut(digests(docs), "digests")
    hot = cut(frequent(marks, support), "frequent").select(F.col("digest").alias(d), F.col("best").alias(best))
    full = docs.withColumns({d: F.sha2(normalised(body), 256), r: rank(body, F.col("doc_id"))})
    left = full.join(F.broadcast(hot), d, "left").where(F.col(best).isNull() | (F.col(r) == F.col(best)))
    whole = F.struct(*[F.col(c) for c in docs.columns])
    return left.groupBy(d).agg(F.max_by(whole, F.col(r)).alias(row)).select(f"{row}.*")

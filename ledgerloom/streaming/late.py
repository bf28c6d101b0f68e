"""Late rows: caught against a stored high mark, written to a side table, and counted back into their windows.

A micro-batch is judged by the highest time stamp of the batches before it, as a watermark is. The mark is a one-row table
per batch, so a batch that is run again after a failure reads the same mark and splits its rows the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.streaming.feed import forget, live_rate

#: Batches whose running mark one task takes; above them marks run over blocks of batches.
BLOCK = 4096


def folder(path: str, table: str, epoch: int) -> str:
    return f"{path}/{table}/epoch={epoch}"


def is_late(ts: str, mark: Column, delay: str) -> Column:
    """Behind the mark by more than the delay. Rows without a time stamp fit no window and count as late at once."""
    return F.col(ts).isNull() | F.coalesce(F.col(ts) < mark - F.expr(f"interval {delay}"), F.lit(False))


def write_split(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", delay: str = "10 minutes", trigger: dict | None = None):
    """Append arriving rows to `path`/on_time or `path`/late, nothing dropped; one folder per batch, rewritten by a retry.

    A mark is kept for the batch before the current one only, so the folder of marks does not grow.
    """
    def split(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(folder(path, "mark", epoch - 1)).first().mark if epoch else None
        mark = F.lit(known).cast("timestamp")
        batch.persist()
        try:
            top = batch.agg(F.max(ts).alias("mark")).select(F.greatest("mark", mark).alias("mark"))
            judged = batch.withColumn("_late", is_late(ts, mark, delay))
            judged.where("not _late").drop("_late").write.mode("overwrite").parquet(folder(path, "on_time", epoch))
            judged.where("_late").drop("_late").write.mode("overwrite").parquet(folder(path, "late", epoch))
            top.write.mode("overwrite").parquet(folder(path, "mark", epoch))
        finally:
            batch.unpersist()
        if epoch > 1:
            forget(spark, folder(path, "mark", epoch - 2))

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def split_batches(rows: DataFrame, epoch: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The batch twin: rows with the number of the micro-batch they came in get a `late` flag.

    Marks are one row per batch, run within blocks of batches and then over blocks; rows only meet their batch's mark.
    """
    tops = rows.groupBy(epoch).agg(F.max(ts).alias("_top")).withColumn("_b", F.floor(F.col(epoch) / BLOCK))
    inside = Window.partitionBy("_b").orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    blocks = tops.groupBy("_b").agg(F.max("_top").alias("_t"))
    before = blocks.select("_b", F.max("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_m"))
    marks = tops.withColumn("_in", F.max("_top").over(inside)).join(before, "_b").select(
        F.col(epoch).alias("_e"), F.greatest("_in", "_m").alias("_mark"))
    joined = rows.join(marks, F.col(epoch).eqNullSafe(F.col("_e")), "left")
    return joined.withColumn("late", is_late(ts, F.col("_mark"), delay)).drop("_e", "_mark")


def settled_rate(on_time: DataFrame, late: DataFrame, window: str = "1 hour") -> DataFrame:
    """`live_rate` with late rows counted back into their windows, and how many of a window's runs came late."""
    both = on_time.withColumn("_late", F.lit(0)).unionByName(late.withColumn("_late", F.lit(1)))
    counted = both.where(~F.col("quarantined") & ~F.col("floor_guard")).groupBy(F.window("ts", window).alias("w")).agg(
        F.sum("_late").alias("late_runs")).select(F.col("w.start").alias("start"), "late_runs")
    return live_rate(both.drop("_late"), window).join(counted, "start")


def read_split(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The on_time or late rows of all batches so far."""
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.select(*columns) if columns else rows.drop("epoch")

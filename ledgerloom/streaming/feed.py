"""Event feed, delta assembly, bounded history and live provenance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import hygiene as P
from ledgerloom.operators import provenance as V

TOKEN = "token"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def event_feed(events: DataFrame, keys: Sequence[str] = ("run_id", "ts", "type", "stage", "mode"), delay: str = "10 minutes") -> DataFrame:
    """Events once each within the watermark; token events are exempt and pass unchanged.

    Works on streams and, with full de-duplication, on batches.
    """
    tokens = events.where(F.col("type") == TOKEN)
    other = events.where(F.coalesce(F.col("type") != TOKEN, F.lit(True)))
    if events.isStreaming:
        other = other.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    else:
        other = other.dropDuplicates(list(keys))
    return other.unionByName(tokens)


def assemble_deltas(events: DataFrame, keys: Sequence[str] = ("run_id", "mode", "phase")) -> DataFrame:
    """Token deltas of finished texts joined in sequence order. One group is one generated text."""
    t = events.where(F.col("type") == TOKEN)
    g = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("_d"))
    return g.select(*keys, F.array_join(F.transform("_d", lambda e: e["delta"]), "").alias("text"), F.size("_d").alias("deltas"))


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that no retry can ask for any more; a missing one is fine."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def newest_history(runs: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """The newest n runs: a top-n, taken per task before anything is merged."""
    return runs.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def keep_history(stream: DataFrame, path: str, order: Sequence[str], checkpoint: str, n: int = 50, trigger: dict | None = None):
    """Maintain the newest n runs as a table: each batch is merged with the stored rows.

    Every batch writes its own folder (a retried batch rewrites the same one), and readers take the highest. The folder
    before the one a retry would read is removed.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        both = batch
        if epoch > 0:
            both = batch.unionByName(spark.read.parquet(f"{path}/epoch={epoch - 1}"))
        newest_history(both, order, n).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if epoch > 1:
            forget(spark, f"{path}/epoch={epoch - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def route_live(runs: DataFrame, lex, require: str | None = None, forbid: str | None = None, floor: int = 500) -> DataFrame:
    """Audit and path assertion of arriving runs in one stateless pass: a `quarantined` flag tells the sinks apart."""
    asserted = P.assert_path(runs, 1, require, forbid)
    return V.audit(asserted, lex, floor)


def live_rate(routed: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Invention rate per event-time window over clean runs above the floor."""
    r = routed.withWatermark("ts", delay) if routed.isStreaming else routed
    return r.where(~F.col("quarantined") & ~F.col("floor_guard")).groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("n_invented") > 0).alias("inventing")).select(
        F.col("w.start").alias("start"), "runs", "inventing", (F.col("inventing") / F.col("runs")).alias("rate"))


def write_routed(routed: DataFrame, audited_path: str, quarantine_path: str, checkpoint: str, trigger: dict | None = None):
    """Append clean and quarantined runs to their tables, one folder per batch so a retry rewrites itself."""
    def split(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            batch.where("not quarantined").write.mode("overwrite").parquet(f"{audited_path}/epoch={epoch}")
            batch.where("quarantined").write.mode("overwrite").parquet(f"{quarantine_path}/epoch={epoch}")
        finally:
            batch.unpersist()

    return routed.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None,
                  transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drain what is available into an in-memory table; for tests and small replays."""
    out = transform(stream) if transform else stream
    w = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return out.sparkSession.table(name)

"""Committed sinks: envelopes per (case, mode), run summaries and report payloads.

A version is staged in a folder of its own, described by a manifest, and seen by readers once the manifest has been
renamed into place; a repeated or interrupted commit changes nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.ledger import newest

STAGED, COMMITS = "staged", "commits"


def _fs(spark: SparkSession, path: str):
    """(file context, path factory) of the file system that holds the path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return root.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, path: str, version: str) -> dict | None:
    """What a version holds, or None where it was never committed."""
    fs, at = _fs(spark, path)
    file = at(f"{path}/{COMMITS}/{version}.json")
    if not fs.exists(file):
        return None
    return json.loads(spark.read.text(file.toString(), wholetext=True).first().value)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions in text order; number them with leading zeros so that the last one is the newest."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/{COMMITS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))


def commit(df: DataFrame, path: str, version: str, partition: Sequence[str] = (), fmt: str = "parquet", **options: str) -> dict:
    """Write the rows as one version, with the writer's options (such as compression), and return its manifest.

    A version that is committed already is returned as it stands and nothing is written. Rows are counted as they are
    written. Two writers of one version stage apart; the first rename wins and the other takes the winner's manifest.
    """
    spark = df.sparkSession
    done = manifest(spark, path, version)
    if done is not None:
        return done
    folder = f"{STAGED}/{version}-{uuid.uuid4().hex}"
    seen = Observation(f"commit-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partition).format(fmt).options(**options).save(f"{path}/{folder}")
    fs, at = _fs(spark, path)
    body = {"version": version, "folder": folder, "rows": seen.get["rows"], "format": fmt, "partition": list(partition),
            "bytes": fs.getContentSummary(at(f"{path}/{folder}")).getLength(), "schema": json.loads(df.schema.json())}
    fs.mkdirs(at(f"{path}/{COMMITS}"))
    draft, final = at(f"{path}/{folder}.manifest"), at(f"{path}/{COMMITS}/{version}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(body).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        won = manifest(spark, path, version)
        if won is None:
            raise OSError(f"could not commit {version} under {path}")
        return won
    return body


def read_committed(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A committed version, the newest one unless named; staged and abandoned folders are never read."""
    if version is None:
        known = versions(spark, path)
        if not known:
            raise FileNotFoundError(f"nothing is committed under {path}")
        version = known[-1]
    m = manifest(spark, path, version)
    if m is None:
        raise FileNotFoundError(f"{version} is not committed under {path}")
    schema = T.StructType.fromJson(m["schema"])
    return spark.read.schema(schema).format(m["format"]).load(f"{path}/{m['folder']}").select(*schema.names)


def orphans(spark: SparkSession, path: str) -> list[str]:
    """Staged folders that no manifest names: left by writers that died or lost a race, or still being written."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/{STAGED}")):
        return []
    named = {manifest(spark, path, v)["folder"] for v in versions(spark, path)}
    staged = [f"{STAGED}/{s.getPath().getName()}" for s in fs.listStatus(at(f"{path}/{STAGED}")) if s.isDirectory()]
    return sorted(s for s in staged if s not in named)


def envelopes(runs: DataFrame, case: str, mode: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The newest run per (case, mode) as one row: case, mode, the file name it goes by and its JSON body.

    Ties in `order` go to the larger payload, so a retry keeps the same run. Null fields stay in the body as nulls.
    """
    picked = runs.select(F.col(case).alias("case_id"), F.col(mode).alias("mode"), F.struct(*order).alias("_o"),
                         F.to_json(F.struct(F.col(case).alias("case_id"), F.col(mode).alias("mode"), *payload),
                                   {"ignoreNullFields": "false"}).alias("body"))
    top = newest(picked, ["case_id", "mode"], "_o", "body").drop("_o")
    return top.withColumn("file", F.format_string("%s__%s.json", F.col("case_id").cast("string"), F.col("mode")))


SUMMARY_FIELDS = ("modes_requested", "modes_completed", "modes_refused", "modes_failed")


def run_summary(attempts: DataFrame, run: str = "run_id", mode: str = "mode", status: str = "status", reason: str = "reason",
                cost: str = "cost", ts: str = "ts", cap: Column | None = None) -> DataFrame:
    """One row per run: modes requested and completed in text order, refused and failed ones with their reasons,
    what was spent under which cap, and the last time stamp.

    attempts  one row per attempt; the newest of a (run, mode) decides its status, every attempt is paid for.
    Grouped by (run, mode) first, so what is collected per run is its modes and not its attempts.
    """
    key = F.struct(F.col(ts), F.col(status), F.col(reason))
    last = attempts.groupBy(run, mode).agg(F.max(key).alias("_k"), F.sum(cost).alias("_c"), F.max(ts).alias("_t"))
    entry = F.struct(F.col(mode).alias("mode"), F.col(f"_k.{status}").alias("status"), F.col(f"_k.{reason}").alias("reason"))
    g = last.groupBy(run).agg(F.sort_array(F.collect_list(entry)).alias("_m"), F.sum("_c").alias("spent"), F.max("_t").alias("timestamp"))
    named = F.filter("_m", lambda e: e["mode"].isNotNull())

    def of(kind):
        return F.filter(named, lambda e: e["status"] == kind)

    def reasons(kind):
        return F.map_from_entries(F.transform(of(kind), lambda e: F.struct(e["mode"], F.coalesce(e["reason"], F.lit("")))))

    return g.select(
        run, F.transform(named, lambda e: e["mode"]).alias("modes_requested"),
        F.transform(of("completed"), lambda e: e["mode"]).alias("modes_completed"),
        reasons("refused").alias("modes_refused"), reasons("failed").alias("modes_failed"),
        (cap if cap is not None else F.lit(None).cast("decimal(18,8)")).alias("cap"), "spent", "timestamp")


def report_payload(summaries: DataFrame, runs: DataFrame, run: str = "run_id", mode: str = "mode", text: str = "output",
                   latency: str = "latency_ms", excerpt: int = 180) -> DataFrame:
    """One JSON document per run: its summary and, per mode, characters, latency and an excerpt of the output.

    Texts are cut to excerpts before they are joined, and one row per (run, mode) is taken, the longest text first.
    Runs without outputs keep an empty list, outputs without a summary are left out.
    """
    side = runs.select(run, mode, F.struct(
        F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.col(latency).alias("latency_ms"),
        F.translate(F.substring(F.coalesce(F.col(text), F.lit("")), 1, excerpt), "\n|", " /").alias("excerpt")).alias("_s"))
    per = side.groupBy(run, mode).agg(F.max("_s").alias("_s")).groupBy(run).agg(
        F.sort_array(F.collect_list(F.struct(F.col(mode).alias("mode"), "_s.*"))).alias("outputs"))
    j = summaries.join(per, run, "left")
    none = F.array().cast(per.schema["outputs"].dataType)
    return j.select(run, F.to_json(F.struct(*summaries.columns, F.coalesce("outputs", none).alias("outputs"))).alias("payload"))

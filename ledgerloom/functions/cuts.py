"""Written intermediate tables: lineage ends there, and lost executors lose nothing of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session uses its warehouse folder; a cluster must
    name one, since its machines share no other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """The table, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

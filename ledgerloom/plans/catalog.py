"""Where queries register themselves, and the driver's tables as engine tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import provenance as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the bound tables, with its oracle where SQL can state it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


SMALL_BYTES = 64 << 20


class Tables:
    """The driver's parquet tables and the engine tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str, *keys: str) -> DataFrame:
        """A text table, spread by key where the session asks for it (`ledgerloom.spread`, off unless set).

        One small file is one scan task; `local_session` sets it for that. On a cluster the scan's own splits stay.
        """
        tasks = int(self.spark.conf.get("ledgerloom.spread", "0"))
        return self.read(name).repartition(tasks, *keys) if tasks else self.read(name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.spread("documents", "doc_id")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.spread("conversations", "conv_id", "turn")

    @cached_property
    def dealt(self) -> DataFrame:
        """Runs dealt from documents: even sentences are the output, odd ones go to three seats in turn."""
        ss = self.documents.select("doc_id", "source", "lang", X.sentences("text").alias("ss"))

        def deal(step, at):
            return F.array_join(F.filter("ss", lambda _, i: i % step == at), " ")

        return ss.select(
            F.col("doc_id").alias("run_id"), F.col("source").alias("condition"), F.col("lang").alias("writer_id"),
            (F.col("doc_id") % 50).alias("prompt_id"), deal(2, 0).alias("output"),
            deal(6, 1).alias("alpha"), deal(6, 3).alias("beta"), deal(6, 5).alias("gamma"))

    @cached_property
    def runs(self) -> DataFrame:
        return self.dealt.select(
            "run_id", "condition", "writer_id", "prompt_id", "output",
            F.array("alpha", "beta", "gamma").alias("upstream"))

    @cached_property
    def seats(self) -> DataFrame:
        """One row per run and seat with text."""
        each = F.explode(F.array(*[
            F.struct(F.lit(s).alias("seat"), F.col(s).alias("text")) for s in ("alpha", "beta", "gamma")]))
        return self.dealt.select("run_id", "condition", "prompt_id", each.alias("e")).select(
            "run_id", "condition", "prompt_id", "e.*").where("text <> ''")

    def audited(self, lex: str = "prose", floor: int = 500) -> DataFrame:
        return V.audit(self.runs, lex, floor)

    @cached_property
    def sentences(self) -> DataFrame:
        """One row per document sentence: doc_id, pos, s."""
        return X.explode_rows(self.documents, ["doc_id", "source", "lang"], X.sentences("text"), "pos", "s")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column, so results compare across engines."""
    return df.select(*[
        F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def masks_named(df: DataFrame, lex, **cols: str) -> DataFrame:
    """Replace mask columns by comma-joined family names: new=old."""
    for new, old in cols.items():
        df = df.withColumn(new, F.array_join(X.mask_names(old, lex), ","))
    return df.drop(*[o for o in cols.values() if o not in cols])

"""Run ledgers and logs: envelopes, field maps, framework shapes, label caches, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import text as X
from ledgerloom.functions.prefix import below, sortable

AS_SHIPPED, PRE_INTERVENTION = "as_shipped", "pre_intervention"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One JSON envelope per file; unreadable files come back with _corrupt_record set and nothing else."""
    raw = spark.read.schema(schemas.ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def runs_of(envelopes: DataFrame, variant: str = PRE_INTERVENTION, modes: Sequence[str] | None = None,
            sources: Sequence[str] | None = None, require_upstream: bool = True) -> DataFrame:
    """Envelopes to run records.

    Corrupt, quarantined and zero-route runs are left out; the output is the pre-intervention draft where
    one is stored (or the text as shipped), without its trailing note.
    """
    e = envelopes.where(F.col("_corrupt_record").isNull()) if "_corrupt_record" in envelopes.columns else envelopes
    if modes:
        e = e.where(F.col("mode").isin(*modes))
    if sources:
        e = e.where(F.col("source").isin(*sources))
    e = e.where(~F.coalesce("execution_path.quarantined", F.lit(False)))
    planned = F.col("deliberation.plan.routes")
    e = e.where(planned.isNull() | (F.size(planned) > 0))
    parts = F.filter(F.transform("deliberation.turns", lambda t: F.coalesce(t["output_text"], F.lit(""))),
                     lambda t: X.strip(t) != "")
    e = e.withColumn("upstream", F.coalesce(parts, F.array().cast("array<string>")))
    if require_upstream:
        e = e.where(F.size("upstream") > 0)
    blank = F.lit("")
    final = F.coalesce("final_output", blank)
    out = F.coalesce(F.nullif("pre_gate_output", blank), final) if variant == PRE_INTERVENTION else final
    none = F.array().cast("array<string>")
    own = F.when(F.size(planned) > 0, planned)
    return e.select(
        "run_id", F.coalesce("case_id", blank).alias("prompt_id"), "upstream", X.strip_note(out).alias("output"),
        F.coalesce(F.get("deliberation.synthesis.input_messages", F.lit(0))["content"], blank).alias("writer_prompt"),
        F.coalesce(own, F.col("execution_path.routes"), none).alias("routes"), F.coalesce("mode", blank).alias("condition"),
        F.coalesce("model", blank).alias("writer_id"),
        F.create_map(F.lit("source"), F.col("source"), F.lit("captured_at"), F.col("captured_at")).alias("meta"))


def read_ledger(spark: SparkSession, path: str, **kw) -> DataFrame:
    return runs_of(read_envelopes(spark, path), **kw)


@dataclass
class FieldMap:
    """Dotted paths (list parts by index, negatives from the end) or column functions, per record field."""

    upstream: str | Callable[[DataFrame], Column]
    output: str | Callable[[DataFrame], Column]
    run_id: str | Callable | None = None
    prompt_id: str | Callable | None = None
    writer_prompt: str | Callable | None = None
    routes: str | Callable | None = None
    condition: str | Callable | None = None
    writer_id: str | Callable | None = None


def resolve(df: DataFrame, spec) -> Column:
    """A dotted path as a column; array indexes out of range give null."""
    if callable(spec):
        return spec(df)
    head, *rest = spec.split(".")
    out = F.col(head)
    for part in rest:
        if part.lstrip("-").isdigit():
            i = int(part)
            out = F.try_element_at(out, F.lit(i + 1 if i >= 0 else i))
        else:
            out = out[part]
    return out


def apply_fields(df: DataFrame, fields: FieldMap) -> DataFrame:
    """Rows of any shape to run records; a missing run id becomes a hash of the row, never a row number."""
    def get(name):
        spec = getattr(fields, name)
        return resolve(df, spec) if spec is not None else F.lit(None).cast("string")

    def of_type(col):
        return df.select(col.alias("c")).schema["c"].dataType.typeName()

    up = get("upstream")
    up = F.array(up) if of_type(up) == "string" else up
    routes = get("routes")
    routes = routes.cast("array<string>") if of_type(routes) == "array" else F.lit(None).cast("array<string>")
    blank, none = F.lit(""), F.array().cast("array<string>")
    surrogate = F.sha2(F.to_json(F.struct("*")), 256)
    return df.select(
        F.coalesce(F.nullif(get("run_id").cast("string"), blank), surrogate).alias("run_id"),
        F.coalesce(get("prompt_id").cast("string"), blank).alias("prompt_id"),
        F.coalesce(F.filter(up.cast("array<string>"), lambda t: F.coalesce(t, blank) != ""), none).alias("upstream"),
        F.coalesce(get("output").cast("string"), blank).alias("output"),
        F.coalesce(get("writer_prompt").cast("string"), blank).alias("writer_prompt"),
        F.coalesce(routes, none).alias("routes"), F.coalesce(get("condition").cast("string"), blank).alias("condition"),
        F.coalesce(get("writer_id").cast("string"), blank).alias("writer_id"))


def read_run_log(spark: SparkSession, path: str, fields: FieldMap, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return apply_fields(reader.json(path), fields)


def from_callable(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any frame-to-frame function as an adapter."""
    return df.transform(fn)


def _named(prefix: str, parts: Column) -> Column:
    return F.transform(parts, lambda _, i: F.concat(F.lit(prefix), i.cast("string")))


def _present(parts: Column) -> Column:
    return F.filter(parts, lambda t: F.coalesce(t, F.lit("")) != "")


def adapt_layers(df: DataFrame, layers: str = "layers", final: str = "final") -> DataFrame:
    """Mixture of agents: only the last proposer layer reached the aggregator."""
    last = F.coalesce(F.try_element_at(layers, F.lit(-1)), F.array().cast("array<string>"))
    return df.withColumns({"upstream": _present(last), "output": F.col(final), "condition": F.lit("moa"),
                           "routes": _named("proposer_", last)}).drop(layers, final)


def adapt_state(df: DataFrame, state: str = "state", upstream_key: str = "specialist_outputs", output_key: str = "final",
                prompt_id_key: str = "task_id") -> DataFrame:
    """State-dict graphs: upstream list and final string read from the terminal state."""
    up = F.coalesce(F.col(state)[upstream_key], F.array().cast("array<string>"))
    return df.withColumns({
        "prompt_id": F.coalesce(F.col(state)[prompt_id_key].cast("string"), F.lit("")), "upstream": _present(up),
        "output": F.coalesce(F.col(state)[output_key], F.lit("")), "condition": F.lit("graph"),
        "routes": _named("node_", up)}).drop(state)


def adapt_rag(df: DataFrame, chunks: str = "chunks", answer: str = "answer") -> DataFrame:
    """Retrieval: the chunks are the upstream."""
    return df.withColumns({"upstream": _present(F.col(chunks)), "output": F.col(answer), "condition": F.lit("rag"),
                           "routes": _named("chunk_", F.col(chunks))}).drop(chunks, answer)


def adapt_chat(messages: DataFrame, writer: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Group chats to run parts: the writer's last message is the output, others' earlier ones the upstream.

    One row per part and never a collected chat. The last writer turn is one grouped maximum; the join
    back splits hot chats through adaptive skew handling.
    """
    last = messages.where(F.col("role") == writer).groupBy(conv).agg(F.max(turn).alias("_last"))
    j = messages.join(last, conv)
    is_out = (F.col("role") == writer) & (F.col(turn) == F.col("_last"))
    keep = is_out | ((F.col("role") != writer) & (F.col(turn) < F.col("_last")) & (F.col("text") != ""))
    return j.where(keep).select(F.col(conv).alias("run_id"), F.col(turn).alias("pos"), is_out.alias("is_output"),
                                F.col("role").alias("route"), "text")


def unwrap_envelope(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): a bench wrapper is unwrapped to its audit log, a raw log is taken as it is.

    df  plan, turns, final_output, and a nested deliberation of the same fields (nullable)
    """
    nested = F.col("deliberation").isNotNull() & (
        F.col("deliberation.plan").isNotNull() | F.col("deliberation.turns").isNotNull())
    flat = df.select(*[c for c in df.columns if c not in ("plan", "turns", "final_output", "deliberation")],
                     *[F.when(nested, F.col(f"deliberation.{c}")).otherwise(F.col(c)).alias(c)
                       for c in ("plan", "turns", "final_output")], nested.alias("wrapped"))
    return flat.where("final_output is not null"), flat.where("final_output is null")


def turns(runs: DataFrame, keep: Sequence[str], turns_col: str = "turns") -> DataFrame:
    """One row per run and seat: the seat's first turn."""
    rows = X.explode_rows(runs, list(keep), F.col(turns_col), "pos", "t")
    return rows.groupBy(*keep, "t.seat").agg(F.min_by("t", "pos").alias("t"), F.min("pos").alias("pos")).select(
        *keep, "seat", "pos", F.col("t.output_text").alias("text"))


def global_offsets(units: DataFrame, order: str, count: Column) -> DataFrame:
    """Running offset of each unit in the ordered concatenation of all units, by a tree of totals.

    Only ids and counts go through the tree; the offsets meet the units again by their id. Of units that share an id the one
    with fewer elements comes first.

    order  a whole or other number that tells the units apart; units without it have no place and are left out
    """
    whole = dict(units.dtypes)[order] in ("tinyint", "smallint", "int", "bigint")
    counted = units.where(F.col(order).isNotNull()).withColumn("_n", F.coalesce(count, F.lit(0)).cast("bigint"))
    slim = counted.select(F.col(order).alias("_unit"), "_n")
    placed = below(slim, [], F.col("_unit").cast("bigint") if whole else sortable("_unit"), ["_n"], ["_unit", "_n"])
    places = placed.groupBy("_unit").agg(F.sort_array(F.collect_list(F.struct("_n", F.col("_n_below").alias("at")))).alias("_at"))
    joined = counted.join(places, F.col(order) == F.col("_unit"))
    nth = F.row_number().over(Window.partitionBy("_unit").orderBy("_n"))
    return joined.withColumn("_nth", nth).select(*units.columns, F.get("_at", F.col("_nth") - 1)["at"].alias("offset"))


def labels_long(units: DataFrame, cache: DataFrame, order: str = "unit_id", batch: int = 10) -> DataFrame:
    """Label cache (judge, offset, position -> family -> boolean) to (unit, sentence, judge, family, value).

    units  unit id and sentences array      cache  judge, start, labels map<string,map<string,boolean>>
    """
    sized = X.held(units.select(order, "sentences"), "_size", F.size("sentences")).select(order, "_size")
    placed = global_offsets(sized, order, F.col("_size"))
    each = F.when(F.col("_size") > 0, F.sequence(F.lit(0), F.col("_size") - 1))
    sents = placed.select(order, "offset", F.explode_outer(each).alias("sent_idx")).where(F.col("sent_idx").isNotNull()).select(
        order, "sent_idx", (F.col("offset") + F.col("sent_idx")).alias("_g"))
    flat = cache.select("judge", "start", F.explode_outer("labels").alias("at", "m")).where(F.col("m").isNotNull())
    flat = flat.select("judge", (F.col("start") + F.col("at").cast("bigint") - 1).alias("_g"),
                       F.explode_outer("m").alias("family", "value")).where(F.col("family").isNotNull())
    return sents.join(flat, "_g").select(order, "sent_idx", "judge", "family", "value")


def newest(runs: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """Newest run per key by one struct maximum; only one row per key is ever held."""
    cols = [c for c in runs.columns if c not in by]
    best = runs.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*by, "_r.*")


def bake_cases(runs: DataFrame, case: str, mode: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per case with a map mode -> payload of its newest run (as many entries as modes exist)."""
    top = newest(runs, [case, mode], *order)
    return top.groupBy(case).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col(mode), F.to_json(F.struct(*payload)))))).alias("runs"))


def read_items(spark: SparkSession, path: str, schema, field: str = "items") -> DataFrame:
    """A dimension file with one array of items."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(field))


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def write_runs(runs: DataFrame, path: str, partition: str = "condition", fmt: str = "parquet") -> None:
    runs.write.mode("overwrite").partitionBy(partition).format(fmt).save(path)

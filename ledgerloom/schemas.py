"""Declared schemas of the tables the operators read."""

from __future__ import annotations

from pyspark.sql import types as T

STR = T.StringType()
STRS = T.ArrayType(STR)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RUNS = _struct(
    run_id=STR, prompt_id=STR, upstream=STRS, output=STR, writer_prompt=STR, routes=STRS,
    condition=STR, writer_id=STR, meta=T.MapType(STR, STR),
)

MESSAGE = _struct(role=STR, content=STR)

TURN = _struct(
    seat=STR, member_name=STR, ollama_tag=STR, input_messages=T.ArrayType(MESSAGE), output_text=STR,
    latency_ms=T.LongType(), eval_count=T.LongType(), prompt_eval_count=T.LongType(), backend=STR,
)

PLAN = _struct(
    routes=STRS, sub_questions=T.MapType(STR, STR), requires_recency_disclosure=T.BooleanType(),
    recency_notes=STR,
)

DELIBERATION = _struct(
    query=STR, started_at=STR, finished_at=STR, plan=PLAN, plan_raw=STR, plan_latency_ms=T.LongType(),
    turns=T.ArrayType(TURN), synthesis=TURN, final_output=STR, cabinet_name=STR,
    cabinet_backends=T.MapType(STR, STR),
)

EXECUTION_PATH = _struct(
    routes=STRS, quarantined=T.BooleanType(), reason=STR, synthesis_prompt=STR,
    preserve_applied=T.BooleanType(),
)

# One run envelope per JSON file; both schema versions, the nested parts nullable.
ENVELOPE = T.StructType(
    _struct(
        schema_version=T.LongType(), imported=T.BooleanType(), source=STR, captured_at=STR, case_id=STR,
        case_title=STR, mode=STR, model=STR, final_output=STR, notes=STR, pre_gate_output=STR,
        protocol_violation=T.BooleanType(), execution_path=EXECUTION_PATH, deliberation=DELIBERATION,
    ).fields
    + [T.StructField("_corrupt_record", STR)]
)

RUN_EVENTS = _struct(
    run_id=STR, ts=T.TimestampType(), type=STR, mode=STR, stage=STR, detail=STR, phase=STR, delta=STR,
    seq=T.LongType(),
)

CALLS = _struct(
    ledger_id=STR, ts=T.TimestampType(), seq=T.LongType(), input_tokens=T.LongType(),
    cached_input_tokens=T.LongType(), output_tokens=T.LongType(), cost=T.DecimalType(18, 8),
)

"""Construction guards of items and arms, and integrity of run files: violation rows, none of them meaning a pass.

A guard is a column of messages (array<string>) over an item's row; `violations` turns any number of them into rows. Guards
over several rows (`differ_beyond_form`) give the same rows from one grouped pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

NONE = "array<string>"


def _when(condition: Column, message: Column) -> Column:
    """One message where the condition holds; null conditions hold nothing against the item."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(message)).otherwise(F.array().cast(NONE))


def _label(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name} '"), value, F.lit("'"))


def probe_in_text(probes, texts: Sequence, where: str, name: str = "probe", rule: str = "space", fold: bool = True) -> Column:
    """Probes that occur in any of the texts, which would score a restatement as an answer.

    Probes and texts meet after normalisation by `rule`, case-folded unless told otherwise. The texts are joined by a
    character no probe holds, so nothing matches across two of them. Null and blank probes are no probes.
    """
    def canon(t):
        n = X.norm(t, rule)
        return F.lower(n) if fold else n

    body = F.concat_ws("\x00", *[canon(F.coalesce(X.as_col(t), F.lit(""))) for t in texts])
    asked = F.filter(X.as_col(probes), lambda p: F.coalesce(X.strip(p) != "", F.lit(False)))
    found = X.let(body, lambda b: F.filter(asked, lambda p: F.contains(b, canon(p))))
    return F.coalesce(F.transform(found, lambda p: F.concat(_label(name, p), F.lit(f" occurs in {where}"))), F.array().cast(NONE))


def length_ratio(a, b, low: float = 0.85, high: float = 1.15, name: str = "length ratio") -> Column:
    """The two texts' lengths differ by more than the band; an empty second text counts as one character long."""
    r = F.length(F.coalesce(X.as_col(a), F.lit(""))) / F.greatest(F.length(F.coalesce(X.as_col(b), F.lit(""))), F.lit(1))
    return _when(~r.between(low, high), F.concat(F.lit(f"{name} "), F.format_string("%.2f", r), F.lit(f" outside {low:g} to {high:g}")))


def must_differ(a, b, name: str) -> Column:
    """Two fields hold the same value, two nulls included."""
    return _when(X.as_col(a).eqNullSafe(X.as_col(b)), F.lit(name))


def must_agree(a, b, name: str) -> Column:
    return _when(~X.as_col(a).eqNullSafe(X.as_col(b)), F.lit(name))


def words_in_text(text, words: Sequence[str], name: str = "domain word", where: str = "the task") -> Column:
    """Reserved words that occur in a text, case-folded, as substrings; the list is a parameter and part of the plan."""
    asked = F.array(*[F.lit(w) for w in sorted({w.lower() for w in words if w})]).cast(NONE)
    found = X.let(F.lower(F.coalesce(X.as_col(text), F.lit(""))), lambda low: F.filter(asked, lambda w: F.contains(low, w)))
    return F.transform(found, lambda w: F.concat(_label(name, w), F.lit(f" in {where}")))


def violations(items: DataFrame, keep: Sequence[str], *guards: Column) -> DataFrame:
    """One row per item and message, in the guards' order; items that pass all of them have none."""
    every = F.concat(*[F.coalesce(g, F.array().cast(NONE)) for g in guards]) if guards else F.array().cast(NONE)
    # the outer form keeps the messages from being computed a second time by a filter on their number
    return items.select(*keep, F.explode_outer(every).alias("violation")).where("violation is not null")


def differ_beyond_form(arms: DataFrame, cell: Sequence[str], arm: str, prompt: str = "prompt", form: str = "form") -> DataFrame:
    """Cells whose arms' prompts differ by more than the form each is given, and arms that lack their own form.

    Every prompt is hashed with its form taken out; a cell is sound if all hashes are one. Aggregates carry two hashes a
    cell, so a cell may hold any number of arms. An arm without a form is compared as it stands.
    """
    given = F.coalesce(F.col(form), F.lit(""))
    body = F.coalesce(F.col(prompt), F.lit(""))
    lacking = arms.where((given != "") & ~F.contains(body, given)).select(
        *cell, F.concat(F.lit("arm '"), F.coalesce(F.col(arm).cast("string"), F.lit("")), F.lit("' lacks its own form")).alias("violation"))
    bare = F.sha2(F.when(given != "", F.replace(body, given, F.lit("\x00"))).otherwise(body), 256)
    uneven = arms.groupBy(*cell).agg(F.min(bare).alias("_a"), F.max(bare).alias("_b")).where("_a <> _b").select(
        *cell, F.lit("prompts differ by more than the form").alias("violation"))
    return lacking.unionByName(uneven)


#: Words that mark a batch tag where a model's name should stand.
BATCH_TAG = r"(?i)(^|[-_ ])(seed|experiment|batch|cell\d+)([-_ ]|\d|$)"


def file_violations(envelopes: DataFrame, stem: str = "run_id", case: str = "case_id", mode: str = "mode", model: str = "model",
                    output: str = "final_output", short: int = 50, tag: str = BATCH_TAG) -> DataFrame:
    """What is wrong with run files: unreadable, named against their fields, near-empty output, a batch tag for a model.

    envelopes  as `read_envelopes` gives them, the file's stem (`<case>__<mode>`, with any suffix behind a further `__`)
    in `stem`. An unreadable file has that one message only.
    """
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in envelopes.columns else F.lit(False)
    parts = F.split(F.col(stem), "__")
    named = F.size(parts) > 1

    def off(at, field):
        return named & ~F.get(parts, F.lit(at)).eqNullSafe(F.col(field).cast("string"))

    wrong = {
        "file name is not <case>__<mode>": ~named, "case differs from the file name": off(0, case), "mode differs from the file name": off(1, mode),
        f"output under {short} characters": F.length(F.coalesce(X.strip(output), F.lit(""))) < short,
        "no model": F.coalesce(F.col(model), F.lit("")) == "", "batch tag in the model field": F.col(model).rlike(tag)}
    # one pass over the files, readable or not
    return violations(envelopes, [stem], _when(corrupt, F.lit("unreadable")), *[_when(~corrupt & c, F.lit(m)) for m, c in wrong.items()])


def coverage_gaps(runs: DataFrame, wanted: DataFrame, arm: str, case: str, per_cell: int = 1) -> DataFrame:
    """Cells (arm, case) of the design with fewer runs than asked, cells without any run and null names included.

    wanted  the design's cells; runs are counted before they meet it, and runs outside it are not judged
    """
    w = wanted.select(F.col(arm).alias("_a"), F.col(case).alias("_c")).distinct()
    have = runs.groupBy(arm, case).agg(F.count("*").alias("_n"))
    met = w.join(have, F.col("_a").eqNullSafe(F.col(arm)) & F.col("_c").eqNullSafe(F.col(case)), "left")
    return met.select(F.col("_a").alias(arm), F.col("_c").alias(case), F.coalesce("_n", F.lit(0)).alias("runs")).where(F.col("runs") < per_cell)

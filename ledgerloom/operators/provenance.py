"""What an output kept, dropped and invented relative to its sources.

Family sets travel as bit masks: one bigint per text, exact set algebra with bit operators, and
`bit_or` as a bounded, map-side-combined set union. Names are decoded only at the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.detectors import detector
from ledgerloom.functions import stats as S
from ledgerloom.functions import text as X
from ledgerloom.lexicons import lexicon

MIN_OUTPUT_CHARS = 500


def join_upstream(upstream, joiner: str = "\n\n") -> Column:
    """Non-empty parts joined by a blank line (or by the caller's separator)."""
    return F.array_join(F.filter(X.as_col(upstream), lambda t: t != ""), joiner)


def decompose(df: DataFrame, floor: int = MIN_OUTPUT_CHARS) -> DataFrame:
    """Add the decomposition to rows that carry raised_mask, present_mask and chars.

    Below the length floor nothing counts as kept or invented, everything raised is discarded and
    traceability is 0. With nothing kept or invented traceability is 1.
    """
    short = F.col("chars") < floor
    zero = F.lit(0).cast("bigint")
    return (
        df.withColumn("floor_guard", short)
        .withColumn("kept_mask", F.when(short, zero).otherwise(F.col("raised_mask").bitwiseAND(F.col("present_mask"))))
        .withColumn("discarded_mask", F.when(short, F.col("raised_mask"))
                    .otherwise(X.mask_minus("raised_mask", "present_mask")))
        .withColumn("invented_mask", F.when(short, zero).otherwise(X.mask_minus("present_mask", "raised_mask")))
        .withColumn("supply", F.bit_count("raised_mask"))
        .withColumn("n_kept", F.bit_count("kept_mask"))
        .withColumn("n_invented", F.bit_count("invented_mask"))
        .withColumn("emitted", F.col("n_kept") + F.col("n_invented"))
        .withColumn("traceability", F.when(short, F.lit(0.0)).when(F.col("emitted") == 0, F.lit(1.0))
                    .otherwise(F.col("n_kept") / F.col("emitted")))
        .withColumn("ok", ~short & (F.col("n_invented") == 0))
    )


def audit(runs: DataFrame, lex="epistemic", floor: int = MIN_OUTPUT_CHARS, joiner: str = "\n\n",
          evidence: bool = False) -> DataFrame:
    """Audit runs whose upstream is an array in the row. No shuffle; text columns are dropped.

    lex  a lexicon or any detector; one that joins a table has detections for the parts "upstream" and "output" of each run
         (one shuffle by its key, of masks and lengths and not of texts)
    """
    det = detector(lex)
    keys = [f for f in ("run_id", "prompt_id", "condition", "writer_id") if f in runs.columns]
    extra = [c for c in runs.columns if c not in keys and c not in
             ("upstream", "output", "writer_prompt", "routes", "meta")]
    chars = F.length("output").alias("chars")
    if not det.reads_text and not evidence:
        runs = runs.select(*keys, *extra, chars, F.lit("").alias("output"), F.lit(None).cast("array<string>").alias("upstream"))
        chars = F.col("chars")
    found = det.prepared(runs, ["upstream", "output"]).select(
        *keys, *extra, chars,
        det.mask("upstream", join_upstream("upstream", joiner)).alias("raised_mask"),
        det.mask("output", F.col("output")).alias("present_mask"),
        *(["output"] if evidence else []),
    )
    out = decompose(found, floor)
    if evidence:
        out = out.withColumn("evidence", X.family_matches("output", lex, mask="invented_mask")).drop("output")
    return out


def audit_chat(messages: DataFrame, writer: str = "assistant", lex="epistemic",
               floor: int = MIN_OUTPUT_CHARS) -> DataFrame:
    """Audit group chats without assembling them: output is the writer's last message, upstream every
    other speaker's message before it.

    A chat may hold any number of messages. Detection runs per message; one grouped pass keeps, per
    family, the first turn at which a non-writer raised it, and the writer's last turn with its text.
    A family is raised when its first turn precedes the writer's last: bounded state, one shuffle,
    combined map-side, so a hot chat costs no more than any other.

    messages  conv_id, turn, role, text
    """
    names = list(lexicon(lex))
    is_writer = F.col("role") == writer
    seen = messages.select(
        "conv_id", "turn", is_writer.alias("_w"), detector(lex).mask("text", F.col("text")).alias("_m"),
        F.length("text").alias("_chars"))
    first = [
        F.min(F.when(~F.col("_w") & X.mask_has("_m", i), F.col("turn"))).alias(f"_f{i}") for i in range(len(names))
    ]
    packed = seen.groupBy("conv_id").agg(
        F.max(F.when(F.col("_w"), F.struct("turn", F.col("_m").alias("m"), F.col("_chars").alias("chars")))).alias("_last"),
        *first)
    raised = sum(
        (F.when(F.col(f"_f{i}") < F.col("_last.turn"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
         for i in range(len(names))), F.lit(0).cast("bigint"))
    rows = packed.where(F.col("_last").isNotNull()).select(
        F.col("conv_id").alias("run_id"), F.col("_last.chars").alias("chars"), raised.alias("raised_mask"),
        F.col("_last.m").alias("present_mask"))
    return decompose(rows, floor)


def audit_parts(parts: DataFrame, lex="epistemic", floor: int = MIN_OUTPUT_CHARS,
                keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Audit runs held as one row per part (is_output, text): masks per part, united with bit_or."""
    seen = parts.select(*keys, "is_output", detector(lex).mask("text", F.col("text")).alias("_m"), F.length("text").alias("_c"))
    rows = seen.groupBy(*keys).agg(
        F.coalesce(F.bit_or(F.when(~F.col("is_output"), F.col("_m"))), F.lit(0).cast("bigint")).alias("raised_mask"),
        F.coalesce(F.bit_or(F.when(F.col("is_output"), F.col("_m"))), F.lit(0).cast("bigint")).alias("present_mask"),
        F.coalesce(F.sum(F.when(F.col("is_output"), F.col("_c"))), F.lit(0)).alias("chars"))
    return decompose(rows, floor)


def with_names(audited: DataFrame, lex) -> DataFrame:
    """Decode the masks to sorted family arrays."""
    out = audited
    for part in ("raised", "kept", "discarded", "invented"):
        out = out.withColumn(part, X.mask_names(f"{part}_mask", lex))
    return out


def dose_response(audited: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean kept, invented, emitted and traceability per supply level, over runs above the floor."""
    return audited.where(~F.col("floor_guard")).groupBy(*by, "supply").agg(
        F.count("*").alias("n_runs"), F.avg("n_kept").alias("mean_kept"),
        F.avg("n_invented").alias("mean_invented"), F.avg("emitted").alias("mean_emitted"),
        F.avg("traceability").alias("mean_traceability"))


def family_flags(audited: DataFrame, lex, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, family, raised, present, n): one row per combination, counted before any family fan-out.

    Masks take few distinct values, so runs are grouped by mask pair first and the fan-out over
    families touches the groups only.
    """
    pairs = audited.groupBy(*keys, "raised_mask", "present_mask").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), X.mask_has("raised_mask", i).alias("raised"),
                 X.mask_has("present_mask", i).alias("present")) for i, f in enumerate(lexicon(lex))]))
    return pairs.select(*keys, each.alias("e"), "n").select(*keys, "e.*", "n")


def transmission(audited: DataFrame, lex, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Per family T = P(out | raised), I = P(out | not raised), D = T - I, with intervals."""
    from ledgerloom.operators.bootstrap import draws_of, intervals

    flags = family_flags(audited, lex)
    tot = flags.groupBy("family").agg(
        F.sum(F.when(F.col("raised"), F.col("n")).otherwise(0)).alias("n_raised"),
        F.sum(F.when(F.col("raised") & F.col("present"), F.col("n")).otherwise(0)).alias("k_raised"),
        F.sum(F.when(~F.col("raised"), F.col("n")).otherwise(0)).alias("n_unraised"),
        F.sum(F.when(~F.col("raised") & F.col("present"), F.col("n")).otherwise(0)).alias("k_unraised"))
    units = flags.select(
        "family", F.col("raised").cast("int").alias("r"), F.col("present").cast("int").alias("p"), "n")
    drawn = counted_draws(units, ["family"], ["r", "p"], draws, seed)
    d = (S.ratio("rp", "r") - S.ratio(F.col("p") - F.col("rp"), F.col("n") - F.col("r")))
    ci = intervals(drawn, ["family"], rule="truncate", draws=draws, d=d)
    tlo, thi = S.wilson("k_raised", "n_raised")
    ilo, ihi = S.wilson("k_unraised", "n_unraised")
    t, i = S.ratio("k_raised", "n_raised"), S.ratio("k_unraised", "n_unraised")
    return tot.join(ci, "family", "left").select(
        "family", "n_raised", t.alias("t"), tlo.alias("t_lo"), thi.alias("t_hi"), "n_unraised", i.alias("i"),
        ilo.alias("i_lo"), ihi.alias("i_hi"), (t - i).alias("d"), "d_lo", "d_hi")


def counted_draws(counted: DataFrame, by: Sequence[str], flags: Sequence[str], draws: int, seed: int) -> DataFrame:
    """Draws over pre-counted 0/1 cells (column n), with the product of two flags added."""
    from ledgerloom.operators.bootstrap import draws_of_cells

    cells = counted.groupBy(*by, *flags).agg(F.sum("n").alias("_m"))
    if len(flags) == 2:
        cells = cells.withColumn(flags[0] + flags[1], F.col(flags[0]) * F.col(flags[1]))
        flags = [*flags, flags[0] + flags[1]]
    return draws_of_cells(cells, by, flags, draws, seed)


def zero_supply(audited: DataFrame, by: Sequence[str] = (), min_n: int = 8) -> DataFrame:
    """Rate of runs that emit something although nothing was raised, with status."""
    z = audited.where(~F.col("floor_guard")).groupBy(*by).agg(
        F.count_if(F.col("supply") == 0).alias("n"),
        F.count_if((F.col("supply") == 0) & (F.col("emitted") > 0)).alias("k"))
    lo, hi = S.wilson("k", "n")
    usable = F.col("n") >= min_n
    return z.select(*by, "n", "k", F.when(usable, S.ratio("k", "n")).alias("rate"),
                    F.when(usable, lo).alias("rate_lo"), F.when(usable, hi).alias("rate_hi"),
                    F.when(usable, F.lit("evaluable")).otherwise(F.lit("not evaluable")).alias("status"))


def corroboration(runs: DataFrame, lex, min_n: int = 10, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Does a family raised by several sources survive more often than one raised by a single source?

    Sources are counted inside the row; only (family, min(k, 3), present) counts are shuffled.
    """
    names = list(lexicon(lex))
    masks = runs.select(
        X.families_mask("output", lex).alias("out"),
        F.transform("upstream", lambda t: X.families_mask(t, lex)).alias("src"))
    def sources(i):
        return F.size(F.filter("src", lambda m: X.mask_has(m, i)))

    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), X.mask_has("out", i).cast("int").alias("p"), sources(i).alias("k"))
        for i, f in enumerate(names)]))
    counted = (
        masks.select(each.alias("e")).select("e.*").where("k > 0")
        .groupBy("family", F.least("k", F.lit(3)).alias("k"), "p").agg(F.count("*").alias("n")))
    both = counted.unionByName(counted.withColumn("family", F.lit("composite")))
    def part(cond, val):
        return F.coalesce(F.sum(F.when(cond, val)), F.lit(0))
    k = F.col("k")
    tot = both.groupBy("family").agg(
        part(k == 1, F.col("n")).alias("n_one"), part(k == 1, F.col("n") * F.col("p")).alias("k_one"),
        part(k >= 2, F.col("n")).alias("n_multi"), part(k >= 2, F.col("n") * F.col("p")).alias("k_multi"),
        part(k == 2, F.col("n")).alias("n2"), part(k == 2, F.col("n") * F.col("p")).alias("k2"),
        part(k == 3, F.col("n")).alias("n3"), part(k == 3, F.col("n") * F.col("p")).alias("k3"))
    units = both.select("family", (k >= 2).cast("int").alias("m"), "p", "n")
    drawn = counted_draws(units, ["family"], ["m", "p"], draws, seed)
    diff = S.ratio("mp", "m") - S.ratio(F.col("p") - F.col("mp"), F.col("n") - F.col("m"))
    ci = intervals_of(drawn, diff, draws)
    usable = (F.col("n_one") >= min_n) & (F.col("n_multi") >= min_n)
    t1, tm = S.ratio("k_one", "n_one"), S.ratio("k_multi", "n_multi")
    r2, r3 = S.ratio("k2", "n2"), S.ratio("k3", "n3")
    return tot.join(ci, "family", "left").select(
        "family", "n_one", "n_multi",
        F.when(usable, t1).alias("t_one"), F.when(usable, tm).alias("t_multi"),
        F.when(usable, tm - t1).alias("diff"), F.when(usable, F.col("diff_lo")).alias("diff_lo"),
        F.when(usable, F.col("diff_hi")).alias("diff_hi"),
        F.when(F.col("n_one") * F.col("n2") * F.col("n3") > 0,
               (t1 <= r2 + 0.05) & (r2 <= r3 + 0.05)).alias("monotone"),
        F.when(~usable, F.lit("too thin")).when(F.col("diff_lo") > 0, F.lit("higher when corroborated"))
        .when(F.col("diff_hi") < 0, F.lit("lower when corroborated"))
        .otherwise(F.lit("not distinguishable")).alias("status"))


def intervals_of(drawn: DataFrame, diff: Column, draws: int) -> DataFrame:
    from ledgerloom.operators.bootstrap import intervals

    return intervals(drawn, ["family"], rule="truncate", draws=draws, diff=diff)


def coupling(pairs: DataFrame, lex) -> DataFrame:
    """Do answer families have the same family in the ledger part, and is an empty ledger bare?

    pairs  ledger, answer
    """
    m = pairs.select(X.families_mask("ledger", lex).alias("l"), X.families_mask("answer", lex).alias("a"))
    m = m.groupBy("l", "a").agg(F.count("*").alias("n"))
    bits = lambda e: F.bit_count(e).cast("bigint")
    t = m.agg(
        F.sum(bits("a") * F.col("n")).alias("answer_families"),
        F.sum(bits(F.col("l").bitwiseAND(F.col("a"))) * F.col("n")).alias("coupled"),
        F.sum(F.when(F.col("l") == 0, F.col("n")).otherwise(0)).alias("empty_ledgers"),
        F.sum(F.when((F.col("l") == 0) & (F.col("a") == 0), F.col("n")).otherwise(0)).alias("empty_and_bare"))
    rate = S.ratio("coupled", "answer_families")
    return t.select(
        "*", rate.alias("rate"),
        F.when(F.col("answer_families") == 0, F.lit("nothing to check"))
        .when((rate >= 0.8) & (F.col("empty_ledgers") == F.col("empty_and_bare")), F.lit("coupled"))
        .otherwise(F.lit("not coupled")).alias("status"))


def instrument_divergence(texts: DataFrame, lex_a, lex_b) -> DataFrame:
    """Per family: how often two detectors agree on the same text (presence level)."""
    if list(lexicon(lex_a)) != list(lexicon(lex_b)):
        raise ValueError("the two lexicons must name the same families in the same order")
    m = texts.select(X.families_mask("text", lex_a).alias("a"), X.families_mask("text", lex_b).alias("b"))
    m = m.groupBy("a", "b").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), X.mask_has("a", i).alias("ha"), X.mask_has("b", i).alias("hb"))
        for i, f in enumerate(lexicon(lex_a))]))
    def tally(cond, name):
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    out = m.select(each.alias("e"), "n", (F.col("a") == F.col("b")).alias("same_set")).select("e.*", "n", "same_set")
    ha, hb = F.col("ha"), F.col("hb")
    t = out.groupBy("family").agg(
        F.sum("n").alias("n_texts"), tally(ha & hb, "both"), tally(ha & ~hb, "only_a"), tally(~ha & hb, "only_b"),
        tally(F.col("same_set"), "same_set"))
    return t.select("*", S.ratio(F.col("n_texts") - F.col("only_a") - F.col("only_b"), "n_texts").alias("agreement"))


def gate_report(attempts: DataFrame, lex, max_retries: int = 2, floor: int = MIN_OUTPUT_CHARS) -> DataFrame:
    """Gate outcome per run from stored attempts (run_id, attempt, upstream, output), attempt 0 the draft.

    The accepted attempt is the first without inventions, else the last within the retry budget.
    Aggregates keep one struct per run: nothing is collected.
    """
    a = audit(attempts.where(F.col("attempt") <= max_retries), lex, floor)
    row = F.struct("attempt", "invented_mask", "kept_mask", "supply", "chars")
    clean = F.col("invented_mask") == 0
    g = a.groupBy("run_id").agg(
        F.min(row).alias("pre"), F.max(row).alias("last"), F.min(F.when(clean, row)).alias("ok"))
    g = g.withColumn("post", F.coalesce("ok", "last"))
    return g.select(
        "run_id", F.col("pre.supply").alias("supply"), F.col("pre.invented_mask").alias("pre_invented"),
        F.col("pre.kept_mask").alias("pre_kept"), F.col("post.invented_mask").alias("residual"),
        F.col("post.kept_mask").alias("post_kept"), F.col("post.attempt").alias("retries"),
        (F.col("post.invented_mask") != 0).alias("annotated"))


# --- fixed values: disclosure note texts ---
NOTE_SHORT = X.NOTE_DELIM + " this response was too short to audit for source traceability."
NOTE_HEAD = X.NOTE_DELIM + " the following qualification types appear in this response without a source " \
    "in the specialist material: "
NOTE_TAIL = ". They may still be correct, but they are not traceable to the consulted experts."
# --- end of fixed values ---


def disclosure(lex, floor_guard="floor_guard", invented_mask="invented_mask") -> Column:
    """The reader-facing note of an unclean output; it names families and never quotes."""
    named = F.concat(F.lit(NOTE_HEAD), F.array_join(X.mask_names(invented_mask, lex), ", "), F.lit(NOTE_TAIL))
    return F.when(F.col(floor_guard), F.lit(NOTE_SHORT)).when(F.col(invented_mask) != 0, named)


def select_best(candidates: DataFrame, lex, key: str = "prompt_id", index: str = "cand",
                floor: int = MIN_OUTPUT_CHARS) -> DataFrame:
    """Best candidate per prompt: above the floor, fewest inventions, most kept, longest, first index.

    One aggregate with a struct maximum; the text of the losers never crosses the shuffle twice.
    """
    found = decompose(candidates.select(
        key, index, "output", F.length("output").alias("chars"),
        X.families_mask(join_upstream("upstream"), lex).alias("raised_mask"),
        X.families_mask("output", lex).alias("present_mask")), floor)
    rank = F.struct((~F.col("floor_guard")).cast("int"), -F.col("n_invented"), F.col("n_kept"), F.col("chars"),
                    -F.col(index))
    best = found.groupBy(key).agg(
        F.max_by(F.struct(index, "output", "floor_guard", "invented_mask", "n_kept", "ok"), rank).alias("b"),
        F.count("*").alias("n_sampled"), F.count_if("ok").alias("n_clean"))
    out = best.select(key, "b.*", "n_sampled", "n_clean")
    return out.withColumn("annotated", ~F.col("ok")).withColumn(
        "chosen", F.concat("output", F.coalesce(disclosure(lex), F.lit("")))).drop("output")


def manifest_restored(seats: DataFrame, discarded: DataFrame, lex) -> DataFrame:
    """For each discarded family and seat, the first sentence that carried it (at most 400 characters shown).

    seats      run_id, seat, text       discarded  run_id, discarded_mask
    """
    # masks are found inside the sentence array, so sentences without a family never become rows
    marked = F.filter(
        F.transform(X.sentences("text", "quoted"), lambda t, i: F.struct(
            i.alias("at"), t.alias("sentence"), X.families_mask(t, lex).alias("m"))), lambda e: e["m"] != 0)
    s = X.explode_rows(seats, ["run_id", "seat"], marked, "_p", "e").select(
        "run_id", "seat", F.col("e.at").alias("pos"), "e.sentence", "e.m")
    hits = s.join(discarded, "run_id").withColumn("m", F.col("m").bitwiseAND(F.col("discarded_mask"))).where("m <> 0")
    each = F.explode(F.filter(
        F.array(*[F.when(X.mask_has("m", i), F.lit(f)) for i, f in enumerate(lexicon(lex))]),
        lambda f: f.isNotNull()))
    return hits.select("run_id", "seat", "pos", "sentence", each.alias("family")).groupBy(
        "run_id", "family", "seat").agg(F.min_by(F.substring("sentence", 1, 400), "pos").alias("quote"))


# --- fixed values: which seat a citation names ---
SEAT_ALIAS = {
    "healthcare": "healthcare", "clinical": "healthcare", "medical": "healthcare", "legal": "legal",
    "law": "legal", "finance": "finance", "financial": "finance",
}
# --- end of fixed values ---


def citation_marks(outputs: DataFrame, seats: DataFrame, aliases=None) -> DataFrame:
    """Check each citation of the output against the figures in the named seat's text.

    outputs  run_id, output      seats  run_id, seat, text
    """
    table = F.create_map(*[F.lit(x) for kv in (aliases or SEAT_ALIAS).items() for x in kv])
    cited = X.explode_rows(outputs, ["run_id"], X.citations("output"), "pos", "sentence")
    cited = cited.withColumn("seat", F.try_element_at(
        table, F.lower(F.regexp_extract("sentence", r"^\w+", 0)))).withColumn("figs", X.figures("sentence"))
    held = seats.select("run_id", "seat", X.figures("text").alias("held"))
    return cited.join(held, ["run_id", "seat"]).select(
        "run_id", "pos", "seat", "sentence",
        F.when(F.size("figs") == 0, F.lit("unchecked-qualitative"))
        .when(F.arrays_overlap("figs", "held"), F.lit("verified")).otherwise(F.lit("unsupported")).alias("status"))

"""Text pieces for the DuckDB oracles. Each returns SQL; nothing here is executed by Spark."""

from __future__ import annotations

import math

from ledgerloom.lexicons import lexicon

# RE2's classes are ASCII, so oracles match on text whose other letters are replaced by one letter.
def ascii_text(t: str) -> str:
    return f"regexp_replace({t}, '[^\\x00-\\x7F]', 'z', 'g')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mask(t: str, lex) -> str:
    """Family bit mask of text expression t (already ascii)."""
    bits = [
        "(CASE WHEN " + " OR ".join(f"regexp_matches({t}, {q(p)}, 'i')" for p in pats)
        + f" THEN {1 << i} ELSE 0 END)"
        for i, pats in enumerate(lexicon(lex).values())
    ]
    return "(" + " + ".join(bits) + ")"


def count(t: str, pats: list[str]) -> str:
    return "(" + " + ".join(
        f"len(regexp_extract_all({t}, {q(p)}, 0, 'i'))" for p in pats) + ")"


def total(t: str, lex) -> str:
    return "(" + " + ".join(count(t, p) for p in lexicon(lex).values()) + ")"


def names(m: str, lex) -> str:
    order = sorted((n, i) for i, n in enumerate(lexicon(lex)))
    return "concat_ws(','," + ", ".join(f"CASE WHEN ({m} & {1 << i}) <> 0 THEN '{n}' END" for n, i in order) + ")"


def minus(a: str, b: str) -> str:
    return f"({a} & (~{b}))"


def sents(t: str) -> str:
    """Boundary-rule sentences."""
    return (f"list_filter(string_split(regexp_replace({t}, '([.!?])\\s+|\\n+', '\\1' || chr(30), 'g'), chr(30)),"
            " lambda x: x <> '')")


def sents_len(t: str, lo: int, hi: int | None) -> str:
    """Sentence rules that only cut after . ! ? and keep a length range."""
    cond = f"length(x) >= {lo}" + (f" AND length(x) <= {hi}" if hi else "")
    cut = (f"string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))")
    return (f"list_filter(list_transform({cut}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),"
            f" lambda x: {cond})")


def wilson(k: str, n: str) -> tuple[str, str]:
    z = 1.96
    nn = f"nullif({n}, 0)::DOUBLE"
    p = f"({k} / ({nn}))"
    d = f"(1 + {z * z} / ({nn}))"
    mid = f"(({p} + {z * z / 2} / ({nn})) / {d})"
    half = f"({z} * sqrt({p} * (1 - {p}) / ({nn}) + {z * z / 4} / (({nn}) * ({nn}))) / {d})"
    return (f"CASE WHEN {n} > 0 THEN greatest(0.0, {mid} - {half}) END",
            f"CASE WHEN {n} > 0 THEN least(1.0, {mid} + {half}) END")


def slope(n="n", sx="sx", sy="sy", sxx="sxx", sxy="sxy") -> str:
    return (f"(CASE WHEN {n}::DOUBLE * {sxx} - {sx}::DOUBLE * {sx} > 1e-9 THEN "
            f"({n}::DOUBLE * {sxy} - {sx}::DOUBLE * {sy}) / ({n}::DOUBLE * {sxx} - {sx}::DOUBLE * {sx}) END)")


def intercept(n="n", sx="sx", sy="sy", sxx="sxx", sxy="sxy") -> str:
    return f"(({sy} - {slope(n, sx, sy, sxx, sxy)} * {sx}) / {n}::DOUBLE)"


def r2(n="n", sx="sx", sy="sy", sxx="sxx", sxy="sxy", syy="syy") -> str:
    vx = f"({n}::DOUBLE * {sxx} - {sx}::DOUBLE * {sx})"
    vy = f"({n}::DOUBLE * {syy} - {sy}::DOUBLE * {sy})"
    cv = f"({n}::DOUBLE * {sxy} - {sx}::DOUBLE * {sy})"
    return f"(CASE WHEN {vx} > 1e-9 AND {vy} > 1e-9 THEN {cv} * {cv} / ({vx} * {vy}) END)"


def quad() -> str:
    """Quadratic coefficient from n, sx, sxx, sx3, sx4, sy, sxy, sxxy."""
    s = {k: f"{k}::DOUBLE" for k in ("n", "sx", "sxx", "sx3", "sx4", "sy", "sxy", "sxxy")}

    def det(p, r, t):
        (a, b, d), (e, f, g), (h, i, j) = p, r, t
        return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {d} * ({e} * {i} - {f} * {h}))"

    n, sx, sxx, s3, s4 = s["n"], s["sx"], s["sxx"], s["sx3"], s["sx4"]
    base = det((n, sx, sxx), (sx, sxx, s3), (sxx, s3, s4))
    top = det((n, sx, s["sy"]), (sx, sxx, s["sxy"]), (sxx, s3, s["sxxy"]))
    return f"(CASE WHEN abs({base}) > 1e-6 THEN {top} / {base} END)"


# Poisson(1) cumulative probabilities up to 12, stated here anew and not taken from the engine.
POISSON_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def poisson(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {p!r} THEN {k}" for k, p in enumerate(POISSON_CDF)) \
        + f" ELSE {len(POISSON_CDF)} END"


def _uni(digest: str, off: str) -> str:
    return f"(('0x' || substr({digest}, {off}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def boot(name: str, src: str, by: list[str], stats: list[str], key: list[str] | None = None,
         draws: int = 2000, seed: int = 0) -> str:
    """CTE text defining `name`(by..., draw, n, stats...) from unit relation `src`."""
    by_s = "".join(f"{b}, " for b in by)
    ident = "concat_ws('|', " + ", ".join(f"coalesce({x}::VARCHAR, '~')" for x in by + (key or stats)) + ")"
    if key is None:
        cells = (f"SELECT {by_s}{', '.join(stats)}, count(*) AS m_, {ident} AS id_ FROM {src} "
                 f"GROUP BY {', '.join(by + stats)}")
    else:
        cells = f"SELECT {by_s}{', '.join(stats)}, 1::BIGINT AS m_, {ident} AS id_ FROM {src}"
    dig = f"md5(concat_ws('|', '{seed}', (draw // 4)::VARCHAR, slot_::VARCHAR, id_))"
    zdig = f"md5(concat_ws('|', '{seed}', 'z', draw::VARCHAR, try_::VARCHAR, id_))"
    sums = ", ".join(f"sum(w_ * {s}) AS {s}" for s in stats)
    return f"""{name}_cells AS MATERIALIZED ({cells}),
{name}_w AS (
  SELECT {by_s}{', '.join(stats)}, draw, ({poisson('u_')})::DOUBLE AS w_ FROM (
    SELECT *, {_uni('d_', '(1 + 8 * (draw % 4))::INT')} AS u_ FROM (
      SELECT *, {dig} AS d_ FROM (
        SELECT c.*, unnest(range(1, (c.m_ + 1)::BIGINT)) AS slot_ FROM {name}_cells c WHERE c.m_ < 16
      ) CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw)))
  UNION ALL
  SELECT {by_s}{', '.join(stats)}, draw, w_ FROM (
    SELECT {', '.join(f'any_value({c}) AS {c}' for c in by + stats)}, draw, id_,
      arg_min(k_, try_) FILTER ((s_ >= 0.07 AND v_ <= 0.9277 - 3.6224 / (b_ - 2))
        OR (k_ >= 0 AND NOT (s_ < 0.013 AND v_ > s_)
            AND ln(v_) + ln(1.1239 + 1.1328 / (b_ - 3.4)) - ln((-0.059 + 0.02483 * b_) / (s_ * s_) + b_)
                <= k_ * ln(m_) - m_ - lgamma(greatest(k_, 0) + 1))) AS w_
    FROM (SELECT *, floor((2 * (-0.059 + 0.02483 * b_) / s_ + b_) * u_ + m_ + 0.43) AS k_ FROM (
      SELECT *, greatest(0.5 - abs(u_), pow(2.0::DOUBLE, -33)) AS s_ FROM (
      SELECT *, 0.931 + 2.53 * sqrt(m_) AS b_, {_uni('zd_', '1')} - 0.5 AS u_, 1 - {_uni('zd_', '9')} AS v_ FROM (
      SELECT c.*, draw, try_, {zdig} AS zd_ FROM {name}_cells c CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw)
        CROSS JOIN (SELECT unnest(range(0, 12)) AS try_) WHERE c.m_ >= 16))))
    GROUP BY draw, id_)),
{name} AS MATERIALIZED (SELECT {by_s}draw, sum(w_) AS n, {sums} FROM {name}_w GROUP BY {by_s}draw)"""


def ci(values: str, rule: str = "floor_ceil", draws: int = 2000, alpha: float = 0.05) -> tuple[str, str]:
    """(lo, hi) aggregate expressions over a draw column or expression."""
    per = round(alpha / 2 * 1000)
    lst = f"list_sort(list({values}) FILTER (({values}) IS NOT NULL))"
    n = f"count({values})"
    low = f"floor({n} * {per} / 1000.0)"
    high = {
        "floor_ceil": f"ceil({n} * {1000 - per} / 1000.0) - 1",
        "truncate": f"least({n} - 1, floor({n} * {1000 - per} / 1000.0))",
        "fixed": f"floor({n} * {1000 - per} / 1000.0) - 1",
    }[rule]
    ok = f"{n} >= {draws * 0.5}"
    return (f"CASE WHEN {ok} THEN ({lst})[(greatest({low}, 0) + 1)::BIGINT] END",
            f"CASE WHEN {ok} THEN ({lst})[(greatest({high}, 0) + 1)::BIGINT] END")


# ---------------------------------------------------------------- shared relations

# Runs dealt from documents: even sentences are the output, odd ones go to three seats in turn.
DEALT = f"""dealt AS MATERIALIZED (
  SELECT doc_id AS run_id, source AS condition, lang AS writer_id, doc_id % 50 AS prompt_id,
         array_to_string(list_filter(ss, lambda x, i: (i - 1) % 2 = 0), ' ') AS output,
         array_to_string(list_filter(ss, lambda x, i: (i - 1) % 6 = 1), ' ') AS alpha,
         array_to_string(list_filter(ss, lambda x, i: (i - 1) % 6 = 3), ' ') AS beta,
         array_to_string(list_filter(ss, lambda x, i: (i - 1) % 6 = 5), ' ') AS gamma
  FROM (SELECT *, {sents('text')} AS ss FROM documents)),
runs AS MATERIALIZED (
  SELECT *, array_to_string(list_filter([alpha, beta, gamma], lambda x: x <> ''), chr(10) || chr(10)) AS up
  FROM dealt)"""


def audited(lex="prose", name: str = "aud", floor: int = 500, mask=mask) -> str:
    """CTE `name`: the provenance decomposition of `runs`, families told by `mask(text expression, lex)`."""
    out, up = ascii_text("output"), ascii_text("up")
    return f"""{name}_m AS MATERIALIZED (SELECT run_id, condition, writer_id, prompt_id, length(output) AS chars,
    {mask('upa', lex)} AS raised, {mask('outa', lex)} AS present
  FROM (SELECT *, {out} AS outa, {up} AS upa FROM runs)),
{name}_s AS (SELECT *, chars < {floor} AS floored,
    CASE WHEN chars < {floor} THEN 0 ELSE raised & present END AS kept,
    CASE WHEN chars < {floor} THEN raised ELSE {minus('raised', 'present')} END AS discarded,
    CASE WHEN chars < {floor} THEN 0 ELSE {minus('present', 'raised')} END AS invented FROM {name}_m),
{name} AS MATERIALIZED (SELECT *, bit_count(raised) AS supply, bit_count(kept) AS n_kept,
    bit_count(invented) AS n_inv, bit_count(kept) + bit_count(invented) AS emitted,
    CASE WHEN floored THEN 0.0 WHEN bit_count(kept) + bit_count(invented) = 0 THEN 1.0
         ELSE bit_count(kept) / (bit_count(kept) + bit_count(invented))::DOUBLE END AS traceability FROM {name}_s)"""

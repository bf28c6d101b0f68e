"""Property classes: named lexicons, each an ordered map family -> patterns.

A lexicon is data. Pass one of the names below, a mapping of your own, or the path of a JSON file.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

# --- fixed values: the shipped property classes (pattern texts must match for equal results) ---
EPISTEMIC = {
    "cutoff": [
        r"training[- ]?cut[- ]?off", r"knowledge cut[- ]?off",
        r"may (?:be |have )(?:stale|outdated|evolved)", r"post[- ]?cut[- ]?off",
        r"after my training", r"verify (?:current|latest|recent)",
        r"as of (?:my )?(?:training|knowledge|2024|2025)",
    ],
    "modeled": [
        r"modell?ed at", r"\bassume[ds]? (?:that|the)", r"\bassuming (?:that|the|a |an |\d)",
        r"under the assumption", r"this assume[ds]", r"\bwe assume\b", r"\bhypothetical[ly]?\b",
    ],
    "jurisd": [
        r"\bUK\s?GDPR\b", r"\bEU\s?GDPR\b", r"post[- ]Brexit",
        r"each\s+(?:jurisdiction|country|state|regime)", r"preempt(?:ion|s|ed)",
    ],
    "hedging": [
        r"(?:false[- ]positive|false[- ]negative)", r"alert fatigue",
        r"real[- ]world\s+(?:evidence|data)", r"sensitivity (?:analysis|range|to|of)",
        r"low/?high (?:case|scenario|estimate)", r"\b±\s?\d", r"(?:may|might|could)\s+(?:vary|differ|change)",
    ],
}
ATTRIBUTION = {
    "named_source": [
        r"\baccording to\b", r"\bper the\b", r"\bcites?\b", r"\bas reported by\b", r"\bsource:\s",
    ],
    "seat_credit": [
        r"\b(?:the )?(?:healthcare|legal|finance|clinical|medical)\s+(?:seat|specialist|expert|analysis)\b",
    ],
    "quantified": [r"\b\d+(?:\.\d+)?\s?%", r"\$\s?\d", r"\bn\s?=\s?\d+"],
    "uncertainty_owner": [r"\b(?:they|the specialist|the analysis)\s+(?:notes?|flags?|warns?)\b"],
}
# The five-family disposition class adds vocabulary precision to the epistemic four.
PRECISE = [
    r"(?:approval).*?(?:vs\.?|versus|not).*?(?:clearance)", r"distinguish(?:es|ing|ed)? between",
    r"standard[- ]of[- ]care", r"(?:510\(k\)|de novo|PMA)\s+(?:clearance|approval|pathway)",
    r"\b(?:NDA|BLA)\s+approval\b",
]
# The narrower gate applied to the rejected side of preference pairs.
PAIR_GATE = {
    "cutoff": [
        r"training[- ]?cut[- ]?off", r"knowledge cut[- ]?off",
        r"may (?:be |have )(?:stale|outdated|out[- ]of[- ]date|evolved)", r"post[- ]?cut[- ]?off",
        r"after my training", r"verify (?:current|latest|recent) (?:rates|guidance|regulations|status)",
        r"as of (?:my )?(?:training|knowledge|2024|2025)",
    ],
    "modeled": EPISTEMIC["modeled"],
    "precise": PRECISE[:3],
    "jurisd": [
        r"each\s+(?:jurisdiction|country|state|regime)", r"treat(?:ing|ed)?\s+each\s+\w+\s+separately",
        r"\bUK\s?GDPR\b.*?\bEU\s?GDPR\b",
    ],
    "hedging": [
        r"sensitivity (?:analysis|range|to|of)", r"\b±\s?\d", r"(?:may|might|could)\s+(?:vary|differ|change)",
        r"low/?high (?:case|scenario|estimate)",
    ],
}
# --- end of fixed values ---

DISPOSITION = {
    "cutoff": EPISTEMIC["cutoff"], "modeled": EPISTEMIC["modeled"], "precise": PRECISE,
    "jurisd": EPISTEMIC["jurisd"], "hedging": EPISTEMIC["hedging"],
}

# Property classes bound to the invented prose of the test tables, where the shipped ones never fire.
PROSE = {
    "agent": [r"\bby\b", r"\bvon\b", r"\bpour\b"],
    "figure": [r"\d+"],
    "licence": [r"licen[sc]e", r"copyright"],
    "linking": [r"\bwith\b", r"\bmit\b", r"\bavec\b"],
    "nominal": [r"\bth\w+tion\b", r"\b\w+heit\b"],
    "stative": [r"\bwas\b", r"\best\b", r"\bist\b"],
}
PROSE_LOOSE = {
    "agent": [r"\bby", r"\bvon", r"\bpour"],
    "figure": [r"\d{3,}"],
    "licence": [r"licen[sc]e", r"copy"],
    "linking": [r"\bwith\b", r"\bmit\b", r"\bcon\b"],
    "nominal": [r"\bth\w*tion", r"heit\b"],
    "stative": [r"\bwas\b", r"\bes\b", r"\bist\b"],
}

NAMED = {
    "epistemic": EPISTEMIC, "attribution": ATTRIBUTION, "disposition": DISPOSITION,
    "pair_gate": PAIR_GATE, "prose": PROSE, "prose_loose": PROSE_LOOSE,
}

Lexicon = dict[str, list[str]]


def lexicon(spec: str | Mapping[str, list[str]]) -> Lexicon:
    """Resolve a lexicon name, mapping or JSON path to an ordered map; a detector gives its families, without patterns."""
    if hasattr(spec, "names"):
        return {name: [] for name in spec.names}
    if isinstance(spec, Mapping):
        found = dict(spec)
    elif spec in NAMED:
        found = NAMED[spec]
    else:
        with open(spec, encoding="utf-8") as handle:
            found = json.load(handle)
    if len(found) > 62:
        raise ValueError("a lexicon holds at most 62 families (one bit each in a bigint)")
    return found


def lexicon_table(spark, spec, name: str | None = None):
    """The lexicon as a table (property_class, family, pattern_id, pattern)."""
    rows = [
        (name or (spec if isinstance(spec, str) else "custom"), fam, i, pat)
        for fam, pats in lexicon(spec).items()
        for i, pat in enumerate(pats)
    ]
    return spark.createDataFrame(
        rows, "property_class string, family string, pattern_id int, pattern string")

"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerloom.plans import load
from ledgerloom.session import local_session

HEADLINE = [
    "v1_audit", "v1_audit_chat", "v2_dose_response", "v2_dose_response_chat", "v3_manifest_restored", "v5_select_best",
    "v6_transmission", "v11_literal_hits", "v12_shortlist", "v14_adoption_four_way", "t1_families", "t2_counts", "t4_spans",
    "t13_profile", "e1_ols", "e5_shrinkage", "e10_clean_rate", "e13_quantiles", "e15_compare_arms", "e28_agreement",
    "p11_decode_plans", "p18_duplicates", "s10_labels_long", "d7_drop_pairs", "d16_dedup_sentences", "r1_event_feed",
    "r2_lifecycle", "r5_budget_guard",
    "e47_parameter_cards", "v7_corroboration", "e3_bootstrap_ols", "e8_span_fraction", "e11_best_of_n",
    "e19_cluster_difference", "e22_meta", "e23_icc", "e26_auc", "e32_win_share",
    "d2_supply_variants", "d13_extreme_pairs", "v4_gate_report", "t15_ngram_overlap", "v20_instrument_divergence",
    "p2_partition_dropped",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    queries, _ = load()
    wanted = list(queries) if names == ["all"] else names or HEADLINE
    queries["e12_wilson"](spark, sf_dir).count()  # warm the session, not the queries
    seconds = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main(sys.argv[1:])

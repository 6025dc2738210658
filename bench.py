"""Times the headline queries over whole tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a2_publication_rates", "a14_caliper_naive", "a17_cluster_bootstrap", "a17_cluster_bootstrap_draws",
    "a20_cross_group_permutation", "a21_caliper_inclusion", "a28_probit_lineitem", "a29_primary_probit",
    "a47_weighted_kappa", "j6_fuzzy_title_join", "j7_fuzzy_year_window", "j11_tfidf_join",
    "j12_tfidf_candidates", "j13_word_containment", "j22_strategy_cascade", "w10_sample_per_stratum",
    "x1_normalise_title", "x15_topic_hit", "x21_page_score", "s12_heading_layout",
]


def main() -> None:
    from verdigris.plans import QUERIES
    from verdigris.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", "bench", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()

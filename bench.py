"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from proofgrid.plans import registry
from proofgrid.session import build_session

HEADLINE = [
    "win_4_rank", "agg_11_best_level", "join_1_mentions", "join_7_mention_location", "fn_1_sentences", "fn_9_skill_levels", "fn_22_typed_facts", "agg_12_many_filters",
    "udf_4_claims_from_any_producer", "prj_4_html_to_text", "src_4_admission", "win_3_first_seen_duplicate", "fn_13_durations", "agg_22_strongest_requirement",
    "win_12_largest_remainder", "top_5_three_strategies", "fn_39_ordered_evidence_fold", "fn_10_recency", "win_18_request_rate", "win_13_hash_chain",
    "join_8_mention_to_item", "match_2_ranked_profiles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    all_queries["prj_2_fold_compact"](spark, sf_dir).write.format("noop").mode("overwrite").save()     # start the executors
    times = {}
    for name in names:
        start = time.time()
        all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = {
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }
    if "win_4_rank" in times:
        out["documents_scored_per_sec"] = round(documents / times["win_4_rank"], 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()

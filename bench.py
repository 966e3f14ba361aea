"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidegauge.session import build_session

HEADLINE = [
    "t4_momentum_report", "horizon_deltas", "price_impact", "rolling_sigma", "sibling_moves", "propagation_label",
    "t4_tier_report", "momentum_spearman", "spearman_by_horizon", "average_rank", "eval_t1", "eval_t3", "eval_t4",
    "eval_t5", "macro_f1", "cluster_features", "interest_label", "stratified_split", "stratified_folds",
    "random_prior_sampled", "topk_candidates", "topk_inner_product", "bm25_topk", "prompt_candidates",
    "parse_ranking",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    from tidegauge.catalog.all import QUERIES

    spark.read.parquet(f"{folder}/region.parquet").count()  # start the engine outside the timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidegate.plans import catalogue, places
from tidegate.session import local_session

HEADLINE = ["near_open_ranked", "feasibility_codes", "coverage_cube", "diverse_order", "evidence_resolve", "ledger_supersede", "snapshot_diff", "pair_scores", "radius_pairs", "knn_nearest", "taste_fold", "html_visible_text", "revenue_by_status"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    taken: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - began, 3)
    # requests times candidates a second, gated, scored and ordered: the comparable unit of a search engine
    gated = catalogue.QUERIES["feasibility_codes"](spark, sf_dir)
    pairs = gated.count()
    rate = round(pairs / taken["near_open_ranked"])
    # one request over the candidates in its reach, warm
    one = places.one_request(spark, sf_dir)
    one.write.format("noop").mode("overwrite").save()
    began = time.time()
    one.write.format("noop").mode("overwrite").save()
    latency = round(time.time() - began, 3)
    candidates = gated.where(f"request_id = {places.ONE_REQUEST}").count()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "candidates_per_second": rate, "one_request_seconds": latency, "one_request_candidates": candidates, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

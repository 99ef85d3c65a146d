"""Time the headline queries: one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from checks import ALL_QUERIES
from checks.compare import local_session

HEADLINE = [
    "conversation_messages",
    "scan_rollout_lines",
    "scan_conversations",
    "message_counts",
    "preview_messages",
    "rollout_metadata",
    "collected_attachments",
    "title_map",
    "catalog_from_files",
    "resolve_rollouts",
    "merge_catalogs",
    "load_snapshot_catalog",
    "search_sessions",
    "prune_state",
    "upsert_state",
    "delete_state",
    "filter_lines",
    "dedupe_lines",
    "merge_lines",
    "retention",
    "snapshot_sizes",
    "recovery_decisions",
    "latest_snapshot_with_session",
    "snapshot_files_of_sessions",
    "fleet_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        ALL_QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

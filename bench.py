"""Times the registered queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma
separated names, default: the headline set).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "changeset_diff", "closest_version_asof", "integrity_mismatch", "new_capability_delta", "new_endpoint_best_evidence", "env_harvest",
    "first_version_cluster", "self_publish_shape", "mangled_ids", "entropy_by_file", "minified_files", "entropy_jump", "maintainer_change",
    "dep_spec_class", "typosquat", "hyphen_permutation", "escalation", "compound_escalation", "advisory_match", "technique_tags",
    "verdict", "risk_score", "config_apply", "policy_decision", "receipt_hash", "merge_gate", "provenance_paths", "subtree_closure",
    "rollup_by_direct", "study_npm", "coverage_gate", "osif_incidents", "identity_invariant", "rate_limit", "job_ttl",
]


def main() -> None:
    from driftlens.plans.registry import REGISTRY
    from driftlens.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "driftlens-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    REGISTRY["verdict"](spark, folder).write.format("noop").mode("overwrite").save()  # start workers and warm up
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total query time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

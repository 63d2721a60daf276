"""Times the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wardline.plans import PLANS
from wardline.session import local_session

HEADLINE = [
    "scored_severity_by_host",
    "stream_features",
    "risk_scores",
    "failed_login_burst",
    "suspicious_chains",
    "baseline_shares",
    "login_deviation",
    "incident_rollup",
    "attack_chains",
    "threat_progression",
    "phase_transitions",
    "process_tree_growth",
    "timeline_range",
    "process_context",
    "nearest_events_by_host",
    "retained_events",
    "type_severity_matrix",
    "tenant_usage",
    "validated_telemetry",
    "deduplicated_events",
    "network_flow_features",
    "flow_score_auc",
    "balanced_flows",
    "prediction_drift",
    "isolation_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "wardline-bench")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # One untimed small run warms the JVM.
    PLANS[names[0]](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.time()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from checks import ledgers
from checks.queries import QUERIES
from payrecheck.session import local_session

HEADLINES = (
    "aggregate_to_payments",
    "candidates_by_signal",
    "blocking_capped",
    "blocking_work",
    "rules_only_findings",
    "dismissal_counts",
    "stage_funnel",
    "detection_score",
    "entity_resolution",
    "review_queue",
    "replayed_verdicts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    # Start-up and class loading are not what is measured.
    QUERIES["rules_only_findings"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    # The payments are derived and written once, timed apart, and shared by the queries.
    started = time.perf_counter()
    payments = ledgers.payments_of(spark, folder)
    seconds["staged_payments"] = round(time.perf_counter() - started, 3)
    ledgers.payments_of = lambda *_: payments
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries: one warm-up, then the median of three runs. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from plumbline import analyze
from plumbline.session import local_session
from workload import views as V
from workload.queries import QUERIES

HEADLINE = [
    "profile_dates", "detect_pattern_counts", "q_missing", "q_duplicate_rows", "q_duplicate_ids", "q_emails", "q_dates",
    "q_numeric", "r_comparison", "r_referential", "r_known_parts", "score_dimensions", "kpi_values", "kpi_by_month",
    "kpi_by_dimension", "eval_precision_recall",
]
REPEATS = 3


def full_pipeline(spark, sf):
    """Everything the analysis of dirty_orders yields, issue rows included."""
    report = analyze(V.dirty_orders(spark, sf), "row_key", rules=V.RULES, parents={"customer": V.read(spark, sf, "customer")}, keep=True, key_is_data=False)
    report.overall.collect()
    report.issues.write.format("noop").mode("overwrite").save()
    report.close()


def small_table(spark, sf):
    """A 20,000 x 5 table: profile, types, checks and score."""
    frame = spark.range(20_000).selectExpr(
        "id AS rid", "id", "element_at(array('A', 'B', 'C', NULL), CAST(id % 4 + 1 AS INT)) AS category", "sin(id) AS amount",
        "CAST(date_add(DATE'2023-01-01', CAST(id AS INT)) AS TIMESTAMP_NTZ) AS date",
        "IF(id % 100 = 0, 'invalid', concat('user', id, '@example.com')) AS email",
    )
    report = analyze(frame, "rid", keep=True, key_is_data=False)
    report.overall.collect()
    report.issues.write.format("noop").mode("overwrite").save()
    report.close()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "16g", spark__sql__shuffle__partitions=cpus)
    runs = {name: (lambda q=QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    runs["full_pipeline"] = lambda: full_pipeline(spark, sf_dir)
    runs["pipeline_20000x5"] = lambda: small_table(spark, sf_dir)
    chosen = sys.argv[1:] or list(runs)
    seconds = {}
    for name in chosen:
        runs[name]()
        seconds[name] = round(statistics.median(timed(runs[name]) for _ in range(REPEATS)), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, warm median of 3", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("/", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

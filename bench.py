"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sheaf.plans import registry
from sheaf.session import local_session

HEADLINES = (
    "r9_reconciliation_summary", "t5_reconcile_totals", "x3_keywords", "l14_repeated_margin_text", "f11_verify_removal",
    "x1_text_stats", "x5_cleaning_report", "x6_json_process", "x8_latest_response", "t3_diff_tables",
    "w1_search_catalog", "w5_audit_page_metadata", "p3_compact_pages", "c4_age_breakdown", "f13_redact", "k2_html_objects",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, times = registry.queries(), {}
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

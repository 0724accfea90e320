"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of driver tables, BENCH_CPUS the local cores.
Each query writes all its rows to the no-op sink, so nothing is pruned away.
No query starts after BENCH_BUDGET seconds; those left out are listed as skipped.
"""

from __future__ import annotations

import json
import os
import time

from tallywork.catalog import CATALOG
from tallywork.session import local_session

# From light to heavy, so that a run cut by the time budget still has the light ones.
HEADLINE = [
    "ledger_period_scan", "monthly_rollup", "top_merchants", "period_totals", "monthly_reports", "month_close",
    "statement_reconciliation", "classified_rows", "category_breakdown", "ledger_merge", "transfer_pairs", "merchant_patterns",
    "strict_candidates", "refund_matches", "alert_feed", "spending_plan", "parsed_bank_rows", "subscriptions",
    "cash_flow_projection", "full_period_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    CATALOG["ledger_stats"].run(spark, folder).write.format("noop").mode("overwrite").save()
    budget = float(os.environ.get("BENCH_BUDGET", "540"))
    seconds, skipped, began = {}, [], time.perf_counter()
    for name in HEADLINE:
        start = time.perf_counter()
        if start - began > budget:
            skipped.append(name)
            continue
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "skipped": skipped, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

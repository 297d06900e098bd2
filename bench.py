"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {key: sec}, "sf"}.
Each query is executed fully with the ``noop`` sink (all rows computed, none
collected), after a warm-up on the smallest fixture to start and JIT the JVM.

Later keys read slices and aggregates that earlier ones wrote.  With $BENCH_COLD set every
key starts without them instead (``cold`` is then true in the line).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfpulse.checks import registry  # noqa: E402
from shelfpulse.session import get_session  # noqa: E402
from shelfpulse.sources.views import Views  # noqa: E402

HEADLINE = [
    "market_share", "share_impact_city_brand", "market_share_category", "brand_metrics_change",
    "category_metrics", "product_metrics", "compare_periods", "price_tier_kmeans",
    "keyword_scores", "keyword_recs", "keyword_brand_sov", "contribution_pct",
    "drilldown_down", "drilldown_up", "sku_osa", "psl_by_sku", "offtake_summary", "report_row",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or HEADLINE
    spark = get_session(f"local[{cpus}]", int(cpus))
    registry.load_all()
    keys = [k for k in keys if k in registry.QUERIES]
    # warm-up (JVM start, JIT, codegen): one full query on the smallest fixture when it
    # sits next to the bench folder; nothing computed for the bench folder is reused
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = small if os.path.isdir(small) and small != sf_dir.rstrip("/") else sf_dir
    registry.QUERIES["scan_table"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    if warm_dir != sf_dir:
        registry.QUERIES["share_impact_city_brand"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    cold = bool(os.environ.get("BENCH_COLD"))
    times = {}
    for k in keys:
        if cold:
            Views._shared.clear()
        t0 = time.time()
        registry.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf} | ({"cold": True} if cold else {})))


if __name__ == "__main__":
    main()

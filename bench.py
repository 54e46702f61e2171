"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed completely through the ``noop`` sink (no collect to
the driver).  ``build_layers`` is the processed + curated pipeline (dedupe,
market joins, IV, Greeks, year-partitioned writes); the other queries read
the stored layers, as API queries do in the source system.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "curate_greeks",        # chain: market joins + Arrow IV + Greeks
    "dedupe_first",         # keep-first de-duplication of raw contracts
    "curate_join_futures",  # futures fair value
    "option_chain",         # chain read, sorted
    "chain_stats",
    "iv_smile",
    "index_change",
    "portfolio_risk",       # positions ⋈ lots ⋈ chain, MtM + scenario
    "portfolio_summary",
    "shock_grid",           # 45-point stress grid
    "portfolio_var",        # positions x 252 historical scenarios -> VaR/CVaR
    "scenario_rank",
    "put_call_parity_residual",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from riskloom.session import get_spark
    from riskloom import catalog

    spark = get_spark(f"local[{cpus}]", cpus, app_name="riskloom-bench",
                      extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    qs = catalog.queries()
    times: dict[str, float] = {}

    t0 = time.time()
    catalog.ctx(spark, sf_dir).layers  # processed + curated layers written once
    times["build_layers"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        if name not in qs:
            continue
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_time", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

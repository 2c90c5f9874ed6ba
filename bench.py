"""Headline bench: seconds per registered query, one JSON line on stdout.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the cores. Every query is planned and
executed in full; results are counted by a no-op writer, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bizlens.registry import all_queries  # noqa: E402
from bizlens.session import build_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(os.environ.get("BENCH_ONLY", "").split(",")) - {""}
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()

    seconds: dict[str, float] = {}
    for name, (query, _) in all_queries().items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "registered queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

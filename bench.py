"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed into Spark's ``noop`` sink (no driver collect),
timed after one warm-up pass over the scans. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eoframe.plans import load_all  # noqa: E402
from eoframe.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    spark = build_session(f"local[{cpus}]", app="eoframe-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    queries = load_all()
    names = only or sorted(queries)
    # Warm-up: JVM, codegen caches and the Parquet footers of every table.
    for t in ("lineitem", "orders", "part", "events"):
        spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for n in names:
        t0 = time.perf_counter()
        try:
            queries[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
        spark.catalog.clearCache()
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

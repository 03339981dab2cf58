"""Benchmark: fresh warehouse build + every registered query.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line:
  {"metric": "etl_plus_queries_sec", "value": total, "unit": "sec",
   "queries": {"build": s, "q01_kpis": s, ...}, "sf": ...}

The build always runs from scratch into a fresh directory (no reuse of an
earlier build), then each query runs once to completion through Spark's
``noop`` sink (full execution, no transfer of result rows to Python).

Before the timed part, the same build and queries run once on the smallest
input (sf0.001) to load classes and JIT-compile the JVM code paths, as JVM
benchmarks do. That fixed start-up cost is reported as ``warmup_sec`` and is
included in ``cold_total_sec``; ``value`` is the timed run at ``sf`` alone.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from almacen.plans import catalog, warehouse  # noqa: E402
from almacen.session import build_session, shared_dir  # noqa: E402

WARMUP_SF = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", app="almacen-bench", shuffle_partitions=cpus)

    t_warm = time.perf_counter()
    _run_all(spark, WARMUP_SF, f"{shared_dir(spark)}/almacen-bench/{uuid.uuid4().hex[:12]}", {}, {})
    warmup = round(time.perf_counter() - t_warm, 3)

    base = f"{shared_dir(spark)}/almacen-bench/{uuid.uuid4().hex[:12]}"
    times: dict[str, float] = {}
    steps: dict[str, float] = {}
    star = _run_all(spark, sf_dir, base, times, steps)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "etl_plus_queries_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "warmup_sec": warmup, "cold_total_sec": round(total + warmup, 3),
                      "build_steps": steps, "rows": star.rows}))
    spark.stop()


def _run_all(spark, sf_dir: str, base: str, times: dict[str, float],
             steps: dict[str, float]) -> warehouse.Star:
    """Fresh build of ``sf_dir`` into ``base``, then every registered query."""
    t0 = time.perf_counter()
    star = warehouse.build(spark, sf_dir, base=base, timings=steps)
    times["build"] = round(time.perf_counter() - t0, 3)

    # Queries run against this fresh build.
    warehouse.pin(spark, sf_dir, star)
    for name, fn in catalog.registry().items():
        t = time.perf_counter()
        # The noop sink runs the whole plan without shipping rows to Python.
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    return star


if __name__ == "__main__":
    main()

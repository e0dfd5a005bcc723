"""Bench: the stage chain on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.  $BENCH_UPTO (default 8; 4: without models, explanations and saved results) is the last stage, $BENCH_GRID the model grid
(default: the reference's full grid).  After $BENCH_SECONDS (default 600) the line is printed with the stages finished by then."""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillscope.params import driver_params  # noqa: E402
from tillscope.session import get_spark  # noqa: E402
from tillscope.sources.driver_tables import transactions  # noqa: E402
from tillscope.plans.stages import run_stages  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * int(cpus) if cpus.isdigit() else 16)))
    spark = get_spark(cpus, shuffle_partitions=parts, app="tillscope-bench")
    timings: dict[str, float] = {}
    t0 = time.time()
    params = driver_params(grid=os.environ.get("BENCH_GRID", "full"))

    def line(rows: dict, complete: bool) -> str:
        total = sum(timings.values()) if not complete else time.time() - t0
        return json.dumps({"metric": "stage_chain_wall", "value": round(total, 2), "unit": "sec",
                           "queries": {k: round(v, 2) for k, v in timings.items()},
                           "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "rows": rows, "complete": complete,
                           "spark": spark_version, "cores": cpus, "grid": params.grid, "shuffle_partitions": parts})

    def late() -> None:
        print(line({}, False), flush=True)
        os._exit(0)

    spark_version = spark.version
    limit = threading.Timer(float(os.environ.get("BENCH_SECONDS", "600")), late)
    limit.daemon = True
    limit.start()
    out = run_stages(spark, transactions(spark, sf_dir), params, timings=timings, upto=int(os.environ.get("BENCH_UPTO", "8")))
    limit.cancel()
    done = line({}, True)
    rows = {k: v.count() for k, v in out.items() if k in ("transactions_clean", "customer_segments")}
    print(json.dumps({**json.loads(done), "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the registered queries; prints one JSON line.

Each query runs in full and its rows are thrown away by the ``noop`` sink.
BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names) choose what
runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.registry import QUERIES
from marginalia.session import build_session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start Python workers and warm the code generator outside the clock.
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().mapInArrow(lambda it: it, "k long, count long").collect()
    seconds: dict[str, float] = {}
    for name in names.split(",") if names else QUERIES:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()

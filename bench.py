"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barloom.catalogue import ENTRIES
from barloom.catalogue.headline import HEADLINE
from barloom.session import local_session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="barloom-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    runs = {name: ENTRIES[name][0] for name in HEADLINE if name in ENTRIES} | {
        name: run for name, run in HEADLINE.items() if run is not None
    }
    seconds = {}
    for name, run in runs.items():
        begin = time.perf_counter()
        run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

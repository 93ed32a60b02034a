"""Wall-clock seconds of the catalogue queries, each run once to warm up and then timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rowmill.plans.catalogue import CATALOGUE
from rowmill.session import get_session, register_views


def main() -> None:
    root, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    register_views(spark, root)
    seconds = {}
    for name, sql in CATALOGUE.items():
        for _ in range(2):
            began = time.monotonic()
            spark.sql(sql).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.monotonic() - began, 4)
    print(json.dumps({"metric": "catalogue_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": root.rstrip("/").rpartition("sf")[2], "warm": True}))


if __name__ == "__main__":
    main()

"""Headline queries, timed. Prints one JSON line.

Each query runs in its own fresh study, so its time covers everything from the ticks on
(shared tables included), after one warm-up query that starts the session's code paths.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose input and cores; ``BENCH_COPIES`` > 1 replicates
the ticks under new symbols for a load test.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pitbars.plans import catalog  # noqa: E402
from pitbars.plans.present import present  # noqa: E402
from pitbars.session import build_session  # noqa: E402

HEADLINE = (
    "tick_bars",
    "rollup_anchored",
    "swings",
    "gaps",
    "regime_breaks",
    "sweeps",
    "level_zones",
    "order_blocks",
    "zone_signals",
    "bracket",
    "protected_bracket",
    "entry_funnel",
    "threshold_grid",
    "forward_returns",
    "scope_metrics",
    "bootstrap_ci",
    "reconcile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def fresh() -> catalog.EventStudy:
        study = catalog.study(spark, sf_dir, fresh=True)
        if copies > 1:
            study.ticks = study.ticks.repartition(int(cpus)).withColumn(
                "_n", F.explode(F.sequence(F.lit(1), F.lit(copies)))
            ).withColumn("symbol", F.concat_ws("#", "symbol", "_n")).drop("_n")
        return study

    def run(name: str) -> float:
        fn, spec = catalog.CATALOG[name]
        start = time.perf_counter()
        present(fn(fresh()), spec).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("regime_breaks")
    took = {name: run(name) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "copies": copies,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

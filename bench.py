"""Headline queries, timed: prints one JSON line.

Stages that a deployment runs once per table (log, scorer, frozen reference, state) are timed on
their own; queries are then timed on top of the frozen tables, as a user would run them.
"""

from __future__ import annotations

import json
import os
import tempfile
import time


def main() -> None:
    from pyspark.sql import SparkSession

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-", dir="/tmp"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from stillvalid.plans import registry
    from stillvalid.plans.contest import contest
    from stillvalid.plans.monitor import monitor
    from stillvalid.plans.specs import EVENTS, LINES
    from stillvalid.plans.targets_queries import GAP

    # JVM start is not part of any stage.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        t = time.time()
        run()
        times[name] = round(time.time() - t, 3)

    for spec in (EVENTS, LINES):
        m = monitor(spark, folder, spec)
        timed(f"build_{spec.name}_log", lambda: m.rows)
        timed(f"build_{spec.name}_risk_and_origins", lambda: m.origins)
        if spec.features:
            timed(f"build_{spec.name}_reference", lambda: (m.reference_behaviour, m.geometry,
                                                           m.embedding_reference))
        timed(f"build_{spec.name}_state", lambda: m.states)
        c = contest(m, GAP)
        timed(f"contest_{spec.name}_risk_path", lambda: c.forecasts)
        timed(f"contest_{spec.name}_survival", lambda: c.reference_curves)
    for name in ("t2_time_to_violation", "l4_window_risk", "s1_prediction_block",
                 "s14_uncertainty", "s23_stability_index", "s26_feedback", "m8_kaplan_meier",
                 "m11_cox", "m13_discrete_hazard", "m15_first_passage", "e1_horizon_scores",
                 "e5_brier", "e7_concordance", "e9_d_calibration", "e18_blocked_bootstrap",
                 "e19_comparison", "x2_covariate", "x5_prior", "r2_tumbling_risk"):
        timed(name, lambda: registry.QUERIES[name](spark, folder).write.format("noop").mode(
            "overwrite").save())
    print(json.dumps({"metric": "total wall time of build stages and headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

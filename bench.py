"""Headline timings: ``python bench.py`` prints one JSON line.

Each query is timed from its inputs: ``analysis`` rebuilds every shared table of the analysis
(gating, reductions, features, traffic) and scores all candidates from scratch; the others run on
the shared tables it leaves behind. One small run before the clock starts loads the JVM.
"""

from __future__ import annotations

import json
import os
import time

from netsift.plans.detection import detect
from netsift.session import build_session
from workload import queries as wq
from workload import queries_more as wm
from workload.tables import flows

DETECTORS = list(wq.DETECTOR_QUERIES)


def timed(fn) -> float:
    started = time.time()
    fn()
    return round(time.time() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    times["flow_table"] = timed(lambda: flows(spark, sf_dir))
    warm = wq.context(spark, sf_dir, fresh=True).prepare()
    run(wq.scored_table(warm))

    state: dict = {}

    def analysis() -> None:
        ctx = wq.context(spark, sf_dir, fresh=True).prepare()
        state["ctx"] = ctx
        run(wq.candidate_scores(ctx))

    times["analysis"] = timed(analysis)
    wq._CONTEXTS[(spark.sparkContext.applicationId, sf_dir)] = state["ctx"]
    for key in DETECTORS:
        name = wq.DETECTOR_QUERIES[key][0]
        times[key] = timed(lambda name=name: run(detect(state["ctx"], name)))
    extra = wm.more_queries()
    for key in ("prefilter", "guidance_weights", "traffic_buckets", "flow_filter_groups", "workflow_counts",
                "ti_priority", "packets_to_flows", "packet_dedup", "packet_cap", "confusion_matrix",
                "payload_features"):
        times[key] = timed(lambda key=key: run(extra[key](spark, sf_dir)))
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "all_detectors_sec": round(sum(times[k] for k in DETECTORS), 3),
            }
        )
    )


if __name__ == "__main__":
    main()

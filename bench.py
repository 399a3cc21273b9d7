"""Headline flows at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run twice; ``queries`` holds the second time and
``cold`` the first.  Results go to Spark's no-op sink, so every row is made.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries as q  # noqa: E402
from checks.views import milestone_events  # noqa: E402
from tracewing.operators import jsonld, learning  # noqa: E402
from tracewing.plans import flows  # noqa: E402
from tracewing.session import build_session, clear_scratch, scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

PLAIN = (
    "prepare_events", "impute_delivery", "attach_key_id", "hours_to_next", "hot_waybill_durations",
    "irregularity_features", "pod_features", "shipment_rollup", "classification_metrics", "ranking_metrics",
    "shipment_jsonld", "event_jsonld_predicted", "publish_outbox", "train_gbt", "train_forest", "tune_forest",
    "jsonld_ref_join", "permutation_importance", "train_gbt_regressor", "publish_all_kinds", "jsonld_contexts",
)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    events = milestone_events(spark, SF_DIR)
    model = flows.train_irregularity(events, q.KEYS, learning.boosted_classifier(), q.TIES).model
    documents = scratch_path(spark, "documents")
    q._all_documents(spark, SF_DIR).write.parquet(documents)

    runs = {name: lambda name=name: q.QUERIES[name](spark, SF_DIR) for name in PLAIN}
    runs["score_irregularity"] = lambda: flows.score_irregularity(events, model, q.TIES)
    runs["flatten_documents"] = lambda: jsonld.flatten_documents(spark.read.parquet(documents))

    cold, warm = {}, {}
    for name, run in runs.items():
        for times in (cold, warm):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "cold": cold, "sf": Path(SF_DIR).name.removeprefix("sf"), "cpus": int(CPUS),
            }
        )
    )
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()

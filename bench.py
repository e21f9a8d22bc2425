"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and print one line of JSON.

Every query is built and run whole (its plan included) into a sink that discards the rows: once to
warm up, once timed. `ingest_messages` and `replay_messages` are the stream consumer end to end,
with messages per second next to the published 6,800 of a first ingestion.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcelspan.operators.contracts import classify  # noqa: E402
from parcelspan.plans.inputs import Inputs  # noqa: E402
from parcelspan.plans.registry import all_queries  # noqa: E402
from parcelspan.plans.streams import archived_topic, ingested  # noqa: E402
from parcelspan.session import build_session, run_folder  # noqa: E402

HEADLINE = (
    "kpi_route_duration", "kpi_by_wave", "kpi_segments", "on_time_share", "delay_vs_plan", "fuel_consumption",
    "idle_minutes", "weather_asof", "latest_per_key", "plan_stops_orders", "point_in_polygon", "nearest_zone",
    "interval_membership", "track_resample", "traffic_factor", "forward_fill", "largest_remainder", "dhondt",
    "sweep_rank", "capacity_slices", "order_ids", "insert_if_absent", "content_checksum", "fct_route", "fct_delivery",
    "note_context", "dq_report", "plan_report", "door_sessions", "candidate_weights", "stratified_sample",
)


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        discard(queries[name](spark, folder))
        seconds[name] = timed(lambda name=name: discard(queries[name](spark, folder)))

    t = Inputs(spark, folder)
    # A topic has many partitions; the test table is one small file.
    topic = archived_topic(t, t.envelopes().repartition(int(cpus)))
    messages = spark.read.parquet(topic).count()
    contract = lambda: discard(classify(spark.read.parquet(topic), t.sources()))
    contract()
    seconds["contract_classify"] = timed(contract)
    ingested(t, topic, run_folder(spark, "bench-warm"))
    target = run_folder(spark, "bench-bronze")
    seconds["ingest_messages"] = timed(lambda: ingested(t, topic, target))
    seconds["replay_messages"] = timed(lambda: ingested(t, topic, target))

    # The mix of a working day, nearly all of it valid, in eight batches; each comes from as many partitions of the topic as there are cores.
    mixed = archived_topic(t, t.mixed_envelopes().repartition(int(cpus)), 8)
    target = run_folder(spark, "bench-mixed")
    seconds["ingest_mixed"] = timed(lambda: ingested(t, mixed, target, files_per_batch=int(cpus)))

    rates = {f"{n}_per_s": round(messages / seconds[n]) for n in ("contract_classify", "ingest_messages", "replay_messages", "ingest_mixed")}
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "messages": messages, **rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

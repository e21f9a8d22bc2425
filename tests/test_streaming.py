"""The stream consumer: repeats, failures, restarts, late registrations; and batch equals stream."""

import json

import pytest
from pyspark.sql import functions as F

from parcelspan.operators.contracts import ENVELOPE
from parcelspan.sources.topics import envelope_files
from parcelspan.streaming.ingest import start_ingest, write_batch
from parcelspan.streaming.progress import lag_rows


def ping(offset, minute, source="simulator/gps", topic="gps.pings", **more):
    value = {"vehicle_id": "V-1", "event_time": f"2026-09-28T06:{minute:02d}:00Z", "source": source, "schema_version": 1, **more}
    return (topic, 0, offset, b"V-1", json.dumps(value).encode(), None)


def sources(spark, *names):
    return spark.createDataFrame([(n,) for n in names or ("simulator/gps",)], "source_id string")


def envelopes(spark, *rows):
    return spark.createDataFrame(list(rows), ENVELOPE)


def table(spark, target, name):
    return spark.read.parquet(f"{target}/{name}")


def test_first_of_repeated_rows_stays(spark, tmp_path):
    target = str(tmp_path / "bronze")
    write_batch(envelopes(spark, ping(5, 1, lat=5.0), ping(3, 1, lat=3.0), ping(9, 2, lat=9.0)), sources(spark), target, "run", 0)
    write_batch(envelopes(spark, ping(20, 1, lat=20.0), ping(21, 3, lat=21.0)), sources(spark), target, "run", 1)
    assert sorted(r["lat"] for r in table(spark, target, "gps_pings").collect()) == [3.0, 9.0, 21.0]
    counters = {r["batch_id"]: (r["messages"], r["inserted"], r["duplicates"]) for r in table(spark, target, "ingest_counters").collect()}
    assert counters == {0: (3, 2, 1), 1: (2, 1, 1)}


def test_batch_run_again_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "bronze")
    rows = [ping(1, 1), ping(2, 2), ("gps.pings", 0, 3, None, b"broken", None), ("gps.pings", 0, 4, None, None, None)]
    for _ in range(2):
        write_batch(envelopes(spark, *rows), sources(spark), target, "run", 0)
    assert table(spark, target, "gps_pings").count() == 2
    assert sorted(r["reason"] for r in table(spark, target, "dead_letters").collect()) == ["empty_message", "invalid_json"]
    write_batch(envelopes(spark, *rows), sources(spark), target, "another run", 0)
    assert table(spark, target, "gps_pings").count() == 2 and table(spark, target, "dead_letters").count() == 2


def test_bad_rows_do_not_block_a_batch(spark, tmp_path):
    target = str(tmp_path / "bronze")
    write_batch(envelopes(spark, ping(1, 1, note="a\u0000b"), ping(2, 2)), sources(spark), target, "run", 0)
    assert table(spark, target, "gps_pings").count() == 1
    assert table(spark, target, "dead_letters").first()["reason"] == "rejected_by_database"


def test_days_beyond_the_pruning_limit(spark, tmp_path, monkeypatch):
    from parcelspan.streaming import ingest

    target = str(tmp_path / "bronze")
    days = [ping(i, 0, event_time=f"2026-09-0{i + 1}T00:00:00Z") for i in range(5)]
    write_batch(envelopes(spark, *days), sources(spark), target, "run", 0)
    write_batch(envelopes(spark, *days), sources(spark), target, "run", 1)
    assert table(spark, target, "gps_pings").count() == 5


def test_restart_goes_on_and_knows_new_sources(spark, tmp_path):
    target, topic, checkpoint = (str(tmp_path / n) for n in ("bronze", "topic", "checkpoint"))
    known = ["simulator/gps"]

    def run():
        stream = envelope_files(spark, topic)
        start_ingest(stream, lambda s: sources(s, *known), target, checkpoint).awaitTermination()

    envelopes(spark, ping(1, 1), ping(2, 2, source="simulator/drone")).write.parquet(topic)
    run()
    known.append("simulator/drone")
    envelopes(spark, ping(3, 3, source="simulator/drone")).write.mode("append").parquet(topic)
    run()
    assert sorted(r["source"] for r in table(spark, target, "gps_pings").collect()) == ["simulator/drone", "simulator/gps"]
    assert table(spark, target, "dead_letters").count() == 1
    assert table(spark, target, "ingest_counters").agg(F.sum("messages")).first()[0] == 2


def test_three_topics_go_to_their_tables(spark, tmp_path):
    target = str(tmp_path / "bronze")
    event = {"event_id": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "order_id": "O-1"}
    rows = [
        ping(1, 1), ping(2, 1, topic="vehicle.telemetry", odometer_km=3), ping(3, 1, topic="delivery.events", **event),
        ping(4, 9, topic="delivery.events", **event), ping(5, 1, topic="orders.created"),
    ]
    write_batch(envelopes(spark, *rows), sources(spark), target, "run", 0)
    counts = {n: table(spark, target, n).count() for n in ("gps_pings", "vehicle_telemetry", "delivery_events", "dead_letters")}
    assert counts == {"gps_pings": 1, "vehicle_telemetry": 1, "delivery_events": 1, "dead_letters": 1}
    assert str(table(spark, target, "delivery_events").first()["event_time"]) == "2026-09-28 06:01:00"


def test_many_unknown_topics_hide_no_rows(spark, tmp_path):
    for unknown in (3, 60):
        target = str(tmp_path / f"bronze{unknown}")
        rows = [ping(i, 1, topic=f"other.{i}") for i in range(unknown)] + [ping(100 + i, i) for i in range(5)]
        write_batch(envelopes(spark, *rows).repartition(7), sources(spark), target, "run", 0)
        assert table(spark, target, "dead_letters").count() == unknown
        assert table(spark, target, "gps_pings").count() == 5
        assert [tuple(r)[:2] for r in table(spark, target, "ingest_batches").select("n_rows", "n_dead").collect()] == [(unknown + 5, unknown)]


def test_streams_read_tables_of_many_files(spark, folder, tmp_path):
    from parcelspan.plans.registry import all_queries

    for name in ("events", "nation"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        df.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_tally", "stream_daily_tally"):
        parts, whole = (all_queries()[name](spark, f).collect() for f in (str(tmp_path), folder))
        assert sorted(map(tuple, parts)) == sorted(map(tuple, whole)) and whole


def test_lag_of_a_broker_source():
    progress = {
        "timestamp": "2026-09-28T06:00:00Z",
        "sources": [{"endOffset": '{"gps.pings":{"0":10,"1":7}}', "latestOffset": '{"gps.pings":{"0":15,"1":7,"2":3}}'}],
    }
    assert [(r[2], r[3], r[4], r[5]) for r in lag_rows(progress, "g")] == [(0, 10, 15, 5), (1, 7, 7, 0), (2, None, 3, 3)]
    low = {"gps.pings": {"0": 12, "2": 1}}
    assert [r[5] for r in lag_rows(progress, "g", low)] == [3, 0, 2]


@pytest.mark.parametrize("stream,batch", [("stream_departures", "departed_at"), ("stream_tally", "completed_at")])
def test_stream_equals_batch(spark, folder, stream, batch):
    from parcelspan.plans.registry import all_queries

    kpi = {r["route_id"]: r[batch] for r in all_queries()["kpi_route_duration"](spark, folder).collect()}
    run = {r["route_id"]: r[batch] for r in all_queries()[stream](spark, folder).collect()}
    assert kpi and all(run[k] == v for k, v in kpi.items())


@pytest.mark.parametrize("name, batches", [("stream_progress", 3), ("ingest_mixed_topics", 3), ("stream_dedupe", 2)])
def test_batches_follow_the_turns_of_an_archive_and_not_its_files(spark, folder, tmp_path, monkeypatch, name, batches):
    import shutil

    from parcelspan.plans import streams
    from parcelspan.plans.registry import all_queries

    here = tmp_path / "tables"
    shutil.copytree(folder, here)
    events = spark.read.parquet(f"{folder}/events.parquet")
    (here / "events.parquet").unlink()
    events.repartition(4).write.parquet(str(here / "events.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # files are small, and each is read by a task of its own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    targets, folder_of = [], streams.run_folder
    monkeypatch.setattr(streams, "run_folder", lambda s, kind: targets.append((kind, folder_of(s, kind))) or targets[-1][1])
    try:
        all_queries()[name](spark, str(here)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = dict(targets)
    assert len(spark.read.parquet(made["topic"]).inputFiles()) >= 8
    log = spark.read.parquet(f"{made['bronze']}/ingest_batches").where("n_rows > 0")
    assert log.count() <= batches

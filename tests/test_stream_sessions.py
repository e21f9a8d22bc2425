"""Stop sessions from hourly statements against a plain walk, whatever the order in which readings arrive."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parcelspan.session import prepare, run_folder
from parcelspan.streaming import sessions
from parcelspan.streaming.routes import current, start_updates
from parcelspan.streaming.sessions import hourly_runs, joined_runs

SCHEMA = "van string, at timestamp_ntz, open boolean, hour int"


def walked(readings):
    out = []
    for van in {r[0] for r in readings}:
        mine, run = sorted((r[1], bool(r[2])) for r in readings if r[0] == van and r[1]), None
        for i, (at, on) in enumerate(mine):
            if on:
                run = run or [van, at, at, 0]
                run[2:] = mine[i + 1][0] if i + 1 < len(mine) else at, run[3] + 1
            if run and (not on or i == len(mine) - 1):
                out.append(tuple(run))
                run = None
    return sorted(out)


def test_late_files_equal_a_plain_walk(spark):
    rng, start = random.Random(3), datetime(2026, 3, 28, 22)
    readings = [
        (f"V{v}", start + timedelta(seconds=s), rng.choice([True, True, False, None]), 0)
        for v in range(4) for s in rng.sample(range(40_000), 150)
    ]
    # A door open for hours, one reading alone, hours without any, and readings without a time.
    readings += [("long", start + timedelta(minutes=25 * i), True, 0) for i in range(30)] + [("one", start, True, 0), ("V1", None, True, 0)]
    rng.shuffle(readings)
    path, out, checkpoint = (run_folder(spark, n) for n in ("readings", "runs", "checkpoint"))
    for part in range(3):
        spark.createDataFrame(readings[part::3], SCHEMA).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        start_updates(hourly_runs(stream, ["van"], "at", F.col("open")), out, checkpoint).awaitTermination()
        hours = current(spark.read.parquet(out), ["van", "hour"])
        given = [r for p in range(part + 1) for r in readings[p::3]]
        for max_rows in (10**9, 20):
            got = joined_runs(hours, ["van"], max_rows).select("van", F.col("opened_at").cast("timestamp_ntz"), F.col("closed_at").cast("timestamp_ntz"), "readings")
            assert sorted(map(tuple, got.collect())) == walked(given)


def test_state_is_kept_as_changes(spark, tmp_path):
    """Batches commit what they changed, without files of the whole store; the query goes on from them as from those."""
    prepare(spark)
    path, out, checkpoint = (f"{tmp_path}/{n}" for n in ("readings", "runs", "checkpoint"))
    start = datetime(2026, 3, 28, 22)
    for turn in range(3):
        rows = [("V", start + timedelta(minutes=10 * turn), True, 0), (f"W{turn}", start, True, 0)]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        start_updates(hourly_runs(stream, ["van"], "at", F.col("open")), out, checkpoint).awaitTermination()
    found = [f.name for f in (tmp_path / "checkpoint" / "state").rglob("*") if not f.name.startswith(".")]
    assert any(f.endswith(".changelog") for f in found)
    got = joined_runs(current(spark.read.parquet(out), ["van", "hour"]), ["van"]).where("van = 'V'").collect()
    assert [(r.readings, r.closed_at - r.opened_at) for r in got] == [(3, timedelta(minutes=20))]


def test_ordered_work_reads_written_hours(spark, monkeypatch):
    """The hours are worked out once, although ordered work measures its keys before it begins."""
    hours = spark.createDataFrame(
        [("V", datetime(2026, 3, 28, 22), datetime(2026, 3, 28, 22), False, [])],
        "van string, hour timestamp, first_at timestamp, open boolean, runs array<struct<opened_at:timestamp,last_at:timestamp,next_at:timestamp,readings:bigint,first:boolean>>",
    )
    seen, plain = [], sessions.annotate
    monkeypatch.setattr(sessions, "annotate", lambda df, *rest: seen.append(df.inputFiles()) or plain(df, *rest))
    assert sessions.joined_runs(hours, ["van"]).collect() == []
    assert len(seen) == 2 and all(f.endswith(".parquet") for files in seen for f in files) and seen[0]

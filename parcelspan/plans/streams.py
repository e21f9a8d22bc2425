"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspan.operators.contracts import ENVELOPE
from parcelspan.plans.inputs import Inputs, ping_columns, scan_columns, telemetry_columns
from parcelspan.plans.kpi import DURATIONS_SQL, FINAL, HAVERSINE, completions, departures, duration_windows, durations
from parcelspan.plans.registry import query
from parcelspan.session import run_folder
from parcelspan.sources.topics import envelope_files
from parcelspan.streaming.ingest import start_ingest
from parcelspan.streaming.progress import COUNTERS, progress_rows
from parcelspan.streaming.routes import current, daily_tally, start_updates, wave_windows
from parcelspan.streaming.sessions import hourly_runs, joined_runs


def archived_topic(t: Inputs, envelopes: DataFrame, times: int = 1) -> str:
    """The messages as files of a topic's archive, written by offset in `times` turns of as many files as Spark makes."""
    path = run_folder(t.spark, "topic")
    for turn in range(times):
        envelopes.where(F.pmod("offset", F.lit(times)) == turn).write.mode("append").parquet(path)
    return path


def files_of_a_turn(t: Inputs, topic: str, times: int) -> int:
    """How many files one of `times` turns of an archive holds. A batch of as many is read by as many tasks, and a topic of any size takes
    about as many batches as it was written in turns: with a file a batch, one task would read each, and every batch asks all of the state."""
    return max(1, -(-len(t.spark.read.schema(ENVELOPE).parquet(topic).inputFiles()) // times))


def ingested(t: Inputs, topic: str, target: str, files_per_batch: int | None = None):
    """Run an ingest from an empty checkpoint until everything there is written."""
    stream = envelope_files(t.spark, topic, files_per_batch)
    run = start_ingest(stream, lambda _: t.sources(), target, run_folder(t.spark, "checkpoint"))
    run.awaitTermination()
    return run


def event_stream(t: Inputs) -> DataFrame:
    """The events as a stream of files, one or many: a pattern, because a stream takes no single file by its name."""
    return t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.folder}/events.parque[t]")


def late_event_streams(t: Inputs) -> Iterator[DataFrame]:
    """The stream of events each time a quarter of their days has arrived, the newest first, in as many files as Spark makes. Run to its end each
    time with one checkpoint, a query carries its state over, and most files are late."""
    path, day = run_folder(t.spark, "late"), F.dayofmonth(F.col("ts").cast("date"))
    events = t.table("events")
    for part in range(3, -1, -1):
        events.where(F.least(F.floor((day - 1) / 8), F.lit(3)) == part).write.mode("append").parquet(path)
        yield t.spark.readStream.schema(events.schema).parquet(path)


@query("scan_topic_stream", "SELECT topic, kafka_partition AS partition, kafka_offset AS \"offset\", ts AS timestamp FROM v_messages")
def scan_topic_stream(t: Inputs) -> DataFrame:
    """All messages of a topic's archive, once each, by a stream that starts at the oldest."""
    out = run_folder(t.spark, "copied")
    stream = envelope_files(t.spark, archived_topic(t, t.envelopes()))
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", run_folder(t.spark, "checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("topic", "partition", "offset", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("stream_classify", """SELECT topic, coalesce(expected_reason, 'gps_pings') AS outcome, count(*) AS n FROM v_messages GROUP BY 1, 2""")
def stream_classify(t: Inputs) -> DataFrame:
    """Rows and dead letters of one stream, written in the same batches."""
    target = run_folder(t.spark, "bronze")
    ingested(t, archived_topic(t, t.envelopes()), target)
    dead = t.spark.read.parquet(f"{target}/dead_letters").select("topic", F.col("reason").alias("outcome"))
    rows = t.spark.read.parquet(f"{target}/gps_pings").select(F.lit("gps.pings").alias("topic"), F.lit("gps_pings").alias("outcome"))
    return dead.unionByName(rows).groupBy("topic", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("replay_noop", """SELECT CAST(run AS INT) AS run, count(*) AS messages, CASE WHEN run = 1 THEN count(*) ELSE 0 END AS inserted, CASE WHEN run = 2 THEN count(*) ELSE 0 END AS duplicates
FROM v_messages JOIN (VALUES (1), (2)) r(run) ON expected_reason IS NULL GROUP BY run""")  # fmt: skip
def replay_noop(t: Inputs) -> DataFrame:
    """A topic read twice from the start: the second reading inserts nothing."""
    target, topic = run_folder(t.spark, "bronze"), archived_topic(t, t.envelopes())
    runs = [ingested(t, topic, target).id for _ in range(2)]
    counters = t.spark.read.parquet(f"{target}/ingest_counters")
    number = F.when(F.col("run_id") == str(runs[0]), 1).otherwise(2)
    return counters.groupBy(number.alias("run")).agg(*[F.sum(c).alias(c) for c in ("messages", "inserted", "duplicates")])


@query("stream_dedupe", "SELECT vehicle_id, ts AS event_time FROM v_messages WHERE expected_reason IS NULL")
def stream_dedupe(t: Inputs) -> DataFrame:
    """Messages delivered again under later offsets are written once, however far apart they are."""
    target = run_folder(t.spark, "bronze")
    again = t.envelopes().withColumn("offset", F.col("offset") + (1 << 40))
    topic = archived_topic(t, t.envelopes().unionByName(again))
    ingested(t, topic, target, files_of_a_turn(t, topic, 2))
    return t.spark.read.parquet(f"{target}/gps_pings").select(
        "vehicle_id", F.col("event_time").cast("timestamp_ntz").alias("event_time")
    )


@query("ingest_mixed_topics", """SELECT 'gps_pings' AS table_name, count(*) AS n, CAST(sum(event_id % 90) AS DOUBLE) AS amount, 0 AS flagged FROM events WHERE event_id % 100 < 82
UNION ALL SELECT 'vehicle_telemetry', count(*), sum(CAST(floor(event_id / 8) AS DOUBLE) + 0.5 + event_id % 1000 + 0.25), count(*) FILTER (event_id % 3 <> 0) FROM events WHERE event_id % 100 BETWEEN 82 AND 95
UNION ALL SELECT 'delivery_events', count(*), CAST(sum(event_id % 70) AS DOUBLE), count(*) FILTER (event_id % 2 = 0) FROM events WHERE event_id % 100 BETWEEN 96 AND 98
UNION ALL SELECT 'dead_letters', count(*), 0.0, count(*) FROM events WHERE event_id % 100 = 99""")  # fmt: skip
def ingest_mixed_topics(t: Inputs) -> DataFrame:
    """All three topics and many that nobody reads in one stream, in several batches: every table typed and complete."""
    target = run_folder(t.spark, "bronze")
    topic = archived_topic(t, t.mixed_envelopes(), 3)
    ingested(t, topic, target, files_of_a_turn(t, topic, 3))
    read = lambda name: t.spark.read.parquet(f"{target}/{name}")
    figures = {
        "gps_pings": (F.sum(F.col("speed_kmh").cast("double")), F.lit(0)),
        "vehicle_telemetry": (F.sum((F.col("odometer_km") + F.col("energy_used_total")).cast("double")), F.count_if("ignition_on")),
        "delivery_events": (
            F.sum(F.col("stop_sequence").cast("double")),
            F.count_if((F.col("status") == "delivered") & F.col("event_id").rlike("^00000000-0000-4000-8000-[0-9]{12}$")),
        ),
        "dead_letters": (F.lit(0.0), F.count_if(F.col("reason") == "unknown_topic")),
    }
    rows = [
        read(name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), amount.alias("amount"), flagged.cast("bigint").alias("flagged"))
        for name, (amount, flagged) in figures.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("late_rows_kept", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM v_messages WHERE expected_reason IS NULL GROUP BY 1")
def late_rows_kept(t: Inputs) -> DataFrame:
    """The second half of the month arrives first; the rows of the first half are late and all kept."""
    target = run_folder(t.spark, "bronze")
    late = F.col("timestamp") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    for part in (t.envelopes().where(~late), t.envelopes().where(late)):
        ingested(t, archived_topic(t, part), target)
    rows = t.spark.read.parquet(f"{target}/gps_pings")
    return rows.groupBy(F.col("event_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_progress", "SELECT count(*) AS n_rows FROM v_messages")
def stream_progress(t: Inputs) -> DataFrame:
    """What the batches of a stream report to have read, one turn of the topic's archive at a time."""
    target = run_folder(t.spark, "bronze")
    topic = archived_topic(t, t.envelopes(), 3)
    ingested(t, topic, target, files_of_a_turn(t, topic, 3))
    return progress_rows(t.spark, target).agg(F.sum("n_rows").alias("n_rows"))


@query("stream_departures", f"SELECT p.route_id, min(p.event_time) AS departed_at FROM v_pings p JOIN v_hub h USING (hub_id) WHERE {HAVERSINE} > h.radius_m GROUP BY 1")
def stream_departures(t: Inputs) -> DataFrame:
    """The departure of every route as the pings come in, equal to what the batch query finds."""
    out, checkpoint = run_folder(t.spark, "departures"), run_folder(t.spark, "checkpoint")
    for events in late_event_streams(t):
        start_updates(departures(ping_columns(events), t.hub()), out, checkpoint).awaitTermination()
    return current(t.spark.read.parquet(out), ["route_id"])


@query("stream_kpi_windows", f"""WITH {DURATIONS_SQL} SELECT CAST(CAST(completed_at AS DATE) AS VARCHAR) AS day, wave, count(*) AS routes, round(avg(minutes), 6) AS avg_minutes
FROM k JOIN v_routes USING (route_id) GROUP BY 1, 2""")  # fmt: skip
def stream_kpi_windows(t: Inputs) -> DataFrame:
    """The KPI of each day and wave from two running streams over late files: late days are stated again, as the batch query has them."""
    left, done = run_folder(t.spark, "departures"), run_folder(t.spark, "tally")
    checkpoints = run_folder(t.spark, "checkpoint"), run_folder(t.spark, "checkpoint")
    for events in late_event_streams(t):
        start_updates(departures(ping_columns(events), t.hub()), left, checkpoints[0]).awaitTermination()
        start_updates(completions(scan_columns(events)), done, checkpoints[1]).awaitTermination()
    running = durations(current(t.spark.read.parquet(left), ["route_id"]), current(t.spark.read.parquet(done), ["route_id"]))
    return duration_windows(running.join(t.routes(), "route_id"))


@query("stream_wave_windows", """SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS day, wave, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'failed') AS failed
FROM v_scans JOIN v_routes USING (route_id) WHERE status IN ('delivered', 'failed') GROUP BY 1, 2""")  # fmt: skip
def stream_wave_windows(t: Inputs) -> DataFrame:
    """Final scans of each day and wave so far, by windows of event time; scans meet the table of routes in the stream."""
    out, checkpoint = run_folder(t.spark, "waves"), run_folder(t.spark, "checkpoint")
    for events in late_event_streams(t):
        start_updates(wave_windows(scan_columns(events), t.routes()), out, checkpoint).awaitTermination()
    return current(t.spark.read.parquet(out), ["day", "wave"])


@query("stream_tally", """SELECT route_id, max(event_time) AS completed_at, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'failed') AS failed
FROM v_scans WHERE status IN ('delivered', 'failed') GROUP BY 1""")  # fmt: skip
def stream_tally(t: Inputs) -> DataFrame:
    """Completion and running counts of every route as the scans come in."""
    out = run_folder(t.spark, "tally")
    start_updates(completions(scan_columns(event_stream(t))), out, run_folder(t.spark, "checkpoint")).awaitTermination()
    return current(t.spark.read.parquet(out), ["route_id"])


@query("stream_daily_tally", f"""SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS day, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'failed') AS failed
FROM v_scans WHERE status IN {FINAL!r} GROUP BY 1""")  # fmt: skip
def stream_daily_tally(t: Inputs) -> DataFrame:
    out, checkpoint = run_folder(t.spark, "daily"), run_folder(t.spark, "checkpoint")
    for events in late_event_streams(t):
        start_updates(daily_tally(scan_columns(events)), out, checkpoint).awaitTermination()
    return current(t.spark.read.parquet(out), ["day"])


@query("stream_door_sessions", """WITH m AS (SELECT vehicle_id, event_time, cargo_door_open AS o, coalesce(lag(cargo_door_open) OVER w, false) AS was, lead(event_time) OVER w AS nxt FROM v_telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_time)),
s AS (SELECT *, sum(CASE WHEN o AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY event_time) AS k FROM m)
SELECT vehicle_id, min(event_time) AS opened_at, max(coalesce(nxt, event_time)) AS closed_at, count(*) AS readings FROM s WHERE o GROUP BY vehicle_id, k""")  # fmt: skip
def stream_door_sessions(t: Inputs) -> DataFrame:
    """How long the cargo door stayed open at each stop, from a stream most of whose files are late: what the batch query finds."""
    out, checkpoint = run_folder(t.spark, "doors"), run_folder(t.spark, "checkpoint")
    for events in late_event_streams(t):
        readings = telemetry_columns(events)
        start_updates(hourly_runs(readings, ["vehicle_id"], "event_time", F.col("cargo_door_open")), out, checkpoint).awaitTermination()
    runs = joined_runs(current(t.spark.read.parquet(out), ["vehicle_id", "hour"]), ["vehicle_id"])
    return runs.select("vehicle_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened_at", "closed_at")], "readings")


@query("stream_newest", """WITH f AS (SELECT CASE WHEN event_id % 100 < 82 THEN 'gps_pings' WHEN event_id % 100 < 96 THEN 'vehicle_telemetry' WHEN event_id % 100 < 99 THEN 'delivery_events' END AS table_name, ts FROM events)
SELECT table_name, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS duplicates, max(ts) AS newest FROM f WHERE table_name IS NOT NULL GROUP BY 1""")  # fmt: skip
def stream_newest(t: Inputs) -> DataFrame:
    """What the listener of an ingest wrote while it ran, stopped and went on: messages, rows and repeats of each table, and its newest event."""
    target, checkpoint, topic = run_folder(t.spark, "bronze"), run_folder(t.spark, "checkpoint"), run_folder(t.spark, "topic")
    for half in range(2):
        t.mixed_envelopes().where(F.col("offset") % 2 == half).write.mode("append").parquet(topic)
        start_ingest(envelope_files(t.spark, topic), lambda _: t.sources(), target, checkpoint).awaitTermination()
    counters = t.spark.read.schema(COUNTERS).parquet(f"{target}/ingest_counters")
    sums = [F.sum(c).alias(c) for c in ("messages", "inserted", "duplicates")]
    return counters.groupBy("table_name").agg(*sums, F.max("newest").cast("timestamp_ntz").alias("newest"))

"""Queries on the message contract, the idempotent write and the state of the consumer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspan.operators.contracts import (
    CONTRACTS, GPS_PINGS, check_sources, classify, dead_letters_of, message_json, refuse_unstorable, rows_of,
)
from parcelspan.operators.keyed import absent_rows, first_per_key, latest_per_key
from parcelspan.plans.inputs import Inputs
from parcelspan.plans.registry import query
from parcelspan.session import small_table

ISO = "concat(replace(CAST(ts AS VARCHAR), ' ', 'T'), 'Z')"


def judged(t: Inputs) -> DataFrame:
    return classify(t.envelopes(), t.sources())


@query(
    "envelopes",
    "SELECT topic, kafka_partition AS partition, kafka_offset AS \"offset\", vehicle_id AS key_text, expected_reason IS NOT DISTINCT FROM 'empty_message' AS no_value, ts AS timestamp FROM v_messages",
)
def envelopes(t: Inputs) -> DataFrame:
    return t.envelopes().select(
        "topic", "partition", "offset", F.col("key").cast("string").alias("key_text"),
        F.col("value").isNull().alias("no_value"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
    )


@query("contract_reasons", "SELECT kafka_offset, expected_reason AS reason FROM v_messages")
def contract_reasons(t: Inputs) -> DataFrame:
    return judged(t).select(F.col("offset").alias("kafka_offset"), "reason")


@query(
    "contract_errors",
    """SELECT kafka_offset, CASE expected_reason WHEN 'unknown_topic' THEN 'no table is fed by topic orders.created' WHEN 'empty_message' THEN 'the message has no value'
 WHEN 'invalid_json' THEN 'not JSON' WHEN 'not_an_object' THEN 'an object expected, found an array' WHEN 'missing_field' THEN 'missing event_time'
 WHEN 'unsupported_schema_version' THEN 'schema_version 2 is not among [1]'
 WHEN 'invalid_field' THEN CASE WHEN kafka_offset % 12 = 6 THEN 'event_time: a time without a zone offset'
   ELSE 'lat: a number expected, found a string; heading_deg: an integer expected, found 134.5' END
 WHEN 'unknown_source' THEN 'source simulator/drone is not registered' END AS error FROM v_messages WHERE expected_reason IS NOT NULL""",
)
def contract_errors(t: Inputs) -> DataFrame:
    return dead_letters_of(judged(t)).select("kafka_offset", "error")


@query(
    "typed_projection",
    """SELECT kafka_offset, vehicle_id, ts AS event_time, 41.3e0 AS lat, 2.1e0 AS lon, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS speed_kmh,
 'simulator/gps' AS source, 1 AS schema_version FROM v_messages WHERE expected_reason IS NULL""",
)
def typed_projection(t: Inputs) -> DataFrame:
    return rows_of(judged(t), GPS_PINGS).select(
        F.col("offset").alias("kafka_offset"), "vehicle_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        "lat", "lon", F.round(F.col("speed_kmh").cast("double"), 4).alias("speed_kmh"), "source",
        F.col("schema_version").cast("int").alias("schema_version"),
    )


@query(
    "residual_fields",
    "SELECT kafka_offset, concat('{\"satellites\":', CAST(event_id % 15 AS VARCHAR), '}') AS extra_fields FROM v_messages WHERE expected_reason IS NULL",
)
def residual_fields(t: Inputs) -> DataFrame:
    return rows_of(judged(t), GPS_PINGS).select(F.col("offset").alias("kafka_offset"), "extra_fields")


@query(
    "classify_split",
    """SELECT topic, kafka_partition, count(*) FILTER (expected_reason IS NULL) AS n_rows, count(*) FILTER (expected_reason IS NOT NULL) AS n_dead
FROM v_messages GROUP BY 1, 2""",
)
def classify_split(t: Inputs) -> DataFrame:
    return judged(t).groupBy("topic", F.col("partition").alias("kafka_partition")).agg(
        F.count_if(F.col("reason").isNull()).alias("n_rows"), F.count_if(F.col("reason").isNotNull()).alias("n_dead")
    )


STREAMS_SQL = """m AS (SELECT 'gps_pings' AS table_name, event_id FROM v_pings UNION ALL SELECT 'vehicle_telemetry', row_number() OVER () FROM v_telemetry
 UNION ALL SELECT 'delivery_events', event_id FROM v_scans)"""


def three_topics(t: Inputs) -> DataFrame:
    """Valid messages of all three topics as envelopes."""
    p = t.pings().withColumn("source", F.lit("simulator/gps")).withColumn("schema_version", F.lit(1))
    v = t.telemetry().withColumn("source", F.lit("simulator/telemetry")).withColumn("schema_version", F.lit(1))
    s = t.scans().withColumn("source", F.lit("simulator/handheld")).withColumn("schema_version", F.lit(1))
    iso = F.concat(F.replace(F.col("event_time").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))

    def envelope(df: DataFrame, topic: str, columns: list[str], key: str) -> DataFrame:
        shaped = df.withColumn("event_time", iso)
        return shaped.select(
            F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"),
            F.encode(F.col(key).cast("string"), "UTF-8").alias("key"),
            F.encode(message_json(shaped, columns), "UTF-8").alias("value"), F.lit(None).cast("timestamp").alias("timestamp"),
        )

    meta = ["event_time", "source", "schema_version"]
    name = F.format_string("00000000-0000-5000-8000-%012x", F.col("event_id"))
    s = s.withColumn("event_id", name).withColumn("order_id", F.col("order_id").cast("string"))
    return (
        envelope(p, "gps.pings", ["vehicle_id", "route_id", "lat", "lon", "speed_kmh", *meta], "vehicle_id")
        .unionByName(envelope(v, "vehicle.telemetry", ["vehicle_id", "route_id", "speed_kmh", "odometer_km", "energy_used_total", "ignition_on", "cargo_door_open", *meta], "vehicle_id"))
        .unionByName(envelope(s, "delivery.events", ["event_id", "order_id", "route_id", "status", "failure_reason", *meta], "route_id"))
    )


@query(
    "rows_by_table",
    f"WITH {STREAMS_SQL} SELECT table_name, count(*) AS n_rows FROM m GROUP BY 1",
)
def rows_by_table(t: Inputs) -> DataFrame:
    split = classify(three_topics(t), t.sources())
    table = F.coalesce(*[F.when(F.col(c.table).isNotNull(), F.lit(c.table)) for c in CONTRACTS])
    return split.where("reason IS NULL").groupBy(table.alias("table_name")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "dead_letters",
    """SELECT topic, kafka_partition, kafka_offset, vehicle_id AS message_key, expected_reason AS reason, ts AS kafka_timestamp,
 CASE expected_reason WHEN 'empty_message' THEN NULL WHEN 'invalid_json' THEN 8 WHEN 'not_an_object' THEN 6 ELSE -1 END AS payload_bytes
FROM v_messages WHERE expected_reason IS NOT NULL""",
)
def dead_letters(t: Inputs) -> DataFrame:
    short = F.col("reason").isin("empty_message", "invalid_json", "not_an_object")
    return dead_letters_of(judged(t)).select(
        "topic", "kafka_partition", "kafka_offset", F.col("message_key").cast("string").alias("message_key"), "reason",
        F.col("kafka_timestamp").cast("timestamp_ntz").alias("kafka_timestamp"),
        F.when(short, F.octet_length("payload")).otherwise(-1).alias("payload_bytes"),
    )


@query(
    "rejected_rows",
    """SELECT kafka_offset, CASE WHEN event_id % 12 IN (0, 9, 10) AND value > 20 THEN 'rejected_by_database' ELSE expected_reason END AS reason FROM v_messages""",
)
def rejected_rows(t: Inputs) -> DataFrame:
    """Messages whose residual holds a NUL character, which the table would refuse, next to good ones."""
    spiked = t.envelopes().join(
        t.table("events").select(F.col("event_id").alias("offset"), F.col("value").alias("_v")), "offset"
    )
    good = F.col("value").cast("string").contains("satellites") & (F.col("_v") > 20)
    noted = F.concat(F.lit('{"note":"a\\u0000b",'), F.expr("substring(CAST(value AS STRING), 2)"))
    changed = spiked.withColumn("value", F.when(good, F.encode(noted, "UTF-8")).otherwise(F.col("value"))).drop("_v")
    return refuse_unstorable(classify(changed, t.sources())).select(F.col("offset").alias("kafka_offset"), "reason")


def redelivered(t: Inputs) -> DataFrame:
    """The scans as an at-least-once delivery sees them: final scans arrive twice, the second time later."""
    scans = t.scans()
    again = scans.where("status = 'delivered'")
    return scans.withColumn("arrival", F.lit(0)).unionByName(again.withColumn("arrival", F.lit(1)))


@query(
    "insert_if_absent",
    """SELECT event_id, order_id, status, 0 AS arrival FROM v_scans WHERE event_time >= TIMESTAMP '2024-01-10 00:00:00'""",
)
def insert_if_absent(t: Inputs) -> DataFrame:
    """Rows a batch adds to a table that already holds the days before 10 January: repeats inside the
    batch keep their first row, keys the table holds stay as they are."""
    held = t.scans().where("event_time < TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    first = first_per_key(redelivered(t).select("event_id", "order_id", "status", "arrival"), ["event_id"], ["arrival"])
    return absent_rows(first, held, ["event_id"])


@query(
    "insert_counts",
    """SELECT count(*) FILTER (fresh) AS inserted, CAST(sum(copies) AS BIGINT) - count(*) FILTER (fresh) AS duplicates
FROM (SELECT event_time >= TIMESTAMP '2024-01-10 00:00:00' AS fresh, CASE WHEN status = 'delivered' THEN 2 ELSE 1 END AS copies FROM v_scans) s""",
)
def insert_counts(t: Inputs) -> DataFrame:
    """How many messages of a batch were new and how many were already there."""
    held = t.scans().where("event_time < TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id")
    per_key = redelivered(t).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    found = per_key.join(held.withColumn("_held", F.lit(True)), "event_id", "left")
    new = F.count_if(F.col("_held").isNull())
    return found.agg(new.alias("inserted"), (F.sum("n") - new).alias("duplicates"))


@query(
    "to_message_json",
    """SELECT event_id, concat('{"order_id":', CAST(order_id AS VARCHAR), ',"route_id":"', route_id, '","status":"', status, '"',
 CASE WHEN failure_reason IS NOT NULL THEN concat(',"failure_reason":"', failure_reason, '"') ELSE '' END, '}') AS value FROM v_scans""",
)
def to_message_json(t: Inputs) -> DataFrame:
    scans = t.scans()
    return scans.select("event_id", message_json(scans, ["order_id", "route_id", "status", "failure_reason"]).alias("value"))


@query(
    "next_offsets",
    "SELECT topic, kafka_partition, max(kafka_offset) + 1 AS next_offset FROM v_messages GROUP BY 1, 2",
)
def next_offsets(t: Inputs) -> DataFrame:
    return t.messages().groupBy("topic", "kafka_partition").agg((F.max("kafka_offset") + 1).alias("next_offset"))


def partition_positions(t: Inputs) -> DataFrame:
    """Per topic and partition: what is retained, what is written, and the newest row written."""
    written = F.col("ts") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return t.messages().groupBy("topic", "kafka_partition").agg(
        F.min("kafka_offset").alias("low"),
        (F.max("kafka_offset") + 1).alias("end_offset"),
        (F.max(F.when(written, F.col("kafka_offset"))) + 1).alias("committed_offset"),
        F.max(F.when(written & F.col("expected_reason").isNull(), F.col("ts"))).alias("last_event_time"),
    )


POSITIONS_SQL = """pos AS (SELECT topic, kafka_partition, min(kafka_offset) AS low, max(kafka_offset) + 1 AS end_offset,
 max(kafka_offset) FILTER (ts < TIMESTAMP '2024-01-25 00:00:00') + 1 AS committed_offset,
 max(ts) FILTER (ts < TIMESTAMP '2024-01-25 00:00:00' AND expected_reason IS NULL) AS last_event_time FROM v_messages GROUP BY 1, 2),
lag AS (SELECT *, greatest(end_offset - greatest(coalesce(committed_offset, low), low), 0) AS lag FROM pos)"""


def with_lag(positions: DataFrame) -> DataFrame:
    read_from = F.greatest(F.coalesce("committed_offset", "low"), F.col("low"))
    return positions.withColumn("lag", F.greatest(F.col("end_offset") - read_from, F.lit(0).cast("bigint")))


@query(
    "consumer_lag",
    f"WITH {POSITIONS_SQL} SELECT topic, kafka_partition, committed_offset, end_offset, lag, last_event_time FROM lag",
)
def consumer_lag(t: Inputs) -> DataFrame:
    return with_lag(partition_positions(t)).drop("low")


@query(
    "freshness",
    f"""WITH {POSITIONS_SQL} SELECT topic, kafka_partition, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_event_time)) / 1000000e0 AS data_age_s FROM lag""",
)
def freshness(t: Inputs) -> DataFrame:
    """Age of the newest written row of each partition at a moment of measurement."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_event_time").cast("timestamp"))
    return partition_positions(t).select("topic", "kafka_partition", (age / F.lit(1_000_000.0)).alias("data_age_s"))


@query(
    "lag_verdict",
    f"""WITH {POSITIONS_SQL} SELECT topic, bool_and(lag <= 1000) AS all_within, bool_or(lag > 1000) AS any_behind, CAST(sum(lag) AS BIGINT) AS total_lag FROM lag GROUP BY 1""",
)
def lag_verdict(t: Inputs) -> DataFrame:
    return with_lag(partition_positions(t)).groupBy("topic").agg(
        F.bool_and(F.col("lag") <= 1000).alias("all_within"),
        F.bool_or(F.col("lag") > 1000).alias("any_behind"),
        F.sum("lag").alias("total_lag"),
    )


@query(
    "consumer_health",
    """WITH p AS (SELECT kafka_partition, max(ts) AS polled_at, max(ts) FILTER (expected_reason IS NULL) AS wrote_at, count(*) AS n FROM v_messages GROUP BY 1),
n AS (SELECT max(ts) AS now FROM v_messages)
SELECT kafka_partition, n > 0 AND epoch_us(now) - epoch_us(polled_at) < 30000000 AND coalesce(epoch_us(now) - epoch_us(wrote_at) < 60000000, false) AS healthy FROM p JOIN n ON true""",
)
def consumer_health(t: Inputs) -> DataFrame:
    """A consumer is healthy while it owns partitions, has polled in the last 30 s and written in the last 60 s."""
    m = t.messages()
    per = m.groupBy("kafka_partition").agg(
        F.max("ts").alias("polled_at"), F.max(F.when(F.col("expected_reason").isNull(), F.col("ts"))).alias("wrote_at"),
        F.count(F.lit(1)).alias("n"),
    )
    now = m.agg(F.max("ts").alias("now")).withColumn("_one", F.lit(1))

    def since(moment: str):
        micros = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col(moment).cast("timestamp"))
        return micros / F.lit(1_000_000.0)

    healthy = (F.col("n") > 0) & (since("polled_at") < 30) & F.coalesce(since("wrote_at") < 60, F.lit(False))
    return per.withColumn("_one", F.lit(1)).join(now, "_one").select("kafka_partition", healthy.alias("healthy"))


@query(
    "ingest_delay",
    """SELECT topic, count(*) AS n, round(avg(d), 6) AS avg_s, min(d) AS min_s, max(d) AS max_s
FROM (SELECT topic, CAST(5 + kafka_offset % 60 AS DOUBLE) AS d FROM v_messages WHERE expected_reason IS NULL) x GROUP BY 1""",
)
def ingest_delay(t: Inputs) -> DataFrame:
    """Seconds from when something happened to when its row was written."""
    rows = rows_of(judged(t), GPS_PINGS)
    written = rows.withColumn("ingested_at", F.expr("event_time + make_dt_interval(0, 0, 0, 5 + offset % 60)"))
    delay = (F.unix_micros("ingested_at") - F.unix_micros("event_time")) / F.lit(1_000_000.0)
    return written.select(F.lit(GPS_PINGS.topic).alias("topic"), delay.alias("d")).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("avg_s"), F.min("d").alias("min_s"), F.max("d").alias("max_s")
    )


@query(
    "dead_letter_tail",
    "SELECT topic, kafka_partition, kafka_offset, expected_reason AS reason FROM v_messages WHERE expected_reason IS NOT NULL ORDER BY ts DESC, kafka_offset DESC LIMIT 20",
)
def dead_letter_tail(t: Inputs) -> DataFrame:
    return dead_letters_of(judged(t)).orderBy(F.desc("kafka_timestamp"), F.desc("kafka_offset")).limit(20).select(
        "topic", "kafka_partition", "kafka_offset", "reason"
    )


@query(
    "dead_letter_counts",
    "SELECT topic, expected_reason AS reason, count(*) AS n FROM v_messages WHERE expected_reason IS NOT NULL GROUP BY 1, 2",
)
def dead_letter_counts(t: Inputs) -> DataFrame:
    """What the dashboards may read: counts by topic and reason, no payload."""
    return dead_letters_of(judged(t)).drop("payload", "message_key").groupBy("topic", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "late_source",
    """SELECT kafka_offset, CASE WHEN expected_reason = 'unknown_source' THEN NULL ELSE expected_reason END AS reason FROM v_messages""",
)
def late_source(t: Inputs) -> DataFrame:
    """The registry is read again for every batch: a source registered meanwhile is known without a restart."""
    added = small_table(t.spark, [("simulator/drone", "simulated", "MIT")], "source_id string, kind string, license string")
    waiting = classify(t.envelopes(), None)
    return check_sources(waiting, t.sources().unionByName(added)).select(F.col("offset").alias("kafka_offset"), "reason")


@query(
    "source_license",
    """SELECT kafka_offset, s.kind, s.license FROM v_messages m JOIN v_sources s ON s.source_id = 'simulator/gps' WHERE m.expected_reason IS NULL""",
)
def source_license(t: Inputs) -> DataFrame:
    rows = rows_of(judged(t), GPS_PINGS).select(F.col("offset").alias("kafka_offset"), "source")
    return rows.join(t.sources(), F.col("source") == F.col("source_id")).select("kafka_offset", "kind", "license")


@query(
    "last_positions",
    """SELECT topic, kafka_partition, last_offset, measured_at FROM (SELECT topic, kafka_partition, kafka_offset AS last_offset, ts AS measured_at,
 row_number() OVER (PARTITION BY topic, kafka_partition ORDER BY ts DESC, kafka_offset DESC) AS rn FROM v_messages) m WHERE rn = 1""",
)
def last_positions(t: Inputs) -> DataFrame:
    measured = t.messages().select(
        "topic", "kafka_partition", F.col("kafka_offset").alias("last_offset"), F.col("ts").alias("measured_at")
    )
    return latest_per_key(measured, ["topic", "kafka_partition"], ["measured_at", "last_offset"])

"""Queries that write tables and read them back: replaced, guarded, stamped, unchanged, archived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspan.operators.keyed import content_digest
from parcelspan.plans.inputs import Inputs
from parcelspan.plans.registry import query
from parcelspan.session import run_folder
from parcelspan.sinks import tables


@query("replace_partition", """SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 'again' ELSE event_type END AS event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS service_date FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-20'""")
def replace_partition(t: Inputs) -> DataFrame:
    """Two dates written again, twice: the rows of one are replaced, the other got none and is cleared, other dates stay."""
    path = run_folder(t.spark, "days")
    days = t.table("events").select("event_id", "event_type", F.col("ts").cast("date").alias("service_date"))
    tables.replace_partitions(days, path, ["service_date"])
    again = days.where("service_date = DATE '2024-01-15'").withColumn("event_type", F.lit("again"))
    for _ in range(2):
        tables.replace_days(again, path, "service_date", ["2024-01-15", "2024-01-20"])
    return t.spark.read.parquet(path).select("event_id", "event_type", F.col("service_date").cast("string").alias("service_date"))


@query("guarded_replace", """SELECT route_id, 0 AS plan_version, planned_minutes + CASE WHEN wave = 'morning' THEN 1 ELSE 0 END AS planned_minutes FROM v_routes
UNION ALL SELECT route_id, 1, planned_minutes FROM v_routes WHERE wave = 'afternoon'""")  # fmt: skip
def guarded_replace(t: Inputs) -> DataFrame:
    """The baseline of both waves is planned again; the afternoon has re-plans, so only the morning changes."""
    path = run_folder(t.spark, "plans")
    plans = t.routes().select("route_id", "wave", F.lit(0).alias("plan_version"), "planned_minutes")
    replans = plans.where("wave = 'afternoon'").withColumn("plan_version", F.lit(1))
    tables.replace_partitions(plans.unionByName(replans), path, ["wave"])
    new = plans.withColumn("planned_minutes", F.col("planned_minutes") + 1)
    for wave in ("morning", "afternoon"):
        try:
            tables.guarded_replace(new.where(F.col("wave") == wave), path, ["wave"])
        except tables.GuardError:
            pass
    return t.spark.read.parquet(path).select("route_id", "plan_version", "planned_minutes")


@query("stamp_metadata", """SELECT order_id, 'generator/orders' AS source, TIMESTAMP '2026-09-29 06:30:00' AS ingested_at FROM v_orders""")
def stamp_metadata(t: Inputs) -> DataFrame:
    moment = F.lit("2026-09-29 06:30:00").cast("timestamp_ntz")
    return tables.stamped(t.orders().select("order_id"), "generator/orders", moment)


DIGEST_SQL = "CAST(CAST(sum(CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)) AS HUGEINT) AS VARCHAR)"


@query("content_checksum", f"""SELECT 'generator/orders' AS source, 'operations' AS owner, 4 AS schema_version, count(*) AS n_rows,
 {DIGEST_SQL.format(text="concat_ws(chr(31), coalesce('=' || CAST(note_id AS VARCHAR), '~'), '=' || CAST(order_id AS VARCHAR), '=' || wave)")} AS digest FROM v_orders""")  # fmt: skip
def content_checksum(t: Inputs) -> DataFrame:
    """What the manifest of a table says; the order and partitioning of its rows do not matter."""
    rows = t.orders().select("order_id", "wave", "note_id").withColumn("ingested_at", F.current_timestamp())
    return tables.manifest(rows, "generator/orders", "operations", 4)


@query("metadata_every_table", """SELECT 'orders' AS table_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS without_source, CAST(0 AS BIGINT) AS without_ingested_at, true AS described FROM v_orders
UNION ALL SELECT 'zones', count(*), 0, 0, true FROM v_zones UNION ALL SELECT 'vans', count(*), 0, 0, true FROM v_vans
UNION ALL SELECT 'shippers', count(*), 0, 0, true FROM v_shippers UNION ALL SELECT 'routes', count(*), 0, 0, true FROM v_routes
UNION ALL SELECT 'photos', count(*), count(*) FILTER (length % 2 = 1), count(*), false FROM v_photos""")  # fmt: skip
def metadata_every_table(t: Inputs) -> DataFrame:
    """Tables written with their metadata, and one that was not: without manifest and time, and with a source for some rows only."""
    moment = F.lit("2026-09-29 06:30:00").cast("timestamp_ntz")
    given = {
        "orders": t.orders().select("order_id", "wave", "parcels"), "zones": t.zones().select("zone_id", "name"),
        "vans": t.vans().select("vehicle_id", "type_id", "capacity"), "shippers": t.shippers().select("shipper_id", "segment"),
        "routes": t.routes().select("route_id", "wave"),
    }
    paths = {name: run_folder(t.spark, f"described-{name}") for name in [*given, "photos"]}
    for name, rows in given.items():
        tables.write_if_changed(tables.stamped(rows, f"generator/{name}", moment), paths[name], f"generator/{name}", "operations", 4)
    photos = t.photos().select("path", F.when(F.col("length") % 2 == 0, "simulator/pod").alias("source"))
    photos.write.parquet(f"{paths['photos']}/rows")
    return tables.metadata_report(t.spark, paths)


@query("table_digests", f"""SELECT service_date::VARCHAR AS day, count(*) AS n_rows, {DIGEST_SQL.format(text="concat_ws(chr(31), '=' || CAST(service_date AS VARCHAR), '=' || CAST(order_id AS VARCHAR), '=' || CAST(parcels AS VARCHAR))")} AS digest
FROM v_orders GROUP BY 1""")  # fmt: skip
def table_digests(t: Inputs) -> DataFrame:
    rows = t.orders().select(F.col("service_date").cast("string").alias("day"), "order_id", "parcels")
    return content_digest(rows, "day")


@query("retention_split", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-11' THEN 'archived' ELSE 'kept' END AS place, count(*) AS n FROM events GROUP BY 1, 2""")
def retention_split(t: Inputs) -> DataFrame:
    """Days before the cut-off move to the archive once both sides count the same rows."""
    path, table = run_folder(t.spark, "archive"), run_folder(t.spark, "days")
    days = t.table("events").select("event_id", F.col("ts").cast("date").alias("day"))
    tables.replace_partitions(days, table, ["day"])
    for cutoff in ("2024-01-06", "2024-01-11"):  # two runs: the second finds the days of the first archived and gone
        tables.archive_before(t.spark.read.parquet(table), "day", cutoff, path, table)
    kept = t.spark.read.parquet(table).withColumn("place", F.lit("kept")).select("event_id", "day", "place")
    archived = t.spark.read.parquet(path).withColumn("place", F.lit("archived"))
    both = kept.unionByName(archived.select("event_id", "day", "place"))
    return both.groupBy(F.col("day").cast("string").alias("day"), "place").agg(F.count(F.lit(1)).alias("n"))

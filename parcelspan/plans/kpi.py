"""The route-duration KPI and what supports it: departures, completions, delay, punctuality, energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspan.functions.calendar import minutes_between
from parcelspan.functions.geo import haversine_m
from parcelspan.operators.keyed import latest_per_key
from parcelspan.operators.ordered import Wanted, annotate
from parcelspan.operators.temporal import asof_join
from parcelspan.plans.inputs import Inputs
from parcelspan.plans.registry import query

FINAL = ("delivered", "failed")

HAVERSINE = (
    "2 * 6371000e0 * asin(sqrt(power(sin(radians(p.lat - h.lat) / 2), 2)"
    " + cos(radians(h.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - h.lon) / 2), 2)))"
)
MINUTES = "(epoch_us({b}) - epoch_us({a})) / 60e6"


def from_hub(pings: DataFrame, hub: DataFrame) -> DataFrame:
    """Pings with their distance from the depot they belong to."""
    h = hub.select("hub_id", F.col("lat").alias("_hlat"), F.col("lon").alias("_hlon"), "radius_m")
    return (
        pings.join(h, "hub_id")
        .withColumn("from_hub_m", haversine_m(F.col("_hlat"), F.col("_hlon"), F.col("lat"), F.col("lon")))
        .drop("_hlat", "_hlon")
    )


def departures(pings: DataFrame, hub: DataFrame) -> DataFrame:
    """First ping of each route outside the depot's geofence."""
    outside = from_hub(pings, hub).where("from_hub_m > radius_m AND route_id IS NOT NULL")
    return outside.groupBy("route_id").agg(F.min("event_time").alias("departed_at"))


def completions(scans: DataFrame) -> DataFrame:
    """Last final scan of each route and what the route delivered and failed."""
    return (
        scans.where(F.col("status").isin(*FINAL) & F.col("route_id").isNotNull())
        .groupBy("route_id")
        .agg(
            F.max("event_time").alias("completed_at"),
            F.count_if(F.col("status") == "delivered").alias("delivered"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )


def route_durations(t: Inputs, prefix: str = "R-") -> DataFrame:
    """Departure, completion and minutes of every route of the prefix: both sides are aggregated before
    they meet, so the join has one row per route on each side."""
    named = F.col("route_id").startswith(prefix)
    departed = departures(t.pings().where(named), t.hub())
    completed = completions(t.scans().where(named))
    return durations(departed, completed)


def durations(departed: DataFrame, completed: DataFrame) -> DataFrame:
    return departed.join(completed, "route_id").withColumn(
        "minutes", minutes_between(F.col("departed_at"), F.col("completed_at"))
    )


def duration_windows(done: DataFrame) -> DataFrame:
    """Routes and their average minutes by the day they were completed on, and their wave."""
    return done.groupBy(F.window("completed_at", "1 day").alias("w"), "wave").agg(
        F.count(F.lit(1)).alias("routes"), F.round(F.avg("minutes"), 6).alias("avg_minutes")
    ).select(F.col("w.start").cast("date").cast("string").alias("day"), "wave", "routes", "avg_minutes")


DURATIONS_SQL = f"""d AS (SELECT p.route_id, min(p.event_time) AS departed_at FROM v_pings p JOIN v_hub h USING (hub_id)
  WHERE {HAVERSINE} > h.radius_m AND p.route_id LIKE 'R-%' GROUP BY 1),
c AS (SELECT route_id, max(event_time) AS completed_at, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'failed') AS failed
  FROM v_scans WHERE status IN ('delivered', 'failed') AND route_id LIKE 'R-%' GROUP BY 1),
k AS (SELECT route_id, departed_at, completed_at, delivered, failed, {MINUTES.format(a="departed_at", b="completed_at")} AS minutes FROM d JOIN c USING (route_id))"""


@query("hub_distance", f"SELECT p.event_id, round({HAVERSINE}, 3) AS from_hub_m FROM v_pings p JOIN v_hub h USING (hub_id)")
def hub_distance(t: Inputs) -> DataFrame:
    return from_hub(t.pings(), t.hub()).select("event_id", F.round("from_hub_m", 3).alias("from_hub_m"))


@query(
    "geofence_exits",
    f"SELECT p.event_id, p.route_id, p.event_time FROM v_pings p JOIN v_hub h USING (hub_id) WHERE {HAVERSINE} > h.radius_m",
)
def geofence_exits(t: Inputs) -> DataFrame:
    return from_hub(t.pings(), t.hub()).where("from_hub_m > radius_m").select("event_id", "route_id", "event_time")


@query("final_scans", "SELECT event_id, route_id, status, event_time FROM v_scans WHERE status IN ('delivered', 'failed')")
def final_scans(t: Inputs) -> DataFrame:
    return t.scans().where(F.col("status").isin(*FINAL)).select("event_id", "route_id", "status", "event_time")


@query(
    "kpi_route_duration",
    f"WITH {DURATIONS_SQL} SELECT route_id, departed_at, completed_at, round(minutes, 9) AS minutes FROM k",
)
def kpi_route_duration(t: Inputs) -> DataFrame:
    return route_durations(t).select("route_id", "departed_at", "completed_at", F.round("minutes", 9).alias("minutes"))


@query(
    "kpi_by_wave",
    f"""WITH {DURATIONS_SQL} SELECT coalesce(wave, 'all') AS wave, count(*) AS routes, round(avg(minutes), 6) AS avg_minutes,
 round(min(minutes), 9) AS min_minutes, round(max(minutes), 9) AS max_minutes FROM k JOIN v_routes USING (route_id) GROUP BY ROLLUP (wave)""",
)
def kpi_by_wave(t: Inputs) -> DataFrame:
    return (
        route_durations(t).join(t.routes(), "route_id").rollup("wave").agg(*_duration_figures())
        .withColumn("wave", F.coalesce("wave", F.lit("all")))
    )


def _duration_figures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("routes"),
        F.round(F.avg("minutes"), 6).alias("avg_minutes"),
        F.round(F.min("minutes"), 9).alias("min_minutes"),
        F.round(F.max("minutes"), 9).alias("max_minutes"),
    ]


def routes_in_weather(t: Inputs) -> DataFrame:
    """Routes with the latest weather code of their zone at departure."""
    routes = route_durations(t).join(t.routes(), "route_id")
    return asof_join(routes, t.weather(), ["zone_id"], "departed_at", "read_at", ["weather_code"])


@query(
    "kpi_segments",
    f"""WITH {DURATIONS_SQL}, r AS (SELECT k.*, service_date, zone_id, type_id, hour(departed_at) AS departure_hour FROM k JOIN v_routes USING (route_id)),
w AS (SELECT r.*, s.weather_code FROM r ASOF LEFT JOIN v_weather s ON r.zone_id = s.zone_id AND r.departed_at >= s.read_at)
SELECT CASE WHEN GROUPING(service_date) = 0 THEN 'day' WHEN GROUPING(zone_id) = 0 THEN 'zone' WHEN GROUPING(departure_hour) = 0 THEN 'hour'
  WHEN GROUPING(type_id) = 0 THEN 'vehicle_type' ELSE 'weather' END AS segment,
 coalesce(CAST(service_date AS VARCHAR), zone_id, CAST(departure_hour AS VARCHAR), type_id, CAST(weather_code AS VARCHAR)) AS value,
 count(*) AS routes, round(avg(minutes), 6) AS avg_minutes, round(min(minutes), 9) AS min_minutes, round(max(minutes), 9) AS max_minutes
FROM w GROUP BY GROUPING SETS ((service_date), (zone_id), (departure_hour), (type_id), (weather_code))""",
)
def kpi_segments(t: Inputs) -> DataFrame:
    segmented = routes_in_weather(t).withColumn("departure_hour", F.hour("departed_at"))
    parts = ["service_date", "zone_id", "departure_hour", "type_id", "weather_code"]
    sets = [[F.col(p)] for p in parts]
    labels = ["day", "zone", "hour", "vehicle_type", "weather"]
    segment: Column = F.lit(labels[-1])
    for part, label in reversed(list(zip(parts[:-1], labels[:-1], strict=True))):
        segment = F.when(F.grouping(part) == 0, label).otherwise(segment)
    return (
        segmented.groupingSets(sets, *[F.col(p) for p in parts])
        .agg(segment.alias("segment"), *_duration_figures())
        .select(
            "segment", F.coalesce(*[F.col(p).cast("string") for p in parts]).alias("value"),
            "routes", "avg_minutes", "min_minutes", "max_minutes",
        )
    )


@query(
    "kpi_daily_window",
    f"""WITH {DURATIONS_SQL} SELECT CAST(CAST(completed_at AS DATE) AS VARCHAR) AS day, wave, count(*) AS routes, round(avg(minutes), 6) AS avg_minutes
FROM k JOIN v_routes USING (route_id) GROUP BY 1, 2""",
)
def kpi_daily_window(t: Inputs) -> DataFrame:
    return duration_windows(route_durations(t).join(t.routes(), "route_id"))


ON_TIME_SQL = "count(*) FILTER (s.event_time BETWEEN p.window_start AND p.window_end)"


@query(
    "on_time_share",
    f"""SELECT r.wave, count(*) AS deliveries, {ON_TIME_SQL} AS on_time, round({ON_TIME_SQL} / count(*), 6) AS share
FROM v_scans s JOIN v_routes r USING (route_id) LEFT JOIN v_promises p ON s.order_id = p.order_id WHERE s.status = 'delivered' GROUP BY 1""",
)
def on_time_share(t: Inputs) -> DataFrame:
    inside = F.coalesce(F.col("event_time").between(F.col("window_start"), F.col("window_end")), F.lit(False))
    judged = t.scans().where("status = 'delivered'").join(t.promises(), "order_id", "left").withColumn("inside", inside)
    # Routes are counted before they meet their plan, so the join moves one row per route.
    by_route = judged.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("k"))
    total, good = F.sum("n"), F.sum("k")
    return by_route.join(t.routes(), "route_id").groupBy("wave").agg(
        total.alias("deliveries"), good.alias("on_time"), F.round(good / total, 6).alias("share")
    )


@query(
    "failure_rate",
    """SELECT r.zone_id, count(*) FILTER (s.status = 'delivered') AS delivered, count(*) FILTER (s.status = 'failed') AS failed,
 round(count(*) FILTER (s.status = 'failed') / count(*), 6) AS failed_share
FROM v_scans s JOIN v_routes r USING (route_id) WHERE s.status IN ('delivered', 'failed') GROUP BY 1""",
)
def failure_rate(t: Inputs) -> DataFrame:
    failed, done = F.sum("failed"), F.sum(F.col("failed") + F.col("delivered"))
    return completions(t.scans()).join(t.routes(), "route_id").groupBy("zone_id").agg(
        F.sum("delivered").alias("delivered"), failed.alias("failed"), F.round(failed / done, 6).alias("failed_share")
    )


@query(
    "delay_vs_plan",
    f"""WITH {DURATIONS_SQL} SELECT service_date::VARCHAR AS day, count(*) AS routes, round(avg(minutes - planned_minutes), 6) AS avg_delay
FROM k JOIN v_routes USING (route_id) GROUP BY 1""",
)
def delay_vs_plan(t: Inputs) -> DataFrame:
    timed = route_durations(t).join(t.routes(), "route_id")
    return timed.groupBy(F.col("service_date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("routes"),
        F.round(F.avg(F.col("minutes") - F.col("planned_minutes")), 6).alias("avg_delay"),
    )


def fuel_per_route(telemetry: DataFrame) -> DataFrame:
    """Last minus first counter per route and van, and consumption per 100 km (NULL without distance)."""
    first, last = (
        F.min_by(F.struct("odometer_km", "energy_used_total"), "event_time"),
        F.max_by(F.struct("odometer_km", "energy_used_total"), "event_time"),
    )
    used = (
        telemetry.where("route_id IS NOT NULL")
        .groupBy("route_id", "vehicle_id")
        .agg(first.alias("a"), last.alias("b"), F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))
    )
    return used.select(
        "route_id",
        "vehicle_id",
        "first_at",
        "last_at",
        (F.col("b.odometer_km") - F.col("a.odometer_km")).alias("distance_km"),
        (F.col("b.energy_used_total") - F.col("a.energy_used_total")).alias("energy_used"),
    ).withColumn("per_100_km", F.when(F.col("distance_km") > 0, F.col("energy_used") / F.col("distance_km") * 100))


FUEL_SQL = """f AS (SELECT route_id, vehicle_id, min(event_time) AS first_at, max(event_time) AS last_at,
  arg_max(odometer_km, event_time) - arg_min(odometer_km, event_time) AS distance_km,
  arg_max(energy_used_total, event_time) - arg_min(energy_used_total, event_time) AS energy_used FROM v_telemetry GROUP BY 1, 2)"""


@query(
    "fuel_consumption",
    f"""WITH {FUEL_SQL} SELECT route_id, vehicle_id, first_at, last_at, round(distance_km, 3) AS distance_km, round(energy_used, 3) AS energy_used,
 CASE WHEN distance_km > 0 THEN round(energy_used / distance_km * 100, 2) END AS per_100_km FROM f""",
)
def fuel_consumption(t: Inputs) -> DataFrame:
    return fuel_per_route(t.telemetry()).select(
        "route_id", "vehicle_id", "first_at", "last_at",
        *[F.round(c, n).alias(c) for c, n in (("distance_km", 3), ("energy_used", 3), ("per_100_km", 2))],
    )


@query(
    "idle_minutes",
    f"""WITH g AS (SELECT *, lead(event_time) OVER (PARTITION BY vehicle_id ORDER BY event_time) AS next_at FROM v_telemetry)
SELECT route_id, vehicle_id, round(coalesce(sum({MINUTES.format(a="event_time", b="next_at")}) FILTER (ignition_on AND speed_kmh = 0), 0), 9) AS idle_minutes
FROM g GROUP BY 1, 2""",
)
def idle_minutes(t: Inputs) -> DataFrame:
    timed = annotate(
        t.telemetry(), ["vehicle_id"], ["event_time"],
        Wanted(following={"next_at": F.col("event_time")}),
    )
    idle = F.when(F.col("ignition_on") & (F.col("speed_kmh") == 0), minutes_between(F.col("event_time"), F.col("next_at")))
    return timed.groupBy("route_id", "vehicle_id").agg(
        F.round(F.coalesce(F.sum(idle), F.lit(0.0)), 9).alias("idle_minutes")
    )


@query(
    "route_cost",
    f"""WITH {FUEL_SQL}, r AS (SELECT f.route_id, f.vehicle_id, f.energy_used, f.last_at, type_id FROM f JOIN v_routes USING (route_id)),
c AS (SELECT r.*, CASE WHEN r.type_id = 'electric' THEN 0.17e0 ELSE p.price END AS price FROM r ASOF LEFT JOIN v_fuel_prices p ON r.type_id = p.product AND r.last_at >= p.priced_at)
SELECT route_id, vehicle_id, type_id, round(price, 4) AS price, round(energy_used * price, 8) AS cost FROM c""",
)
def route_cost(t: Inputs) -> DataFrame:
    """Energy of each route at the latest fuel price; electricity at a fixed tariff."""
    used = fuel_per_route(t.telemetry()).join(t.routes().select("route_id", "type_id"), "route_id")
    prices = t.fuel_prices().withColumnRenamed("product", "type_id")
    priced = asof_join(used, prices, ["type_id"], "last_at", "priced_at", ["price"])
    price = F.when(F.col("type_id") == "electric", F.lit(ELECTRICITY_TARIFF)).otherwise(F.col("price"))
    return priced.select(
        "route_id", "vehicle_id", "type_id", F.round(price, 4).alias("price"),
        F.round(F.col("energy_used") * price, 8).alias("cost"),
    )


ELECTRICITY_TARIFF = 0.17  # per kWh, the documented constant of a feed without electricity prices


@query(
    "weather_asof",
    """SELECT p.event_id, s.weather_code, s.read_at FROM (SELECT v_scans.event_id, v_scans.event_time, r.zone_id FROM v_scans JOIN v_routes r USING (route_id)) p
ASOF LEFT JOIN v_weather s ON p.zone_id = s.zone_id AND p.event_time >= s.read_at""",
)
def weather_asof(t: Inputs) -> DataFrame:
    located = t.scans().select("event_id", "event_time", "route_id").join(
        t.routes().select("route_id", "zone_id"), "route_id"
    )
    return asof_join(located, t.weather(), ["zone_id"], "event_time", "read_at", ["weather_code", "read_at"]).select(
        "event_id", "weather_code", "read_at"
    )


@query(
    "latest_per_key",
    """SELECT vehicle_id, event_time, event_id, round(speed_kmh, 6) AS speed_kmh FROM v_pings
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1""",
)
def latest_position(t: Inputs) -> DataFrame:
    pings = t.pings().select("vehicle_id", "event_time", "event_id", F.round("speed_kmh", 6).alias("speed_kmh"))
    return latest_per_key(pings, ["vehicle_id"], ["event_time", "event_id"])


@query(
    "kpi_delay_and_on_time",
    f"""WITH {DURATIONS_SQL},
o AS (SELECT s.route_id, count(*) AS deliveries, {ON_TIME_SQL} AS on_time FROM v_scans s LEFT JOIN v_promises p ON s.order_id = p.order_id WHERE s.status = 'delivered' GROUP BY 1)
SELECT wave, count(*) AS routes, round(avg(minutes - planned_minutes), 6) AS avg_delay, CAST(coalesce(sum(deliveries), 0) AS BIGINT) AS deliveries,
 round(sum(on_time) / sum(deliveries), 6) AS on_time_share FROM k JOIN v_routes USING (route_id) LEFT JOIN o USING (route_id) GROUP BY 1""",
)
def kpi_delay_and_on_time(t: Inputs) -> DataFrame:
    inside = F.col("event_time").between(F.col("window_start"), F.col("window_end"))
    on_time = (
        t.scans().where("status = 'delivered'").join(t.promises(), "order_id", "left")
        .groupBy("route_id").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(inside).alias("on_time"))
    )
    routes = route_durations(t).join(t.routes(), "route_id").join(on_time, "route_id", "left")
    return routes.groupBy("wave").agg(
        F.count(F.lit(1)).alias("routes"),
        F.round(F.avg(F.col("minutes") - F.col("planned_minutes")), 6).alias("avg_delay"),
        F.coalesce(F.sum("deliveries"), F.lit(0)).alias("deliveries"),
        F.round(F.sum("on_time") / F.sum("deliveries"), 6).alias("on_time_share"),
    )


@query(
    "break_stop",
    """WITH s AS (SELECT route_id, order_id, line_no, planned_arrival, row_number() OVER (PARTITION BY route_id ORDER BY planned_arrival, order_id, line_no) AS seq,
  count(*) OVER (PARTITION BY route_id) AS n, min(planned_arrival) OVER (PARTITION BY route_id) AS begun FROM v_plan_stops)
SELECT route_id, min(seq) AS break_before FROM s WHERE epoch_us(planned_arrival) - epoch_us(begun) >= 10800000000 AND seq < n GROUP BY 1""",
)
def break_stop(t: Inputs) -> DataFrame:
    """The first stop reached three hours or more after the start, unless it is the last one."""
    stops = t.plan_stops().select("route_id", "planned_arrival", "order_id", "line_no")
    numbered = annotate(
        stops, ["route_id"], ["planned_arrival", "order_id", "line_no"], Wanted(row_number="seq"),
    )
    spans = stops.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.min("planned_arrival").alias("begun"))
    late = numbered.join(spans, "route_id").where(
        (minutes_between(F.col("begun"), F.col("planned_arrival")) >= 180) & (F.col("seq") < F.col("n"))
    )
    return late.groupBy("route_id").agg(F.min("seq").alias("break_before"))


@query(
    "staggered_departures",
    """SELECT route_id, CAST(service_date AS TIMESTAMP) + INTERVAL 450 MINUTE + to_seconds(40 * (row_number() OVER (PARTITION BY service_date, wave ORDER BY route_id) - 1)) AS departs_at
FROM v_routes WHERE wave = 'morning'""",
)
def staggered_departures(t: Inputs) -> DataFrame:
    """Morning vans leave from 07:30, one every 40 seconds, in the order of their names. A wave has as
    many routes as the fleet has vans."""
    rank = F.row_number().over(Window.partitionBy("service_date", "wave").orderBy("route_id")) - 1
    return t.routes().where("wave = 'morning'").select("route_id", "service_date", rank.alias("k")).select(
        "route_id",
        F.expr("CAST(service_date AS TIMESTAMP_NTZ) + INTERVAL 450 MINUTE + make_dt_interval(0, 0, 0, 40 * k)").alias("departs_at"),
    )

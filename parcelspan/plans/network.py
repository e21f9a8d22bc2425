"""Queries on orders, plans, zones and fleet: joins, aggregates, windows and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspan.functions import calendar as cal
from parcelspan.functions.geo import bearing_deg, sweep_angle
from parcelspan.functions.ids import route_name
from parcelspan.functions.text import norm_text
from parcelspan.operators.allocate import (
    capacity_slices, cumulative_share, highest_averages, largest_remainder, limited_slices,
)
from parcelspan.operators.keyed import content_digest, left_join_known, latest_per_key, multiset_difference, upper_median
from parcelspan.operators.ordered import Wanted, annotate
from parcelspan.operators.spatial import containing_shapes, inside_own_shape, nearest_site, ring_edges, shape_cells
from parcelspan.operators.temporal import asof_join, inside_intervals, resample_track, sessions
from parcelspan.operators.traffic import ProfileTraffic, StateTraffic, nearest_section, polylines
from parcelspan.plans.inputs import FLEET, HUB, Inputs
from parcelspan.plans.registry import query
from parcelspan.session import run_folder, small_table
from parcelspan.sources import feeds
from parcelspan.sources.documents import geojson_rings


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def one_row(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit(1))


# Joins -------------------------------------------------------------------------------------------


@query("plan_stops_orders", """SELECT s.route_id, s.order_id, s.line_no, s.planned_arrival, o.zone_id, o.parcels, o.wave, v.capacity
FROM v_plan_stops s JOIN v_orders o USING (order_id) JOIN v_vans v USING (vehicle_id) ORDER BY s.route_id, s.planned_arrival""")  # fmt: skip
def plan_stops_orders(t: Inputs) -> DataFrame:
    orders = t.orders().select("order_id", "zone_id", "parcels", "wave")
    vans = t.vans().select("vehicle_id", "capacity")
    stops = t.plan_stops().select("route_id", "vehicle_id", "order_id", "line_no", "planned_arrival")
    return stops.join(orders, "order_id").join(vans, "vehicle_id").drop("vehicle_id").orderBy(
        "route_id", "planned_arrival"
    )


@query("routes_of_waves", "SELECT route_id, vehicle_id FROM (SELECT route_id, vehicle_id FROM v_plan_stops WHERE order_id IN (SELECT order_id FROM v_orders WHERE wave = 'morning' AND service_level = 'same_day')) s GROUP BY 1, 2")
def routes_of_waves(t: Inputs) -> DataFrame:
    wanted = t.orders().where("wave = 'morning' AND service_level = 'same_day'").select("order_id")
    return t.plan_stops().select("route_id", "vehicle_id", "order_id").join(wanted, "order_id", "left_semi").select(
        "route_id", "vehicle_id"
    ).distinct()


@query("array_containment_join", """SELECT v.vehicle_id, count(d.driver_id) AS drivers, min(d.driver_id) AS first_driver FROM v_vans v LEFT JOIN (SELECT driver_id, shift_id, unnest(zones) AS zone_id, vehicle_types FROM v_drivers) d
ON v.home_zone_id = d.zone_id AND list_contains(d.vehicle_types, v.type_id) AND (d.shift_id = 'afternoon') = v.afternoon GROUP BY 1""")  # fmt: skip
def array_containment_join(t: Inputs) -> DataFrame:
    """How many drivers may take each van, and the first of them: they know its zone and are cleared
    for its type. The lists are exploded and the drivers of a (zone, type, shift) counted before the
    vans meet them, so no pair of driver and van is ever made."""
    known = t.drivers().select(
        "driver_id", F.explode("zones").alias("home_zone_id"), "vehicle_types", (F.col("shift_id") == "afternoon").alias("afternoon")
    ).select("driver_id", "home_zone_id", "afternoon", F.explode("vehicle_types").alias("type_id"))
    able = known.groupBy("home_zone_id", "type_id", "afternoon").agg(
        F.count(F.lit(1)).alias("drivers"), F.min("driver_id").alias("first_driver")
    )
    return t.vans().join(able, ["home_zone_id", "type_id", "afternoon"], "left").select(
        "vehicle_id", F.coalesce("drivers", F.lit(0)).alias("drivers"), "first_driver"
    )


@query("driver_fit", """SELECT d.driver_id, count(*) FILTER (list_contains(d.zones, r.zone_id)) AS zones_known, count(*) AS zones_asked
FROM v_drivers d JOIN (SELECT DISTINCT zone_id, type_id, wave FROM v_routes) r ON r.wave = d.shift_id AND list_contains(d.vehicle_types, r.type_id) GROUP BY 1""")  # fmt: skip
def driver_fit(t: Inputs) -> DataFrame:
    """How many of the zones a driver could be sent to they know. The asked zones of a (wave, type) are
    a short list, so they are one array and the overlap is counted in place."""
    asked = t.routes().groupBy(F.col("wave").alias("shift_id"), "type_id").agg(
        F.collect_set("zone_id").alias("asked")
    )
    able = t.drivers().select("driver_id", "shift_id", "zones", F.explode("vehicle_types").alias("type_id"))
    return able.join(asked, ["shift_id", "type_id"]).groupBy("driver_id").agg(
        F.sum(F.size(F.array_intersect("zones", "asked"))).alias("zones_known"), F.sum(F.size("asked")).alias("zones_asked")
    )


@query("nearest_zone", """SELECT order_id, zone_id AS nearest, round(d, 3) AS distance_m FROM (SELECT o.order_id, h.zone_id,
 2 * 6371000e0 * asin(sqrt(power(sin(radians(h.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(h.lat)) * power(sin(radians(h.lon - o.lon) / 2), 2))) AS d
 FROM v_orders o JOIN v_zones h ON true) x QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY d, zone_id) = 1""")  # fmt: skip
def nearest_zone(t: Inputs) -> DataFrame:
    points = t.orders().select("order_id", "lat", "lon")
    return nearest_site(points, t.zones().select("zone_id", "lat", "lon"), "zone_id", "lat", "lon").select(
        "order_id", "nearest", F.round("distance_m", 3).alias("distance_m")
    )


def boundary_files(t: Inputs) -> str:
    """Boundaries of the zones as GeoJSON files of a few features each: an eight-sided outline with a square hole round the zone's centre. Every
    third is a MultiPolygon."""
    def point(dx: float, dy: float) -> Column:
        return F.array(F.col("lon") + F.lit(dx), F.col("lat") + F.lit(dy))

    polygon = F.array(*[F.array(*[point(dx, dy) for dx, dy in ring]) for ring in (OUTLINE, HOLE)])
    many = F.col("zone_no") % 3 == 0
    geometry = F.concat(
        F.lit('{"type":"'), F.when(many, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'),
        F.when(many, F.to_json(F.array(polygon))).otherwise(F.to_json(polygon)), F.lit("}"),
    )
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("zone_id", "name")), F.lit(',"geometry":'), geometry, F.lit("}"))
    features = t.zones().select((F.col("zone_no") % 5).alias("file"), feature.alias("feature")).groupBy("file").agg(F.collect_list("feature").alias("f"))
    path = run_folder(t.spark, "boundaries")
    collection = F.concat(F.lit('{"type":"FeatureCollection",\n"features":['), F.array_join("f", ",\n"), F.lit("]}"))
    features.select(collection.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def boundaries(t: Inputs) -> DataFrame:
    """Rings of every zone, read from its boundary file."""
    return geojson_rings(t.spark, boundary_files(t), "zone_id")


OUTLINE = (
    (0.008, 0.0031), (0.0037, 0.0079), (-0.0033, 0.0081), (-0.0079, 0.0029),
    (-0.0081, -0.0031), (-0.0031, -0.0077), (0.0033, -0.0079), (0.0083, -0.0033), (0.008, 0.0031),
)
HOLE = ((0.0021, 0.0017), (-0.0019, 0.0023), (-0.0023, -0.0019), (0.0017, -0.0021), (0.0021, 0.0017))


def _edges_sql() -> str:
    edges = [(*a, *b) for ring in (OUTLINE, HOLE) for a, b in zip(ring, ring[1:])]
    values = ", ".join(f"({a}e0, {b}e0, {c}e0, {d}e0)" for a, b, c, d in edges)
    return (
        "e AS (SELECT zone_id, lon + dx1 AS x1, lat + dy1 AS y1, lon + dx2 AS x2, lat + dy2 AS y2 FROM v_zones"
        f" JOIN (VALUES {values}) d(dx1, dy1, dx2, dy2) ON true)"
    )


CROSSES = "(e.y1 > o.lat) <> (e.y2 > o.lat) AND o.lon < e.x1 + (o.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)"


@query("point_in_polygon", f"""WITH {_edges_sql()} SELECT o.order_id, e.zone_id FROM v_orders o JOIN e ON {CROSSES} GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_polygon(t: Inputs) -> DataFrame:
    cells = shape_cells(ring_edges(boundaries(t), "zone_id", "points"), "zone_id")
    return containing_shapes(t.orders().select("order_id", "lat", "lon"), cells, "zone_id", "lon", "lat").select(
        "order_id", "zone_id"
    )


@query("inside_share", f"""WITH {_edges_sql()}, c AS (SELECT o.order_id, o.zone_id, count(e.zone_id) % 2 AS inside FROM v_orders o LEFT JOIN e ON e.zone_id = o.zone_id AND {CROSSES} GROUP BY 1, 2)
SELECT zone_id, count(*) AS orders, round(avg(inside), 6) AS inside_share FROM c GROUP BY 1""")  # fmt: skip
def inside_share(t: Inputs) -> DataFrame:
    cells = shape_cells(ring_edges(boundaries(t), "zone_id", "points"), "zone_id")
    placed = inside_own_shape(t.orders().select("order_id", "zone_id", "lat", "lon"), cells, "zone_id", "lon", "lat", "inside")
    return placed.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.avg(F.col("inside").cast("int")), 6).alias("inside_share")
    )


@query("traffic_factor", """WITH p AS (SELECT event_id, CAST(hour(timezone('Europe/Madrid', timezone('UTC', event_time))) * 60 + minute(timezone('Europe/Madrid', timezone('UTC', event_time))) AS INT) AS m,
 isodow(timezone('Europe/Madrid', timezone('UTC', event_time))) = 6 AS sat FROM v_pings),
f AS (SELECT event_id, sat, CASE WHEN m >= 1320 THEN 1e0 WHEN m >= 1200 THEN 1.15e0 WHEN m >= 1050 THEN 1.45e0 WHEN m >= 900 THEN 1.25e0 WHEN m >= 780 THEN 1.35e0
 WHEN m >= 570 THEN 1.25e0 WHEN m >= 450 THEN 1.5e0 WHEN m >= 420 THEN 1.2e0 ELSE 1e0 END AS f FROM p)
SELECT event_id, round(CASE WHEN sat THEN 1 + (f - 1) * 0.5e0 ELSE f END, 6) AS factor FROM f""")  # fmt: skip
def traffic_factor(t: Inputs) -> DataFrame:
    """The congestion factor in force at each ping: the last profile entry at or before its local minute."""
    rides = ProfileTraffic(profile_table(t)).factor(t.pings().select("event_id", "event_time", "lat", "lon"), "event_time", "lat", "lon", "factor")
    return rides.select("event_id", F.round("factor", 6).alias("factor"))


def profile_table(t: Inputs) -> DataFrame:
    return small_table(t.spark, list(cal.TRAFFIC_PROFILE), "start int, factor double")


def section_lines(t: Inputs) -> DataFrame:
    """The street sections as polylines, from the file of their points that is written first."""
    return polylines(feeds.section_points(t.spark, section_file(t)))


def section_file(t: Inputs) -> str:
    """Geometry of sixty sections in the long format: a row for each point, in no order. A section zigzags eastwards."""
    path, k = run_folder(t.spark, "sections"), F.col("c_custkey")
    section, seq = (k % 60).cast("int"), F.expr("c_custkey div 60")
    t.table("customer").select(
        section.alias("section_id"), seq.alias("point_seq"),
        F.round(F.lit(2.1265) + (section % 10).cast("double") / 500 + seq.cast("double") / 50000, 6).alias("lon"),
        F.round(F.lit(41.3295) + F.floor(section / 10).cast("double") / 300 + (seq % 3).cast("double") / 20000, 6).alias("lat"),
    ).write.csv(path, header=True)
    return path


SECTIONS_SQL = """pts AS (SELECT CAST(c_custkey % 60 AS INT) AS section_id, c_custkey // 60 AS point_seq,
 round(2.1265e0 + CAST(c_custkey % 60 % 10 AS DOUBLE) / 500 + CAST(c_custkey // 60 AS DOUBLE) / 50000, 6) AS lon,
 round(41.3295e0 + CAST(c_custkey % 60 // 10 AS DOUBLE) / 300 + CAST(c_custkey // 60 % 3 AS DOUBLE) / 20000, 6) AS lat FROM customer),
seg AS (SELECT * FROM (SELECT section_id, point_seq, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY section_id ORDER BY point_seq)) s WHERE x2 IS NOT NULL)"""
LEG_SQL = "2 * 6371000e0 * asin(sqrt(power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)))"


@query("section_lengths", f"""WITH {SECTIONS_SQL}, n AS (SELECT section_id, CAST(count(*) AS INT) AS n_points FROM pts GROUP BY 1), l AS (SELECT section_id, sum({LEG_SQL}) AS m FROM seg GROUP BY 1)
SELECT section_id, n_points, round(coalesce(m, 0), 3) AS length_m FROM n LEFT JOIN l USING (section_id)""")  # fmt: skip
def section_lengths(t: Inputs) -> DataFrame:
    """Length of every street section, along its points in order."""
    return section_lines(t).select("section_id", "n_points", F.round("length_m", 3).alias("length_m"))


# A degree is 6371000 * pi / 180 metres; a place is measured to the segment on a plane scaled to its latitude.
NEAREST_SQL = f"""{SECTIONS_SQL}, deg AS (SELECT *, 6371000e0 * radians(1e0) AS m FROM seg),
loc AS (SELECT DISTINCT lat, lon, cos(radians(lat)) AS c FROM v_pings),
box AS (SELECT l.*, d.section_id, (x1 - lon) * c * m AS ax, (y1 - lat) * m AS ay, (x2 - x1) * c * m AS dx, (y2 - y1) * m AS dy FROM loc l JOIN deg d ON abs(least(y1, y2) - lat) < 0.01e0 AND lon BETWEEN least(x1, x2) - 0.005e0 AND greatest(x1, x2) + 0.005e0),
al AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS k FROM box),
near AS (SELECT lat, lon, section_id, sqrt(power(ax + k * dx, 2) + power(ay + k * dy, 2)) AS d FROM al),
best AS (SELECT lat, lon, section_id, d FROM near WHERE d <= 200 QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY d, section_id) = 1)"""


@query("nearest_section", f"WITH {NEAREST_SQL} SELECT p.event_id, b.section_id, round(b.d, 3) AS distance_m FROM v_pings p LEFT JOIN best b ON p.lat = b.lat AND p.lon = b.lon")
def nearest_street_section(t: Inputs) -> DataFrame:
    """The street section each ping was sent from, if any is near."""
    near = nearest_section(t.pings().select("event_id", "lat", "lon"), section_lines(t), "lat", "lon")
    return near.select("event_id", "section_id", F.round("distance_m", 3).alias("distance_m"))


# How much longer a way takes in each state that tells anything.
STATE_FACTORS = {1: 1.0, 2: 1.1, 3: 1.25, 4: 1.5, 5: 2.0}


@query("traffic_factor_live", f"""WITH {NEAREST_SQL}, st AS (SELECT feed_item_id AS section_id, event_time, max(state) AS state FROM v_traffic WHERE feed = 'trams' GROUP BY 1, 2),
pl AS (SELECT p.event_id, p.event_time, b.section_id FROM v_pings p LEFT JOIN best b ON p.lat = b.lat AND p.lon = b.lon),
lv AS (SELECT pl.event_id, pl.event_time, CASE WHEN st.event_time >= pl.event_time - INTERVAL 720 MINUTE THEN CASE st.state WHEN 1 THEN 1e0 WHEN 2 THEN 1.1e0 WHEN 3 THEN 1.25e0 WHEN 4 THEN 1.5e0 WHEN 5 THEN 2e0 END END AS live
 FROM pl ASOF LEFT JOIN st ON pl.section_id = st.section_id AND pl.event_time >= st.event_time),
q AS (SELECT event_id, live, CAST(hour(timezone('Europe/Madrid', timezone('UTC', event_time))) * 60 + minute(timezone('Europe/Madrid', timezone('UTC', event_time))) AS INT) AS m, isodow(timezone('Europe/Madrid', timezone('UTC', event_time))) = 6 AS sat FROM lv),
f AS (SELECT event_id, live, sat, CASE WHEN m >= 1320 THEN 1e0 WHEN m >= 1200 THEN 1.15e0 WHEN m >= 1050 THEN 1.45e0 WHEN m >= 900 THEN 1.25e0 WHEN m >= 780 THEN 1.35e0
 WHEN m >= 570 THEN 1.25e0 WHEN m >= 450 THEN 1.5e0 WHEN m >= 420 THEN 1.2e0 ELSE 1e0 END AS f FROM q)
SELECT event_id, round(coalesce(live, CASE WHEN sat THEN 1 + (f - 1) * 0.5e0 ELSE f END), 6) AS factor FROM f""")  # fmt: skip
def traffic_factor_live(t: Inputs) -> DataFrame:
    """The factor by the state of the nearest section, reported in the last twelve hours; by the profile elsewhere."""
    states = t.traffic().where("feed = 'trams'").groupBy(F.col("feed_item_id").alias("section_id"), "event_time").agg(F.max("state").alias("state"))
    live = StateTraffic(states, section_lines(t), STATE_FACTORS, ProfileTraffic(profile_table(t)), fresh_minutes=720)
    rides = live.factor(t.pings().select("event_id", "event_time", "lat", "lon"), "event_time", "lat", "lon", "factor")
    return rides.select("event_id", F.round("factor", 6).alias("factor"))


OFF_SQL = "off AS (SELECT vehicle_id, event_time AS a, event_time + INTERVAL 90 MINUTE AS b FROM v_telemetry WHERE NOT ignition_on)"


@query("interval_membership", f"""WITH {OFF_SQL} SELECT p.event_id, EXISTS (SELECT 1 FROM off o WHERE o.vehicle_id = p.vehicle_id AND p.event_time >= o.a AND p.event_time < o.b) AS inside FROM v_pings p""")
def interval_membership(t: Inputs) -> DataFrame:
    """Pings sent while the van's ignition was off; each off reading holds for 90 minutes."""
    off = t.telemetry().where(~F.col("ignition_on")).select(
        "vehicle_id", F.col("event_time").alias("a"), F.expr("event_time + INTERVAL 90 MINUTE").alias("b")
    )
    points = t.pings().select("event_id", "vehicle_id", "event_time")
    return inside_intervals(points, off, ["vehicle_id"], "event_time", "a", "b").select("event_id", "inside")


@query("route_at_time", """WITH s AS (SELECT vehicle_id, route_id, min(event_time) AS a, max(event_time) AS b FROM v_telemetry GROUP BY 1, 2)
SELECT p.event_id, CASE WHEN p.event_time < s.b THEN s.route_id END AS on_route FROM v_pings p ASOF LEFT JOIN s ON p.vehicle_id = s.vehicle_id AND p.event_time >= s.a""")  # fmt: skip
def route_at_time(t: Inputs) -> DataFrame:
    """Which route a van is on at each ping, or none: routes of a van do not overlap, so the latest
    start decides and its end is checked."""
    spans = t.telemetry().groupBy("vehicle_id", "route_id").agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    points = t.pings().select("event_id", "vehicle_id", "event_time")
    spans = spans.withColumnRenamed("route_id", "on_route")
    seen = asof_join(points, spans, ["vehicle_id"], "event_time", "a", ["on_route", "b"])
    return seen.select("event_id", F.when(F.col("event_time") < F.col("b"), F.col("on_route")).alias("on_route"))


TRACK_SQL = """k AS (SELECT vehicle_id, epoch_us(event_time) // 1000000 AS t, max(event_id) AS d FROM v_pings GROUP BY 1, 2),
seg AS (SELECT vehicle_id, t AS t0, d AS d0, lead(t) OVER w AS t1, lead(d) OVER w AS d1 FROM k WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
b AS (SELECT vehicle_id, arg_min(d, t) AS first_d FROM k GROUP BY 1),
ticks AS (SELECT DISTINCT vehicle_id, epoch_us(event_time) // 1000000 // 3600 * 3600 AS t FROM v_pings)"""


@query("track_resample", f"""WITH {TRACK_SQL} SELECT x.vehicle_id, x.t, round(CASE WHEN s.t0 IS NULL THEN b.first_d WHEN s.t1 IS NULL THEN s.d0 ELSE s.d0 + (s.d1 - s.d0) * ((x.t - s.t0) / (s.t1 - s.t0)) END, 4) AS dist
FROM ticks x ASOF LEFT JOIN seg s ON x.vehicle_id = s.vehicle_id AND x.t >= s.t0 JOIN b ON x.vehicle_id = b.vehicle_id""")  # fmt: skip
def track_resample(t: Inputs) -> DataFrame:
    """Distance of each van at whole hours, on straight lines between its keyframes."""
    second = F.floor(micros("event_time") / F.lit(1_000_000)).cast("bigint")
    frames = t.pings().groupBy("vehicle_id", second.alias("t")).agg(F.max("event_id").cast("double").alias("dist"))
    ticks = t.pings().select("vehicle_id", (F.floor(second / 3600) * 3600).cast("bigint").alias("t")).distinct()
    return resample_track(ticks, frames, ["vehicle_id"], "t", ["dist"]).select("vehicle_id", "t", F.round("dist", 4).alias("dist"))


@query("traffic_join", """WITH last AS (SELECT * FROM v_traffic WHERE feed = 'trams' QUALIFY row_number() OVER (PARTITION BY feed_item_id ORDER BY event_time DESC, state DESC, forecast DESC) = 1),
pts AS (SELECT CAST(c_custkey % 60 AS INT) AS section_id, c_custkey // 60 AS point_seq, round(2.1265e0 + CAST(c_custkey % 60 % 10 AS DOUBLE) / 500 + CAST(c_custkey // 60 AS DOUBLE) / 50000, 6) AS lon FROM customer)
SELECT section_id, point_seq, lon, event_time, state FROM last JOIN pts ON feed_item_id = section_id""")  # fmt: skip
def traffic_join(t: Inputs) -> DataFrame:
    """Latest state of each street section with the section's points; itineraries have ids of their own."""
    states = latest_per_key(t.traffic().where("feed = 'trams'"), ["feed_item_id"], ["event_time", "state", "forecast"])
    points = feeds.section_points(t.spark, section_file(t))
    return points.join(states, F.col("section_id") == F.col("feed_item_id")).select(
        "section_id", "point_seq", "lon", "event_time", "state"
    )


@query("note_labels", """SELECT o.order_id, n.likely_longer_stop, n.likely_failed_attempt FROM v_orders o LEFT JOIN v_notes n ON o.note_id = n.note_id""")
def note_labels(t: Inputs) -> DataFrame:
    labels = t.notes().select("note_id", "likely_longer_stop", "likely_failed_attempt")
    return left_join_known(t.orders().select("order_id", "note_id"), labels, "note_id").drop("note_id")


@query("photo_reconciliation", """SELECT coalesce(s.pod_object_key, p.path) AS object_key, CASE WHEN p.path IS NULL THEN 'missing' ELSE 'orphan' END AS finding
FROM (SELECT pod_object_key FROM v_scans WHERE status = 'delivered') s FULL JOIN v_photos p ON s.pod_object_key = p.path WHERE s.pod_object_key IS NULL OR p.path IS NULL""")  # fmt: skip
def photo_reconciliation(t: Inputs) -> DataFrame:
    """Delivered scans whose photo is not stored, and stored photos no scan names."""
    named = t.scans().where("status = 'delivered'").select("pod_object_key")
    return named.join(t.photos(), F.col("pod_object_key") == F.col("path"), "full_outer").where(
        "pod_object_key IS NULL OR path IS NULL"
    ).select(
        F.coalesce("pod_object_key", "path").alias("object_key"),
        F.when(F.col("path").isNull(), "missing").otherwise("orphan").alias("finding"),
    )


@query("null_safe_mismatch", """SELECT o.order_id FROM v_orders o LEFT JOIN v_notes n ON o.note_id = n.note_id WHERE n.likely_longer_stop IS DISTINCT FROM n.likely_failed_attempt""")
def null_safe_mismatch(t: Inputs) -> DataFrame:
    labels = t.notes().select("note_id", "likely_longer_stop", "likely_failed_attempt")
    joined = left_join_known(t.orders().select("order_id", "note_id"), labels, "note_id")
    return joined.where(~F.col("likely_longer_stop").eqNullSafe(F.col("likely_failed_attempt"))).select("order_id")


# Aggregates --------------------------------------------------------------------------------------


@query("zone_share", "SELECT zone_id, CAST(sum(parcels) AS BIGINT) AS parcels, round(sum(parcels) / sum(sum(parcels)) OVER (), 9) AS share FROM v_orders GROUP BY 1")
def zone_share(t: Inputs) -> DataFrame:
    by_zone = t.orders().groupBy("zone_id").agg(F.sum("parcels").alias("parcels"))
    total = F.sum("parcels").over(Window.partitionBy())
    return by_zone.select("zone_id", "parcels", F.round(F.col("parcels") / total, 9).alias("share"))


@query("parcel_shares", """SELECT count(*) AS orders, CAST(sum(parcels) AS BIGINT) AS parcels, round(sum(parcels) / count(*), 9) AS parcels_per_stop,
 round(sum(parcels) FILTER (customer_type = 'B2B') / sum(parcels), 9) AS b2b, round(sum(parcels) FILTER (service_level = 'same_day') / sum(parcels), 9) AS same_day,
 round(sum(parcels) FILTER (wave = 'morning') / sum(parcels), 9) AS morning, round(sum(parcels) FILTER (parcel_size = 'small') / sum(parcels), 9) AS small,
 round(sum(parcels) FILTER (parcel_size = 'medium') / sum(parcels), 9) AS medium, round(sum(parcels) FILTER (parcel_size = 'large') / sum(parcels), 9) AS large FROM v_orders""")  # fmt: skip
def parcel_shares(t: Inputs) -> DataFrame:
    total = F.sum("parcels")

    def share(condition: Column) -> Column:
        return F.round(F.sum(F.when(condition, F.col("parcels"))) / total, 9)

    return t.orders().agg(
        F.count(F.lit(1)).alias("orders"),
        total.alias("parcels"),
        F.round(total / F.count(F.lit(1)), 9).alias("parcels_per_stop"),
        share(F.col("customer_type") == "B2B").alias("b2b"),
        share(F.col("service_level") == "same_day").alias("same_day"),
        share(F.col("wave") == "morning").alias("morning"),
        *[share(F.col("parcel_size") == size).alias(size) for size in ("small", "medium", "large")],
    )


@query("services_up", """SELECT service, count(*) FILTER (up) AS up, count(*) FILTER (NOT up) AS down, CASE WHEN arg_max(up, (checked_at, probe_id)) THEN 'up' ELSE 'down' END AS now FROM v_health GROUP BY 1""")
def services_up(t: Inputs) -> DataFrame:
    latest = F.max_by("up", F.struct("checked_at", "probe_id"))
    return t.health().groupBy("service").agg(
        F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down"), F.when(latest, "up").otherwise("down").alias("now")
    )


@query("availability_series", """SELECT service, date_trunc('hour', checked_at) AS hour, round(avg(CASE WHEN up THEN 1e0 ELSE 0e0 END), 6) AS availability FROM v_health
WHERE checked_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2""")  # fmt: skip
def availability_series(t: Inputs) -> DataFrame:
    first, last = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-20 00:00:00"))
    seen = t.health().where(F.col("checked_at").between(first, last))
    return seen.groupBy("service", F.date_trunc("hour", "checked_at").cast("timestamp_ntz").alias("hour")).agg(
        F.round(F.avg(F.col("up").cast("double")), 6).alias("availability")
    )


@query("time_bucket", """SELECT vehicle_id, to_timestamp(epoch_us(event_time) // 900000000 * 900)::TIMESTAMP AS bucket, count(*) AS n, round(avg(speed_kmh), 6) AS avg_speed FROM v_telemetry GROUP BY 1, 2""")
def time_bucket(t: Inputs) -> DataFrame:
    return t.telemetry().groupBy("vehicle_id", F.window("event_time", "15 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("speed_kmh"), 6).alias("avg_speed")
    ).select("vehicle_id", F.col("w.start").alias("bucket"), "n", "avg_speed")


@query("distinct_zones", "SELECT service_date::VARCHAR AS day, count(DISTINCT zone_id) AS zones FROM v_orders GROUP BY 1")
def distinct_zones(t: Inputs) -> DataFrame:
    return t.orders().groupBy(F.col("service_date").cast("string").alias("day")).agg(F.countDistinct("zone_id").alias("zones"))


@query("set_digest", """SELECT zone_id, count(*) AS n_rows, CAST(CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(31), '=' || CAST(order_id AS VARCHAR), '=' || CAST(parcels AS VARCHAR), '=' || zone_id)), 1, 15)) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS digest
FROM v_orders GROUP BY 1""")  # fmt: skip
def set_digest(t: Inputs) -> DataFrame:
    return content_digest(t.orders().select("order_id", "zone_id", "parcels"), "zone_id")


@query("route_zone_list", """SELECT route_id, string_agg(DISTINCT zone_id, ',' ORDER BY zone_id) AS zones FROM v_plan_stops JOIN v_orders USING (order_id) GROUP BY 1""")
def route_zone_list(t: Inputs) -> DataFrame:
    """The distinct zones of each route as one ordered text; zones are a short list."""
    zones = t.orders().select("order_id", "zone_id")
    pairs = t.plan_stops().select("route_id", "order_id").join(zones, "order_id").select("route_id", "zone_id").distinct()
    return pairs.groupBy("route_id").agg(F.array_join(F.array_sort(F.collect_set("zone_id")), ",").alias("zones"))


@query("duplicate_keys", "SELECT vehicle_id, route_id, count(*) AS n FROM v_pings GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Inputs) -> DataFrame:
    return t.pings().groupBy("vehicle_id", "route_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("length_profile", """WITH n AS (SELECT language, length(text) AS len, row_number() OVER (PARTITION BY language ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM v_notes)
SELECT language, min(len) AS shortest, max(len) FILTER (i = n // 2) AS middle, max(len) AS longest, max(n) AS n FROM n GROUP BY 1""")  # fmt: skip
def length_profile(t: Inputs) -> DataFrame:
    sized = t.notes().select("language", F.char_length("text").cast("bigint").alias("len"))
    return upper_median(sized, ["language"], "len")


@query("ratio_std_error", """WITH s AS (SELECT sum(parcels) FILTER (customer_type = 'B2B') / sum(parcels) AS share FROM v_orders)
SELECT round(max(share), 9) AS share, round(sqrt(avg(power(parcels * (CASE WHEN customer_type = 'B2B' THEN 1 ELSE 0 END - share), 2)) / count(*)) / avg(parcels), 9) AS std_error FROM v_orders JOIN s ON true""")  # fmt: skip
def ratio_std_error(t: Inputs) -> DataFrame:
    """Share of business parcels and its standard error when parcels come in stops. The squared
    residuals are expanded into three sums, so one pass over the orders is enough."""
    w, h = F.col("parcels").cast("double"), (F.col("customer_type") == "B2B").cast("double")
    sums = t.orders().agg(
        F.sum(w).alias("w"), F.sum(w * h).alias("wh"), F.sum(w * w).alias("ww"), F.sum(w * w * h).alias("wwh"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("share", F.col("wh") / F.col("w"))
    # sum of (w (h - s))^2 with h in {0, 1}: wwh (1 - 2 s) + s^2 ww
    squares = F.col("wwh") * (1 - 2 * F.col("share")) + F.col("share") * F.col("share") * F.col("ww")
    error = F.sqrt(squares / F.col("n") / F.col("n")) / (F.col("w") / F.col("n"))
    return sums.select(F.round("share", 9).alias("share"), F.round(error, 9).alias("std_error"))


SHARES_SQL = "sh AS (SELECT *, weight / sum(weight) OVER () AS part FROM v_shippers), zs AS (SELECT *, share / sum(share) OVER () AS zpart FROM v_zones)"
BUSINESS_SQL = """pair AS (SELECT s.shipper_id, s.part * s.business_share AS mass, z.zone_id, z.zpart / sum(z.zpart) OVER (PARTITION BY s.shipper_id) AS f
 FROM (SELECT shipper_id, part, business_share, unnest(zones) AS zone_id FROM sh) s JOIN zs z USING (zone_id)),
bz AS (SELECT zone_id, sum(mass * f) AS business FROM pair GROUP BY 1)"""
FAIL_CONSUMER = {"low": 0.08, "medium": 0.1, "high": 0.14}
FAIL_BUSINESS = {"low": 0.02, "medium": 0.03, "high": 0.05}
EVENING_SHARE, EVENING_FACTOR = 0.4, 0.8


def shares_of_zones(t: Inputs) -> DataFrame:
    return t.zones().withColumn("zpart", F.col("share") / F.sum("share").over(Window.partitionBy()))


def shares_of_shippers(t: Inputs) -> DataFrame:
    """Shippers with their part of the day's parcels; the total is one row that joins every shipper."""
    total = one_row(t.shippers().agg(F.sum("weight").alias("_total")))
    return one_row(t.shippers()).join(total, "_one").withColumn("part", F.col("weight") / F.col("_total")).drop("_one", "_total")


def business_by_zone(t: Inputs) -> DataFrame:
    """Each shipper's business parcels spread over its zones in proportion to the zones' shares. A
    shipper's zone list is short, so its total is taken inside the row."""
    zones = shares_of_zones(t).select("zone_id", "zpart")
    lists = shares_of_shippers(t).select("shipper_id", (F.col("part") * F.col("business_share")).alias("mass"), F.explode("zones").alias("zone_id"))
    weighed = lists.join(zones, "zone_id")
    totals = weighed.groupBy("shipper_id").agg(F.sum("zpart").alias("_all"))
    return weighed.join(totals, "shipper_id").groupBy("zone_id").agg(
        F.sum(F.col("mass") * F.col("zpart") / F.col("_all")).alias("business")
    )


@query("spread_by_weight", f"WITH {SHARES_SQL}, {BUSINESS_SQL} SELECT zone_id, round(business, 9) AS business FROM bz")
def spread_by_weight(t: Inputs) -> DataFrame:
    return business_by_zone(t).select("zone_id", F.round("business", 9).alias("business"))


@query("model_shares", f"WITH {SHARES_SQL} SELECT round(sum(part * business_share), 9) AS business, round(sum(part * same_day_share), 9) AS same_day FROM sh")
def model_shares(t: Inputs) -> DataFrame:
    total = F.sum("weight")
    return t.shippers().agg(
        F.round(F.sum(F.col("weight") * F.col("business_share")) / total, 9).alias("business"),
        F.round(F.sum(F.col("weight") * F.col("same_day_share")) / total, 9).alias("same_day"),
    )


def _case(column: str, odds: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in odds.items()) + " END"


@query("expected_failure", f"""WITH {SHARES_SQL}, {BUSINESS_SQL}, zz AS (SELECT zs.*, coalesce(business, 0) AS business, zpart - coalesce(business, 0) AS left_ FROM zs LEFT JOIN bz USING (zone_id)),
x AS (SELECT part * (1 - business_share) * left_ / sum(left_) OVER (PARTITION BY shipper_id) AS w, {_case("difficulty", FAIL_CONSUMER)} * (1 - CASE WHEN midday THEN 1e0 ELSE {EVENING_SHARE}e0 END + CASE WHEN midday THEN 1e0 ELSE {EVENING_SHARE}e0 END * {EVENING_FACTOR}e0) AS p FROM sh JOIN zz ON true),
c AS (SELECT sum(w * p) AS f, sum(w) AS n FROM x), b AS (SELECT sum(business * {_case("difficulty", FAIL_BUSINESS)}) AS f, sum(business) AS n FROM zz)
SELECT round(c.f / c.n, 9) AS consumer, round(b.f / b.n, 9) AS business, round((c.f + b.f) / (c.n + b.n), 9) AS overall FROM c JOIN b ON true""")  # fmt: skip
def expected_failure(t: Inputs) -> DataFrame:
    """Expected first-attempt failures by recipient. The weight of a shipper and the odds of a zone are
    independent, so the sum over all pairs is a product of two sums and no pair is ever made."""
    def odds(table: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("difficulty"))

    evening = F.when(F.col("midday"), F.lit(1.0)).otherwise(F.lit(EVENING_SHARE))
    mass = F.col("weight") * (1 - F.col("business_share"))
    shippers = one_row(t.shippers().agg(
        (F.sum(mass) / F.sum("weight")).alias("mass"),
        (F.sum(mass * (1 - evening + evening * F.lit(EVENING_FACTOR))) / F.sum("weight")).alias("eased"),
    ))
    zones = shares_of_zones(t).join(business_by_zone(t), "zone_id", "left").withColumn("business", F.coalesce("business", F.lit(0.0)))
    left = F.col("zpart") - F.col("business")
    by_zone = one_row(zones.agg(
        (F.sum(left * odds(FAIL_CONSUMER)) / F.sum(left)).alias("p"),
        F.sum(F.col("business") * odds(FAIL_BUSINESS)).alias("bf"),
        F.sum("business").alias("bn"),
    ))
    both = shippers.join(by_zone, "_one")
    consumer = F.col("eased") * F.col("p")
    return both.select(
        F.round(consumer / F.col("mass"), 9).alias("consumer"),
        F.round(F.col("bf") / F.col("bn"), 9).alias("business"),
        F.round((consumer + F.col("bf")) / (F.col("mass") + F.col("bn")), 9).alias("overall"),
    )


@query("route_main_zone", """SELECT route_id, zone_id, n FROM (SELECT route_id, zone_id, count(*) AS n, row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, zone_id) AS rn
FROM v_plan_stops JOIN v_orders USING (order_id) GROUP BY 1, 2) x WHERE rn = 1""")  # fmt: skip
def route_main_zone(t: Inputs) -> DataFrame:
    zones = t.orders().select("order_id", "zone_id")
    counted = t.plan_stops().select("route_id", "order_id").join(zones, "order_id").groupBy("route_id", "zone_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("zone_id", "n"), F.struct(-F.col("n"), F.col("zone_id")))
    return counted.groupBy("route_id").agg(best.alias("b")).select("route_id", "b.zone_id", "b.n")


@query("centroids", "SELECT zone_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS orders FROM v_orders GROUP BY 1")
def centroids(t: Inputs) -> DataFrame:
    return t.orders().groupBy("zone_id").agg(
        F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count(F.lit(1)).alias("orders")
    )


@query("zone_coverage", """SELECT z.zone_id, count(DISTINCT d.driver_id) FILTER (d.shift_id = 'morning') AS morning, count(DISTINCT d.driver_id) FILTER (d.shift_id = 'afternoon') AS afternoon
FROM v_zones z LEFT JOIN (SELECT driver_id, shift_id, unnest(zones) AS zone_id FROM v_drivers) d USING (zone_id) GROUP BY 1""")  # fmt: skip
def zone_coverage(t: Inputs) -> DataFrame:
    known = t.drivers().select("driver_id", "shift_id", F.explode(F.array_distinct("zones")).alias("zone_id"))
    per = known.groupBy("zone_id").agg(
        F.count_if(F.col("shift_id") == "morning").alias("morning"), F.count_if(F.col("shift_id") == "afternoon").alias("afternoon")
    )
    return t.zones().select("zone_id").join(per, "zone_id", "left").na.fill(0, ["morning", "afternoon"])


@query("plan_report", """WITH r AS (SELECT s.route_id, max(v.capacity) AS capacity, count(*) AS stops, sum(o.parcels) AS parcels, sum(s.leg_distance_km) AS km, count(*) FILTER (o.zone_id = v.home_zone_id) AS home,
 max(epoch_us(s.planned_arrival)) - min(epoch_us(s.planned_arrival)) AS span FROM v_plan_stops s JOIN v_orders o USING (order_id) JOIN v_vans v USING (vehicle_id) GROUP BY 1)
SELECT count(*) AS routes, CAST(sum(stops) AS BIGINT) AS stops, CAST(sum(parcels) AS BIGINT) AS parcels, max(stops) AS most_stops, min(stops) AS fewest_stops, round(sum(parcels) / sum(capacity), 9) AS load,
 round(sum(km), 3) AS km, count(*) FILTER (span > 23400000000) AS over_maximum, round(sum(home) / sum(stops), 9) AS home_share FROM r""")  # fmt: skip
def plan_report(t: Inputs) -> DataFrame:
    orders = t.orders().select("order_id", "zone_id", "parcels")
    vans = t.vans().select("vehicle_id", "capacity", "home_zone_id")
    stops = t.plan_stops().join(orders, "order_id").join(vans, "vehicle_id")
    routes = stops.groupBy("route_id").agg(
        F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("stops"), F.sum("parcels").alias("parcels"),
        F.sum("leg_distance_km").alias("km"), F.count_if(F.col("zone_id") == F.col("home_zone_id")).alias("home"),
        cal.minutes_between(F.min("planned_arrival"), F.max("planned_arrival")).alias("minutes"),
    )
    return routes.agg(
        F.count(F.lit(1)).alias("routes"), F.sum("stops").alias("stops"), F.sum("parcels").alias("parcels"),
        F.max("stops").alias("most_stops"), F.min("stops").alias("fewest_stops"),
        F.round(F.sum("parcels") / F.sum("capacity"), 9).alias("load"), F.round(F.sum("km"), 3).alias("km"),
        F.count_if(F.col("minutes") > 390).alias("over_maximum"), F.round(F.sum("home") / F.sum("stops"), 9).alias("home_share"),
    )


@query("held_orders", """SELECT o.wave, count(*) AS orders, count(*) FILTER (p.order_id IS NULL) AS held, CAST(coalesce(sum(o.parcels) FILTER (p.order_id IS NULL), 0) AS BIGINT) AS held_parcels
FROM v_orders o LEFT JOIN (SELECT DISTINCT order_id FROM v_plan_stops WHERE line_no > 2) p USING (order_id) GROUP BY 1""")  # fmt: skip
def held_orders(t: Inputs) -> DataFrame:
    """Orders no route took: here those without a third stop line."""
    planned = t.plan_stops().where("line_no > 2").select("order_id").distinct().withColumn("_planned", F.lit(True))
    marked = t.orders().select("order_id", "wave", "parcels").join(planned, "order_id", "left")
    held = F.col("_planned").isNull()
    return marked.groupBy("wave").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(held).alias("held"),
        F.coalesce(F.sum(F.when(held, F.col("parcels"))), F.lit(0)).alias("held_parcels"),
    )


NEED_SQL = """need AS (SELECT o.service_date, o.wave, o.zone_id, greatest(count(*) / max(z.stops_per_route), sum(z.minutes_per_stop + 3) / 330e0, sum(o.parcels) / 120e0) AS need
 FROM v_orders o JOIN v_zones z USING (zone_id) GROUP BY 1, 2, 3)"""


def area_needs(t: Inputs) -> DataFrame:
    """Routes each zone of a day and wave needs: by its stops, its minutes or its parcels, whichever is most."""
    counted = t.orders().groupBy("service_date", "wave", "zone_id").agg(F.count(F.lit(1)).alias("n"), F.sum("parcels").alias("parcels"))
    z = t.zones().select("zone_id", "stops_per_route", "minutes_per_stop")
    return counted.join(z, "zone_id").select(
        "service_date", "wave", "zone_id",
        F.greatest(
            F.col("n") / F.col("stops_per_route"), F.col("n") * (F.col("minutes_per_stop") + 3) / F.lit(330.0),
            F.col("parcels") / F.lit(120.0),
        ).alias("need"),
    )


@query("area_need", f"WITH {NEED_SQL} SELECT CAST(service_date AS VARCHAR) AS day, wave, zone_id, round(need, 9) AS need FROM need")
def area_need(t: Inputs) -> DataFrame:
    return area_needs(t).select(F.col("service_date").cast("string").alias("day"), "wave", "zone_id", F.round("need", 9).alias("need"))


@query("worst_gap", """WITH g AS (SELECT z.zone_id, coalesce(p, 0) / sum(coalesce(p, 0)) OVER () AS got, z.share / sum(z.share) OVER () AS wanted FROM v_zones z LEFT JOIN (SELECT zone_id, sum(parcels) AS p FROM v_orders GROUP BY 1) o USING (zone_id))
SELECT zone_id, round(got, 9) AS got, round(wanted, 9) AS wanted FROM g ORDER BY abs(got - wanted) DESC, zone_id LIMIT 1""")  # fmt: skip
def worst_gap(t: Inputs) -> DataFrame:
    by_zone = t.orders().groupBy("zone_id").agg(F.sum("parcels").alias("p"))
    every = Window.partitionBy()
    gaps = t.zones().join(by_zone, "zone_id", "left").select(
        "zone_id", (F.coalesce("p", F.lit(0)) / F.sum("p").over(every)).alias("got"), (F.col("share") / F.sum("share").over(every)).alias("wanted")
    )
    worst = F.min_by(F.struct("zone_id", "got", "wanted"), F.struct(-F.abs(F.col("got") - F.col("wanted")), F.col("zone_id")))
    return gaps.agg(worst.alias("w")).select("w.zone_id", F.round("w.got", 9).alias("got"), F.round("w.wanted", 9).alias("wanted"))


@query("most_common", "SELECT failure, n FROM (SELECT shipper_id AS failure, count(*) AS n FROM v_orders GROUP BY 1) x ORDER BY n DESC, failure LIMIT 5")
def most_common(t: Inputs) -> DataFrame:
    counted = t.orders().groupBy(F.col("shipper_id").alias("failure")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "failure").limit(5)


# Windows and allocation --------------------------------------------------------------------------


@query("order_ids", """SELECT order_id, concat('O-', strftime(service_date, '%Y%m%d'), '-', lpad(CAST(row_number() OVER (PARTITION BY service_date ORDER BY registered_at, order_id) AS VARCHAR), 6, '0')) AS order_name FROM v_orders""")
def order_ids(t: Inputs) -> DataFrame:
    orders = t.orders().select("order_id", "service_date", "registered_at")
    numbered = annotate(orders, ["service_date"], ["registered_at", "order_id"], Wanted(row_number="k"))
    return numbered.select(
        "order_id",
        F.concat(F.lit("O-"), F.date_format("service_date", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("order_name"),
    )


@query("counter_monotonic", """SELECT vehicle_id, count(*) FILTER (d < 0) AS odometer_falls, count(*) FILTER (e < 0) AS energy_falls, round(max(d), 6) AS largest_step
FROM (SELECT vehicle_id, odometer_km - lag(odometer_km) OVER w AS d, energy_used_total - lag(energy_used_total) OVER w AS e FROM v_telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_time)) x GROUP BY 1""")  # fmt: skip
def counter_monotonic(t: Inputs) -> DataFrame:
    stepped = annotate(
        t.telemetry(), ["vehicle_id"], ["event_time"],
        Wanted(previous={"odo": F.col("odometer_km"), "used": F.col("energy_used_total")}),
    )
    d, e = F.col("odometer_km") - F.col("odo"), F.col("energy_used_total") - F.col("used")
    return stepped.groupBy("vehicle_id").agg(
        F.count_if(d < 0).alias("odometer_falls"), F.count_if(e < 0).alias("energy_falls"), F.round(F.max(d), 6).alias("largest_step")
    )


@query("cadence_gaps", """SELECT event_id, gap_us FROM (SELECT event_id, epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY vehicle_id ORDER BY event_time)) AS gap_us FROM v_pings) x WHERE gap_us > 3600000000""")
def cadence_gaps(t: Inputs) -> DataFrame:
    """Pings that came more than an hour after the van's previous one."""
    seen = annotate(
        t.pings().select("event_id", "vehicle_id", "event_time"), ["vehicle_id"], ["event_time"],
        Wanted(previous={"before": F.col("event_time")}),
    )
    return seen.select("event_id", (micros("event_time") - micros("before")).alias("gap_us")).where("gap_us > 3600000000")


FORWARD_SQL = """h AS (SELECT event_id, vehicle_id, event_time, lat, lon, speed_kmh, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM v_pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_time)),
b AS (SELECT event_id, vehicle_id, event_time, CASE WHEN speed_kmh > 5 AND lat2 IS NOT NULL THEN ((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) % 360) + 360) % 360 END AS heading FROM h)"""


@query("bearing", f"WITH {FORWARD_SQL} SELECT event_id, round(heading, 4) AS heading FROM b")
def bearing(t: Inputs) -> DataFrame:
    return headings(t).select("event_id", F.round("heading", 4).alias("heading"))


def headings(t: Inputs) -> DataFrame:
    """Heading towards the next ping of a moving van, NULL while it stands."""
    pings = t.pings().select("event_id", "vehicle_id", "event_time", "lat", "lon", "speed_kmh")
    ahead = annotate(
        pings, ["vehicle_id"], ["event_time"], Wanted(following={"lat2": F.col("lat"), "lon2": F.col("lon")})
    )
    moving = (F.col("speed_kmh") > 5) & F.col("lat2").isNotNull()
    return ahead.withColumn("heading", F.when(moving, bearing_deg(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))))


@query("forward_fill", f"""WITH {FORWARD_SQL} SELECT event_id, round(coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY event_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 4) AS heading FROM b""")
def forward_fill(t: Inputs) -> DataFrame:
    """The last known heading is kept while the van stands; before the first one it is 0."""
    known = annotate(
        headings(t).select("event_id", "vehicle_id", "event_time", "heading"), ["vehicle_id"], ["event_time"], Wanted(last_known={"kept": F.col("heading")}),
    )
    return known.select("event_id", F.round(F.coalesce("kept", F.lit(0.0)), 4).alias("heading"))


@query("weight_cdf", """SELECT segment, k, round(CASE WHEN k = max(k) OVER (PARTITION BY segment) THEN 1e0 ELSE sum(w) OVER (PARTITION BY segment ORDER BY k) / sum(w) OVER (PARTITION BY segment) END, 9) AS cumulative
FROM (SELECT segment, shipper_id % 10 AS k, sum(weight) AS w FROM v_shippers GROUP BY 1, 2) x""")  # fmt: skip
def weight_cdf(t: Inputs) -> DataFrame:
    weights = t.shippers().groupBy("segment", (F.col("shipper_id") % 10).alias("k")).agg(F.sum("weight").alias("w"))
    return cumulative_share(weights, ["segment"], ["k"], "w", "cumulative").select("segment", "k", F.round("cumulative", 9).alias("cumulative"))


@query("route_names", """SELECT route_id, concat('R-', strftime(service_date, '%Y%m%d'), '-', zone_id, '-', upper(substr(wave, 1, 1)), CAST(row_number() OVER (PARTITION BY service_date, wave, zone_id ORDER BY route_no) AS VARCHAR)) AS route_name FROM v_routes""")
def route_names(t: Inputs) -> DataFrame:
    """Routes numbered inside their day, wave and zone: no more of them than the fleet has vans."""
    number = F.row_number().over(Window.partitionBy("service_date", "wave", "zone_id").orderBy("route_no"))
    return t.routes().select("route_id", "service_date", "zone_id", "wave", number.alias("n")).select(
        "route_id", route_name(F.col("service_date"), F.col("zone_id"), F.col("wave"), F.col("n")).alias("route_name")
    )


SWEEP_SQL = f"""c AS (SELECT zone_id, avg(lat) AS clat, avg(lon) AS clon FROM v_orders GROUP BY 1),
a AS (SELECT o.order_id, o.zone_id, o.parcels, round((((atan2(o.lat - clat, (o.lon - clon) * cos(radians(clat))) - atan2({HUB["lat"]}e0 - clat, ({HUB["lon"]}e0 - clon) * cos(radians(clat)))) % (2 * pi())) + 2 * pi()) % (2 * pi()), 9) AS angle FROM v_orders o JOIN c USING (zone_id)),
s AS (SELECT *, row_number() OVER w AS k, sum(parcels) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM a WINDOW w AS (PARTITION BY zone_id ORDER BY angle, order_id))"""


MAX_MINUTES = 12  # of a van's slice


def swept(t: Inputs, *more: Column) -> DataFrame:
    """Orders with their angle round the centre of their zone, from the direction of the depot, kept to
    nine digits so that equal angles stay equal in any engine."""
    orders = t.orders().select("order_id", "zone_id", "parcels", "lat", "lon", *more)
    middle = orders.groupBy("zone_id").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    start = sweep_angle(F.lit(HUB["lat"]), F.lit(HUB["lon"]), F.col("clat"), F.col("clon"))
    angle = sweep_angle(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) - start
    turn = F.lit(2.0) * F.pi()
    return orders.join(middle, "zone_id").select(*[c for c in orders.columns if c not in ("lat", "lon")], F.round(F.pmod(angle, turn), 9).alias("angle"))


@query("sweep_rank", f"WITH {SWEEP_SQL} SELECT order_id, zone_id, k AS sweep_rank FROM s")
def sweep_rank(t: Inputs) -> DataFrame:
    ranked = annotate(swept(t), ["zone_id"], ["angle", "order_id"], Wanted(row_number="sweep_rank"))
    return ranked.select("order_id", "zone_id", "sweep_rank")


@query("capacity_slices", f"""WITH {SWEEP_SQL}, v AS (SELECT home_zone_id AS zone_id, vehicle_id, sum(capacity) OVER (PARTITION BY home_zone_id ORDER BY vehicle_id) AS hi, sum(capacity) OVER (PARTITION BY home_zone_id) AS cap,
  row_number() OVER (PARTITION BY home_zone_id ORDER BY vehicle_id) AS i, count(*) OVER (PARTITION BY home_zone_id) AS n FROM v_vans),
u AS (SELECT s.*, (upto - parcels) / sum(parcels) OVER (PARTITION BY zone_id) AS u FROM s)
SELECT u.order_id, arg_min(v.vehicle_id, v.i) AS vehicle_id FROM u LEFT JOIN v ON u.zone_id = v.zone_id AND CASE WHEN v.i = v.n THEN 1e0 ELSE v.hi / v.cap END > u.u GROUP BY 1""")  # fmt: skip
def orders_to_vans(t: Inputs) -> DataFrame:
    vans = t.vans().select(F.col("home_zone_id").alias("zone_id"), "vehicle_id", "capacity")
    return capacity_slices(
        swept(t), vans, ["zone_id"], ["angle", "order_id"], "parcels", "vehicle_id", "capacity"
    ).select("order_id", "vehicle_id")


@query("limited_slices", f"""WITH RECURSIVE {SWEEP_SQL}, m AS (SELECT a.order_id, a.zone_id, strftime(o.service_date, '%Y-%m') AS month, a.angle, a.parcels, z.minutes_per_stop + a.parcels * 0.5e0 AS mins FROM a JOIN v_orders o USING (order_id) JOIN v_zones z ON z.zone_id = a.zone_id),
o AS (SELECT *, row_number() OVER w AS k, sum(parcels) OVER (w ROWS UNBOUNDED PRECEDING) AS p, sum(mins) OVER (w ROWS UNBOUNDED PRECEDING) AS t FROM m WINDOW w AS (PARTITION BY month, zone_id ORDER BY angle, order_id)),
g AS (SELECT month, zone_id, sum(parcels) AS total FROM o GROUP BY 1, 2),
f AS (SELECT home_zone_id AS zone_id, vehicle_id, capacity, row_number() OVER (PARTITION BY home_zone_id ORDER BY vehicle_id) AS i, count(*) OVER (PARTITION BY home_zone_id) AS n, sum(capacity) OVER (PARTITION BY home_zone_id) AS cap FROM v_vans),
r AS (SELECT month, zone_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST(0 AS HUGEINT) AS p0, 0e0 AS t0 FROM g
  UNION ALL SELECT r.month, r.zone_id, r.i + 1, min(o.k), min(o.p - o.parcels), min(o.t - o.mins)
  FROM r JOIN f ON f.zone_id = r.zone_id AND f.i = r.i JOIN g ON g.month = r.month AND g.zone_id = r.zone_id JOIN o ON o.month = r.month AND o.zone_id = r.zone_id AND o.k >= r.s
  WHERE o.p - r.p0 > f.capacity OR o.t - r.t0 > {MAX_MINUTES}e0 OR (f.i < f.n AND (o.p - o.parcels - r.p0) * f.cap >= g.total * f.capacity) GROUP BY r.month, r.zone_id, r.i),
e AS (SELECT r.month, r.zone_id, r.s, lead(r.s) OVER (PARTITION BY r.month, r.zone_id ORDER BY r.i) AS e, f.vehicle_id FROM r LEFT JOIN f ON f.zone_id = r.zone_id AND f.i = r.i)
SELECT o.order_id, e.vehicle_id FROM o JOIN e ON e.month = o.month AND e.zone_id = o.zone_id AND e.s <= o.k AND (e.e IS NULL OR o.k < e.e)""")  # fmt: skip
def orders_to_vans_by_limits(t: Inputs) -> DataFrame:
    """The orders of a month and zone cut into slices by parcels, minutes and share; what no van can take has none."""
    orders = swept(t, F.date_format("service_date", "yyyy-MM").alias("month")).join(t.zones().select("zone_id", "minutes_per_stop"), "zone_id")
    orders = orders.withColumn("minutes", F.col("minutes_per_stop") + F.col("parcels") * 0.5)
    vans = t.vans().select(F.col("home_zone_id").alias("zone_id"), "vehicle_id", "capacity")
    return limited_slices(
        orders, vans, ["month", "zone_id"], ["zone_id"], ["angle", "order_id"], "parcels", "minutes", "vehicle_id", "capacity", MAX_MINUTES
    ).select("order_id", "vehicle_id")


@query("rescale_keep_total", """WITH b AS (SELECT o.order_id, o.service_date, o.zone_id, z.minutes_per_stop * 60 AS base, coalesce(n.likely_longer_stop, false) AS flagged FROM v_orders o JOIN v_zones z USING (zone_id) LEFT JOIN v_notes n ON o.note_id = n.note_id),
g AS (SELECT service_date, zone_id, sum(base) AS total, coalesce(sum(base) FILTER (flagged), 0) AS marked FROM b GROUP BY 1, 2)
SELECT order_id, round(CASE WHEN marked = 0 OR total - marked <= 0 OR total - 1.5e0 * marked < 0.25e0 * (total - marked) THEN base WHEN flagged THEN base * 1.5e0 ELSE base * (total - 1.5e0 * marked) / (total - marked) END, 6) AS seconds
FROM b JOIN g USING (service_date, zone_id)""")  # fmt: skip
def rescale_keep_total(t: Inputs) -> DataFrame:
    """Stops with a note that lasts are 1.5 times as long, the others shorter so that the day and zone
    keep their total; nothing changes where too few others could make up for it."""
    factor = F.lit(1.5)
    labels = t.notes().select("note_id", "likely_longer_stop")
    z = t.zones().select("zone_id", (F.col("minutes_per_stop") * 60).alias("base"))
    stops = t.orders().select("order_id", "service_date", "zone_id", "note_id").join(z, "zone_id")
    stops = left_join_known(stops, labels, "note_id")
    stops = stops.withColumn("flagged", F.coalesce("likely_longer_stop", F.lit(False)))
    totals = stops.groupBy("service_date", "zone_id").agg(
        F.sum("base").alias("total"), F.coalesce(F.sum(F.when(F.col("flagged"), F.col("base"))), F.lit(0.0)).alias("marked")
    )
    rest = F.col("total") - F.col("marked")
    spare = F.col("total") - factor * F.col("marked")
    seconds = (
        F.when((F.col("marked") == 0) | (rest <= 0) | (spare < F.lit(0.25) * rest), F.col("base"))
        .when(F.col("flagged"), F.col("base") * factor)
        .otherwise(F.col("base") * spare / rest)
    )
    return stops.join(totals, ["service_date", "zone_id"]).select("order_id", F.round(seconds, 6).alias("seconds"))


@query("largest_remainder", """WITH d AS (SELECT service_date, sum(parcels) AS total FROM v_orders GROUP BY 1),
q AS (SELECT d.service_date, z.zone_id, d.total, d.total * z.share / sum(z.share) OVER (PARTITION BY d.service_date) AS quota FROM d JOIN v_zones z ON true),
r AS (SELECT *, floor(quota) AS base, row_number() OVER (PARTITION BY service_date ORDER BY floor(quota) - quota, zone_id) AS rn, total - sum(floor(quota)) OVER (PARTITION BY service_date) AS spare FROM q)
SELECT CAST(service_date AS VARCHAR) AS day, zone_id, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS parcels FROM r""")  # fmt: skip
def split_by_share(t: Inputs) -> DataFrame:
    """Each day's parcels split over the zones. The zone list travels inside the row of the day."""
    days = t.orders().groupBy("service_date").agg(F.sum("parcels").alias("total"))
    listed = one_row(t.zones().agg(F.collect_list(F.struct("zone_id", "share")).alias("zones")))
    offers = one_row(days).join(listed, "_one").select("service_date", "total", F.explode("zones").alias("z")).select("service_date", "total", "z.*")
    return largest_remainder(offers, ["service_date"], "zone_id", "share", "total", "parcels").select(
        F.col("service_date").cast("string").alias("day"), "zone_id", "parcels"
    )


@query("dhondt", f"""WITH {NEED_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY service_date, wave) AS areas FROM need),
bids AS (SELECT service_date, wave, zone_id, need / k AS bid, areas FROM m JOIN (SELECT unnest(range(1, {FLEET})) AS k) r ON k <= {FLEET} - areas),
won AS (SELECT *, row_number() OVER (PARTITION BY service_date, wave ORDER BY bid DESC, zone_id) AS rn FROM bids)
SELECT CAST(m.service_date AS VARCHAR) AS day, m.wave, m.zone_id, 1 + count(w.rn) AS routes FROM m LEFT JOIN won w ON m.service_date = w.service_date AND m.wave = w.wave AND m.zone_id = w.zone_id AND w.rn <= {FLEET} - w.areas GROUP BY 1, 2, 3""")  # fmt: skip
def routes_per_area(t: Inputs) -> DataFrame:
    seats = highest_averages(area_needs(t), ["service_date", "wave"], "zone_id", "need", F.lit(FLEET), "routes")
    return seats.select(F.col("service_date").cast("string").alias("day"), "wave", "zone_id", "routes")


@query("promised_window", """SELECT s.order_id, s.line_no, CASE WHEN o.window_type <> 'wave' THEN o.window_start ELSE CAST(s.service_date AS TIMESTAMP) + to_minutes(CAST(least(greatest(CAST(floor(((epoch_us(s.planned_arrival) - epoch_us(CAST(s.service_date AS TIMESTAMP))) / 60e6 - 60) / 30) AS BIGINT) * 30,
 CASE WHEN o.wave = 'morning' THEN 480 ELSE 900 END), CASE WHEN o.wave = 'morning' THEN 900 ELSE 1320 END - 120) AS BIGINT)) END AS promised_start FROM v_plan_stops s JOIN v_orders o USING (order_id)""")  # fmt: skip
def promised_window(t: Inputs) -> DataFrame:
    """The 120 minutes promised: the order's own window, or one set from the planned arrival."""
    orders = t.orders().select("order_id", "wave", "window_type", "window_start")
    stops = t.plan_stops().select("order_id", "line_no", "service_date", "planned_arrival").join(orders, "order_id")
    midnight = F.col("service_date").cast("timestamp_ntz")
    arrival = cal.minutes_between(midnight, F.col("planned_arrival"))
    opens = F.when(F.col("wave") == "morning", 480).otherwise(900)
    closes = F.when(F.col("wave") == "morning", 900).otherwise(1320)
    start = cal.promised_start(arrival, opens, closes, 120)
    set_ = stops.withColumn("m", start).withColumn("midnight", midnight)
    moment = F.when(F.col("window_type") != "wave", F.col("window_start")).otherwise(F.expr("midnight + make_dt_interval(0, 0, m)"))
    return set_.select("order_id", "line_no", moment.alias("promised_start"))


# Streams as tables -------------------------------------------------------------------------------


@query("merged_timeline", """SELECT event_time, source, event_id FROM (SELECT event_time, 'ping' AS source, event_id FROM v_pings UNION ALL SELECT event_time, 'scan', event_id FROM v_scans) m ORDER BY event_time, source, event_id""")
def merged_timeline(t: Inputs) -> DataFrame:
    pings = t.pings().select("event_time", F.lit("ping").alias("source"), "event_id")
    scans = t.scans().select("event_time", F.lit("scan").alias("source"), "event_id")
    return pings.unionByName(scans).orderBy("event_time", "source", "event_id")


@query("table_state", """SELECT 'pings' AS table_name, count(*) AS n_rows, max(event_time) AS newest FROM v_pings UNION ALL SELECT 'scans', count(*), max(event_time) FROM v_scans
UNION ALL SELECT 'telemetry', count(*), max(event_time) FROM v_telemetry""")  # fmt: skip
def table_state(t: Inputs) -> DataFrame:
    def state(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.max("event_time").alias("newest"))

    return state("pings", t.pings()).unionByName(state("scans", t.scans())).unionByName(state("telemetry", t.telemetry()))


@query("same_multiset", """WITH a AS (SELECT order_id, status FROM v_scans), b AS (SELECT order_id, CASE WHEN event_time < TIMESTAMP '2024-01-15 00:00:00' THEN status ELSE 'arrived' END AS status FROM v_scans)
SELECT order_id, status, CAST(sum(c) AS BIGINT) AS surplus FROM (SELECT *, 1 AS c FROM a UNION ALL SELECT *, -1 FROM b) u GROUP BY 1, 2 HAVING sum(c) <> 0""")  # fmt: skip
def same_multiset(t: Inputs) -> DataFrame:
    """Rows that differ between two runs, the second of which lost the status of the later scans."""
    scans = t.scans().select("order_id", "status", "event_time")
    late = F.col("event_time") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    second = scans.withColumn("status", F.when(late, "arrived").otherwise(F.col("status")))
    return multiset_difference(scans.select("order_id", "status"), second.select("order_id", "status"))


@query("missing_members", """SELECT z.zone_id FROM v_zones z WHERE NOT EXISTS (SELECT 1 FROM v_routes r WHERE r.zone_id = z.zone_id)""")
def missing_members(t: Inputs) -> DataFrame:
    return t.zones().select("zone_id").join(t.routes().select("zone_id").distinct(), "zone_id", "left_anti")


@query("door_sessions", """WITH m AS (SELECT vehicle_id, event_time, cargo_door_open AS o, coalesce(lag(cargo_door_open) OVER w, false) AS was, lead(event_time) OVER w AS nxt FROM v_telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_time)),
s AS (SELECT *, sum(CASE WHEN o AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY event_time) AS k FROM m)
SELECT vehicle_id, min(event_time) AS opened_at, max(coalesce(nxt, event_time)) AS closed_at, count(*) AS readings FROM s WHERE o GROUP BY vehicle_id, k""")  # fmt: skip
def door_sessions(t: Inputs) -> DataFrame:
    """How long the cargo door stayed open at each stop."""
    readings = t.telemetry().select("vehicle_id", "event_time", "cargo_door_open")
    return sessions(readings, ["vehicle_id"], ["event_time"], "event_time", F.col("cargo_door_open")).drop("_session")


@query("dim_bridge_driver_zone", "SELECT driver_id, zone_id, norm FROM (SELECT driver_id, unnest(zones) AS zone_id FROM v_drivers) d JOIN (SELECT zone_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS norm FROM v_zones) z USING (zone_id)")
def driver_zone_bridge(t: Inputs) -> DataFrame:
    pairs = t.drivers().select("driver_id", F.explode("zones").alias("zone_id"))
    return pairs.join(t.zones().select("zone_id", norm_text(F.col("name")).alias("norm")), "zone_id")



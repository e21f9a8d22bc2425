"""Silver and gold models, data-quality reports and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspan.functions import ids, text
from parcelspan.functions.calendar import minute_of_day, minutes_between
from parcelspan.operators import sampling
from parcelspan.operators.allocate import cumulative_share, pick_by_share
from parcelspan.operators.expectations import Expectation, check_table, orphans
from parcelspan.operators.keyed import latest_per_key
from parcelspan.operators.ordered import Wanted, annotate
from parcelspan.plans.inputs import Inputs
from parcelspan.plans.kpi import DURATIONS_SQL, FINAL, MINUTES, route_durations
from parcelspan.plans.registers import CONTEXT_SQL, PLACE_SQL, contexts
from parcelspan.plans.registry import query
from parcelspan.session import small_table
from parcelspan.sources.documents import WMO_CODES

# Dimensions --------------------------------------------------------------------------------------


@query("dim_hub", "SELECT concat('H', CAST(r_regionkey AS VARCHAR)) AS hub_id, r_name AS name, count(n_nationkey) AS zones FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def dim_hub(t: Inputs) -> DataFrame:
    per = t.table("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("zones"))
    return t.table("region").join(per, "r_regionkey", "left").select(
        F.concat(F.lit("H"), F.col("r_regionkey").cast("string")).alias("hub_id"), F.col("r_name").alias("name"),
        F.coalesce("zones", F.lit(0)).alias("zones"),
    )


@query("dim_zone", "SELECT zone_id, name, round(share, 6) AS share, stops_per_route, minutes_per_stop, difficulty, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_zones")
def dim_zone(t: Inputs) -> DataFrame:
    return t.zones().select(
        "zone_id", "name", F.round("share", 6).alias("share"), "stops_per_route", "minutes_per_stop", "difficulty",
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
    )


@query("dim_shift", "SELECT shift_id, count(*) AS drivers FROM v_drivers GROUP BY 1")
def dim_shift(t: Inputs) -> DataFrame:
    return t.drivers().groupBy("shift_id").agg(F.count(F.lit(1)).alias("drivers"))


@query("dim_vehicle_type", "SELECT type_id, count(*) AS vans, min(capacity) AS least_capacity, max(capacity) AS greatest_capacity FROM v_vans GROUP BY 1")
def dim_vehicle_type(t: Inputs) -> DataFrame:
    return t.vans().groupBy("type_id").agg(
        F.count(F.lit(1)).alias("vans"), F.min("capacity").alias("least_capacity"), F.max("capacity").alias("greatest_capacity")
    )


@query("dim_vehicle", "SELECT vehicle_id, home_zone_id, type_id, capacity, afternoon FROM v_vans")
def dim_vehicle(t: Inputs) -> DataFrame:
    return latest_per_key(t.vans(), ["vehicle_id"], ["capacity", "type_id"])


@query("dim_driver", "SELECT driver_id, shift_id, array_to_string(zones, ',') AS zones, array_to_string(vehicle_types, ',') AS vehicle_types FROM v_drivers")
def dim_driver(t: Inputs) -> DataFrame:
    return t.drivers().select(
        "driver_id", "shift_id", F.array_join("zones", ",").alias("zones"), F.array_join("vehicle_types", ",").alias("vehicle_types")
    )


@query("dim_shipper", "SELECT shipper_id, name, segment, weight, business_share, same_day_share, array_to_string(zones, ',') AS zones FROM v_shippers")
def dim_shipper(t: Inputs) -> DataFrame:
    return t.shippers().select("shipper_id", "name", "segment", "weight", "business_share", "same_day_share", F.array_join("zones", ",").alias("zones"))


# Facts -------------------------------------------------------------------------------------------

HISTORY_SQL = "hist AS (SELECT route_id, min(service_date) AS service_date, min(planned_arrival) AS departed_at, max(actual_arrival) AS completed_at FROM v_plan_stops GROUP BY 1)"


@query("fct_route", f"""WITH {DURATIONS_SQL}, {HISTORY_SQL}
SELECT 'live' AS origin, route_id, CAST(service_date AS VARCHAR) AS day, departed_at, completed_at, round(minutes, 9) AS minutes, planned_minutes FROM k JOIN v_routes USING (route_id)
UNION ALL SELECT 'history', route_id, CAST(service_date AS VARCHAR), departed_at, completed_at, round({MINUTES.format(a="departed_at", b="completed_at")}, 9), NULL FROM hist""")  # fmt: skip
def fct_route(t: Inputs) -> DataFrame:
    """One row per route: the live ones measured from the streams, the past ones as they were reported."""
    columns = ["origin", "route_id", "day", "departed_at", "completed_at", "minutes", "planned_minutes"]
    live = route_durations(t).join(t.routes(), "route_id").withColumn("origin", F.lit("live"))
    past = t.plan_stops().groupBy("route_id").agg(
        F.min("service_date").alias("service_date"), F.min("planned_arrival").alias("departed_at"), F.max("actual_arrival").alias("completed_at")
    ).select(
        "*", F.lit("history").alias("origin"), F.lit(None).cast("double").alias("planned_minutes"),
        minutes_between(F.col("departed_at"), F.col("completed_at")).alias("minutes"),
    )
    both = live.withColumn("day", F.col("service_date").cast("string")).select(*columns).unionByName(
        past.withColumn("day", F.col("service_date").cast("string")).select(*columns)
    )
    return both.withColumn("minutes", F.round("minutes", 9))


DELIVERY_SQL = """last AS (SELECT order_id, route_id, status, failure_reason, event_time, pod_object_key FROM v_scans WHERE status IN ('delivered', 'failed')
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY event_time DESC, event_id DESC) = 1),
del AS (SELECT p.order_id, last.route_id, last.status, last.failure_reason, last.event_time AS finished_at, coalesce(last.status = 'delivered' AND last.event_time BETWEEN p.window_start AND p.window_end, false) AS in_window, last.pod_object_key
  FROM v_promises p LEFT JOIN last USING (order_id))"""


def deliveries(t: Inputs) -> DataFrame:
    """One row per order: its latest final scan, whether it came inside the promise, its photo."""
    scans = t.scans().where(F.col("status").isin(*FINAL))
    last = latest_per_key(scans, ["order_id"], ["event_time", "event_id"]).select(
        "order_id", "route_id", "status", "failure_reason", F.col("event_time").alias("finished_at"), "pod_object_key"
    )
    inside = (F.col("status") == "delivered") & F.col("finished_at").between(F.col("window_start"), F.col("window_end"))
    return t.promises().join(last, "order_id", "left").withColumn("in_window", F.coalesce(inside, F.lit(False))).select(
        "order_id", "route_id", "status", "failure_reason", "finished_at", "in_window", "pod_object_key"
    )


@query("fct_delivery", f"WITH {DELIVERY_SQL} SELECT * FROM del")
def fct_delivery(t: Inputs) -> DataFrame:
    return deliveries(t)


@query("fct_deliveries", f"WITH {DELIVERY_SQL} SELECT del.order_id, del.status, del.in_window, del.pod_object_key, r.wave, r.type_id, z.name AS zone_name FROM del LEFT JOIN v_routes r USING (route_id) LEFT JOIN v_zones z ON r.zone_id = z.zone_id")
def fct_deliveries(t: Inputs) -> DataFrame:
    """One row per order for the dashboards."""
    zones = t.zones().select("zone_id", F.col("name").alias("zone_name"))
    routes = t.routes().join(zones, "zone_id", "left").select("route_id", "wave", "type_id", "zone_name")
    return deliveries(t).join(routes, "route_id", "left").select(
        "order_id", "status", "in_window", "pod_object_key", "wave", "type_id", "zone_name"
    )


STATES = ("no data", "very fluid", "fluid", "dense", "very dense", "congested", "closed")  # fixed values: codes 0 to 6


@query("fct_traffic", f"""SELECT feed_item_id AS section_id, event_time, state, [{", ".join(f"'{s}'" for s in STATES)}][state + 1] AS state_name FROM v_traffic WHERE feed = 'trams'""")
def fct_traffic(t: Inputs) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, STATES)), F.col("state") + 1)
    return t.traffic().where("feed = 'trams'").select(F.col("feed_item_id").alias("section_id"), "event_time", "state", name.alias("state_name"))


@query("fct_weather", f"""SELECT zone_id, read_at, weather_code, CASE weather_code {" ".join(f"WHEN {c} THEN '{n}'" for c, n in WMO_CODES.items())} END AS weather, round(precipitation_mm, 6) AS precipitation_mm FROM v_weather""")
def fct_weather(t: Inputs) -> DataFrame:
    codes = small_table(t.spark, list(WMO_CODES.items()), "weather_code int, weather string")
    return t.weather().join(codes, "weather_code", "left").select(
        "zone_id", "read_at", "weather_code", "weather", F.round("precipitation_mm", 6).alias("precipitation_mm")
    )


# Data quality ------------------------------------------------------------------------------------

# (table, key, rules); a rule is its name, its severity and what must hold, in SQL both engines read.
RULES: tuple[tuple[str, str, tuple[tuple[str, str, str], ...]], ...] = (
    ("orders", "order_id", (
        ("coordinates_in_area", "error", "lat BETWEEN 40.5 AND 42.9 AND lon BETWEEN 0.1 AND 3.4"),
        ("window_ends_after_start", "error", "window_end > window_start"),
        ("service_level_listed", "error", "service_level IN ('same_day', 'next_day')"),
        ("window_type_listed", "error", "window_type IN ('slot', 'wave')"),
        ("same_day_before_cutoff", "warning", "service_level <> 'same_day' OR (CAST(registered_at AS DATE) = service_date AND hour(registered_at) < 12)"),
    )),
    ("scans", "event_id", (
        ("failed_has_reason", "error", "status <> 'failed' OR failure_reason IS NOT NULL"),
        ("photo_only_delivered", "error", "pod_object_key IS NULL OR status = 'delivered'"),
        ("status_listed", "error", "status IN ('delivered', 'failed', 'arrived')"),
    )),
    ("telemetry", "vehicle_id", (
        ("speed_in_range", "warning", "speed_kmh BETWEEN 0 AND 20"),
        ("counter_not_negative", "error", "energy_used_total >= 0"),
    )),
    ("vans", "vehicle_id", (
        ("type_listed", "error", "type_id IN ('electric', 'diesel', 'cng')"),
        ("capacity_holds_a_route", "warning", "capacity >= 100"),
    )),
    ("shippers", "shipper_id", (("zones_when_business", "error", "business_share = 0 OR zones IS NOT NULL"),
        ("shares_in_range", "error", "business_share BETWEEN 0 AND 1 AND same_day_share BETWEEN 0 AND 0.5"),
    )),
    ("zones", "zone_id", (("route_fits_shift", "warning", "stops_per_route * minutes_per_stop <= 200"),
        ("difficulty_listed", "error", "difficulty IN ('low', 'medium', 'high')"),
    )),
)


def _rule_sql() -> str:
    parts = []
    for table, key, rules in RULES:
        for rule, severity, holds in rules:
            failed = f"NOT coalesce({holds}, true)"
            parts.append(
                f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{severity}' AS severity, count(*) AS checked, count(*) FILTER ({failed}) AS failed_rows,"
                f" min(CAST({key} AS VARCHAR)) FILTER ({failed}) AS sample_key FROM v_{table}"
            )
    return " UNION ALL ".join(parts)


@query("dq_report", _rule_sql())
def dq_report(t: Inputs) -> DataFrame:
    """Every value rule of every table: one pass over each table."""
    report: DataFrame | None = None
    for table, key, rules in RULES:
        checks = [Expectation(rule, F.expr(holds), severity) for rule, severity, holds in rules]
        part = check_table(table, getattr(t, table)(), key, checks)
        report = part if report is None else report.unionByName(part)
    return report


# What the given tables lack is derived from them, by expressions that both dialects read; each rule has rows that fail.
OPERATIONS = (
    ("fleet", "vehicle_id", "supplier", """concat('V-', CAST(s_suppkey AS STRING)) AS vehicle_id,
  concat(lpad(CAST(s_suppkey * 37 % 10000 AS STRING), 4, '0'), CASE WHEN s_suppkey % 9 = 0 THEN ' ABC' ELSE ' BCD' END) AS plate,
  CASE s_suppkey % 3 WHEN 0 THEN 'electric' WHEN 1 THEN 'diesel' ELSE 'cng' END AS type_id,
  CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 17 = 0 THEN 0.9 END AS battery_health,
  CASE WHEN s_suppkey % 13 = 0 THEN 'bar' WHEN s_suppkey % 3 = 0 THEN 'kWh' WHEN s_suppkey % 3 = 1 THEN 'l' ELSE 'kg' END AS energy_unit,
  CASE WHEN s_suppkey % 19 = 0 THEN 'Z' WHEN s_suppkey % 3 = 0 THEN '0' ELSE 'C' END AS label, s_suppkey % 7 AS routes""", (
        ("plate_well_formed", "error", "{plate}"),
        ("battery_iff_electric", "error", "(battery_health IS NOT NULL) = (type_id = 'electric')"),
        ("energy_unit_of_type", "error", "energy_unit = CASE type_id WHEN 'electric' THEN 'kWh' WHEN 'diesel' THEN 'l' ELSE 'kg' END"),
        ("label_listed", "error", "label IN ('0', 'ECO', 'C', 'B')"),
        ("routes_plausible", "warning", "routes BETWEEN 1 AND 5"),
    )),
    ("orders", "order_id", "orders", """o_orderkey AS order_id, o_orderpriority AS priority, o_orderkey % 3 AS plan_version, o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 AS baseline,
  CASE WHEN o_orderkey % 101 <> 0 THEN 'generator/orders' END AS source, CASE WHEN o_orderkey % 103 <> 0 THEN 1 END AS schema_version,
  CASE WHEN o_orderkey % 107 <> 0 THEN 'operations' END AS owner, CASE WHEN o_orderkey % 109 <> 0 THEN o_orderdate END AS ingested_at""", (
        ("priority_listed", "error", "priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')"),
        ("version_zero_is_baseline", "error", "baseline = (plan_version = 0)"),
        ("metadata_present", "error", "source IS NOT NULL AND schema_version IS NOT NULL AND owner IS NOT NULL AND ingested_at IS NOT NULL"),
    )),
    ("routes", "route_id", "(SELECT l_orderkey, count(*) AS planned, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS delivered,"
     " sum(CASE WHEN l_returnflag = 'R' OR l_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS failed, min(l_shipdate) AS departed, max(l_shipdate) AS completed FROM lineitem GROUP BY l_orderkey) g",
     "l_orderkey AS route_id, planned, delivered, failed, departed, completed", (
        ("stops_within_plan", "error", "delivered + failed <= planned"),
        ("completed_after_departure", "error", "completed > departed"),
    )),
    ("traffic", "section", "events", "event_id AS section, event_id % 8 AS state, CAST(event_id % 97 AS DOUBLE) AS stops, CAST(event_id % 89 AS DOUBLE) AS area_km2", (
        ("state_listed", "error", "state BETWEEN 0 AND 6"),
        # A tour of n stops spread over an area is no shorter than about 0.7124 * sqrt(n * area).
        ("zone_fits_longest_route", "warning", "0.7124 * sqrt(stops * area_km2) <= 60"),
    )),
)
PLATE_SQL = "regexp_matches(plate, '^[0-9]{4} [BCDFGHJKLMNPRSTVWXYZ]{3}$')"


def _operations_sql() -> str:
    parts = []
    for name, key, source, columns, rules in OPERATIONS:
        for rule, severity, holds in rules:
            failed = f"NOT coalesce({holds.format(plate=PLATE_SQL)}, true)"
            parts.append(
                f"SELECT '{name}' AS table_name, '{rule}' AS rule, '{severity}' AS severity, count(*) AS checked, count(*) FILTER ({failed}) AS failed_rows,"
                f" min(CAST({key} AS VARCHAR)) FILTER ({failed}) AS sample_key FROM (SELECT {columns} FROM {source}) x"
            )
    return " UNION ALL ".join(parts)


@query("dq_operations", _operations_sql())
def dq_operations(t: Inputs) -> DataFrame:
    """Formats, closed lists, conditional presence, metadata and cross-column rules of fleet, orders, routes and traffic."""
    report: DataFrame | None = None
    for name, key, source, columns, rules in OPERATIONS:
        if source.startswith("("):
            rows = t.table("lineitem").groupBy("l_orderkey").agg(
                F.count(F.lit(1)).alias("planned"), F.count_if(F.col("l_returnflag") != "R").alias("delivered"),
                F.count_if((F.col("l_returnflag") == "R") | (F.col("l_orderkey") % 50 == 0)).alias("failed"),
                F.min("l_shipdate").alias("departed"), F.max("l_shipdate").alias("completed"),
            ).withColumnRenamed("l_orderkey", "route_id")
        else:
            rows = t.table(source).selectExpr(*_split(columns))
        checks = [
            Expectation(rule, F.col("plate").rlike(text.PLATE) if holds == "{plate}" else F.expr(holds), severity) for rule, severity, holds in rules
        ]
        part = check_table(name, rows, key, checks)
        report = part if report is None else report.unionByName(part)
    return report


def _split(columns: str) -> list[str]:
    """The select list's columns: commas outside brackets part them."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query("dq_note_texts", """SELECT language, count(*) AS orders, count(*) FILTER (md5(said) <> md5(text)) AS other_text FROM (SELECT n.language, n.text, CASE WHEN o.order_id % 29 = 0 THEN concat(n.text, '!') ELSE n.text END AS said
 FROM v_orders o JOIN v_notes n ON o.note_id = n.note_id) x GROUP BY 1""")  # fmt: skip
def dq_note_texts(t: Inputs) -> DataFrame:
    """Orders whose notes are not the text of the note they name; texts are compared by digest and don't travel."""
    notes = t.notes().select("note_id", "language", F.md5(F.col("text").cast("binary")).alias("own"), F.md5(F.concat("text", F.lit("!")).cast("binary")).alias("other"))
    per_note = t.orders().where("note_id IS NOT NULL").groupBy("note_id", (F.col("order_id") % 29 == 0).alias("changed")).agg(F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("changed"), F.col("other")).otherwise(F.col("own"))
    return per_note.join(notes, "note_id").groupBy("language").agg(
        F.sum("n").alias("orders"), F.coalesce(F.sum(F.when(said != F.col("own"), F.col("n"))), F.lit(0).cast("bigint")).alias("other_text")
    )


@query("dq_relationships", """SELECT 'orders' AS table_name, 'note is known' AS rule, 'error' AS severity, count(*) AS failed_rows, min(CAST(note_id AS VARCHAR)) AS sample_key FROM v_orders WHERE note_id IS NOT NULL AND note_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'orders', 'zone has vans', 'error', count(*), min(zone_id) FROM v_orders WHERE zone_id NOT IN (SELECT home_zone_id FROM v_vans)
UNION ALL SELECT 'scans', 'order is known', 'error', count(*), min(CAST(order_id AS VARCHAR)) FROM v_scans WHERE order_id NOT IN (SELECT order_id FROM v_orders)
UNION ALL SELECT 'addresses', 'street is known', 'error', count(*), min(street_code) FROM v_city WHERE street_code NOT IN (SELECT street_code FROM v_streets)
UNION ALL SELECT 'photos', 'scan is known', 'error', count(*), min(path) FROM v_photos WHERE path NOT IN (SELECT pod_object_key FROM v_scans WHERE pod_object_key IS NOT NULL)""")  # fmt: skip
def dq_relationships(t: Inputs) -> DataFrame:
    photos = t.scans().where("pod_object_key IS NOT NULL")
    return (
        orphans("orders", "note is known", t.orders(), "note_id", t.table("labels"), "doc_id")
        .unionByName(orphans("orders", "zone has vans", t.orders(), "zone_id", t.vans(), "home_zone_id"))
        .unionByName(orphans("scans", "order is known", t.scans(), "order_id", t.orders(), "order_id"))
        .unionByName(orphans("addresses", "street is known", t.city_addresses(), "street_code", t.streets(), "street_code"))
        .unionByName(orphans("photos", "scan is known", t.photos(), "path", photos, "pod_object_key"))
    )


@query("dq_sums", """SELECT 'zone shares' AS figure, round(sum(share), 9) AS total, abs(sum(share) - 1) <= 0.00005 AS holds FROM v_zones
UNION ALL SELECT concat('shippers of ', segment), round(sum(part), 9), abs(sum(part) - 1) <= 0.00005 FROM (SELECT segment, weight / sum(weight) OVER (PARTITION BY segment) AS part FROM v_shippers) x GROUP BY segment""")  # fmt: skip
def dq_sums(t: Inputs) -> DataFrame:
    """Shares that should sum to 1 within a tolerance."""
    total = t.shippers().groupBy("segment").agg(F.sum("weight").alias("_all"))
    parts = t.shippers().join(total, "segment").select(
        F.concat(F.lit("shippers of "), "segment").alias("figure"), (F.col("weight") / F.col("_all")).alias("share")
    )
    every = t.zones().select(F.lit("zone shares").alias("figure"), "share").unionByName(parts)
    summed = every.groupBy("figure").agg(F.sum("share").alias("s"))
    return summed.select("figure", F.round("s", 9).alias("total"), (F.abs(F.col("s") - 1) <= 0.00005).alias("holds"))


TARGETS = (("noted", 1 / 3, 0.02), ("b2b", 0.3, 0.05), ("same_day", 0.2, 0.05), ("morning", 0.6, 0.02))


@query("dq_tolerance", " UNION ALL ".join(
    f"SELECT '{name}' AS figure, round(avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END), 9) AS measured, {target!r}e0 AS target, abs(avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END) - {target!r}e0) <= {tol!r}e0 AS holds FROM v_orders"
    for (name, target, tol), cond in zip(TARGETS, ("note_id IS NOT NULL", "customer_type = 'B2B'", "service_level = 'same_day'", "wave = 'morning'"))
))
def dq_tolerance(t: Inputs) -> DataFrame:
    """Figures of a day's orders against their targets."""
    measured = {
        "noted": F.col("note_id").isNotNull(), "b2b": F.col("customer_type") == "B2B",
        "same_day": F.col("service_level") == "same_day", "morning": F.col("wave") == "morning",
    }
    figures = t.orders().agg(*[F.avg(c.cast("double")).alias(n) for n, c in measured.items()])
    rows = F.array(*[
        F.struct(F.lit(n).alias("figure"), F.col(n).alias("m"), F.lit(target).alias("target"), F.lit(tol).alias("tol"))
        for n, target, tol in TARGETS
    ])
    return figures.select(F.explode(rows).alias("r")).select(
        "r.figure", F.round("r.m", 9).alias("measured"), "r.target", (F.abs(F.col("r.m") - F.col("r.target")) <= F.col("r.tol")).alias("holds")
    )


PHASES_SQL = "CASE status WHEN 'out_for_delivery' THEN 1 WHEN 'arrived' THEN 2 ELSE 3 END"


@query("dq_scan_sequence", f"""WITH p AS (SELECT order_id, status, {PHASES_SQL} AS phase, event_time, event_id FROM v_scans), l AS (SELECT *, lag(status) OVER w AS before, lag(phase) OVER w AS phase_before FROM p WINDOW w AS (PARTITION BY order_id ORDER BY event_time, event_id))
SELECT before, status AS after, count(*) AS n FROM l WHERE phase < phase_before GROUP BY 1, 2""")  # fmt: skip
def dq_scan_sequence(t: Inputs) -> DataFrame:
    """Scans that go back: an order is out, then arrived, then delivered or failed."""
    phase = F.when(F.col("status") == "out_for_delivery", 1).when(F.col("status") == "arrived", 2).otherwise(3)
    scans = t.scans().select("order_id", "status", "event_time", "event_id", phase.alias("phase"))
    seen = annotate(
        scans, ["order_id"], ["event_time", "event_id"],
        Wanted(previous={"before": F.col("status"), "phase_before": F.col("phase")}),
    )
    return seen.where("phase < phase_before").groupBy("before", F.col("status").alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("dq_personal_data", r"""SELECT language, count(*) AS notes, count(*) FILTER (regexp_matches(text, '(?:\+34[\s.-]?)?\b[6789]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}\b') OR regexp_matches(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b')
 OR regexp_matches(text, '(?i)\b(?:\d{8}|[XYZ]\d{7})[\s-]?[A-Z]\b')) AS with_personal_data FROM v_notes GROUP BY 1""")  # fmt: skip
def dq_personal_data(t: Inputs) -> DataFrame:
    return t.notes().groupBy("language").agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(text.has_personal_data(F.col("text"))).alias("with_personal_data")
    )


@query("dq_late_same_day", """SELECT wave, count(*) AS same_day_orders, count(*) FILTER (CAST(registered_at AS DATE) <> service_date OR hour(registered_at) * 60 + minute(registered_at) >= 660) AS after_cutoff FROM v_orders WHERE service_level = 'same_day' GROUP BY 1""")
def dq_late_same_day(t: Inputs) -> DataFrame:
    """Same-day orders registered after the 11:00 cut-off or on another day."""
    late = (F.col("registered_at").cast("date") != F.col("service_date")) | (minute_of_day(F.col("registered_at")) >= 660)
    return t.orders().where("service_level = 'same_day'").groupBy("wave").agg(
        F.count(F.lit(1)).alias("same_day_orders"), F.count_if(late).alias("after_cutoff")
    )


@query("dq_capacity", """SELECT count(*) AS days, max(parcels) AS busiest_day, max(cap) AS fleet_capacity, count(*) FILTER (parcels > cap) AS days_over FROM (SELECT service_date, CAST(sum(parcels) AS BIGINT) AS parcels FROM v_orders GROUP BY 1) d JOIN (SELECT CAST(sum(capacity) AS BIGINT) AS cap FROM v_vans) c ON true""")
def dq_capacity(t: Inputs) -> DataFrame:
    """Whether one trip of the whole fleet holds each day's parcels."""
    fleet = t.vans().agg(F.sum("capacity").alias("fleet_capacity")).withColumn("_one", F.lit(1))
    per_day = t.orders().groupBy("service_date").agg(F.sum("parcels").alias("parcels")).withColumn("_one", F.lit(1))
    return per_day.join(fleet, "_one").agg(
        F.count(F.lit(1)).alias("days"), F.max("parcels").alias("busiest_day"), F.max("fleet_capacity").alias("fleet_capacity"),
        F.count_if(F.col("parcels") > F.col("fleet_capacity")).alias("days_over"),
    )


# Working minutes of a shift without its break: a route has to fit into those of its wave.
SHIFT_MINUTES = {"morning": 450, "afternoon": 390}
ROUTES_PER_VAN = (0.5, 4.0)


@query("dq_fleet", f"""WITH day AS (SELECT service_date, sum(parcels) AS parcels FROM v_orders WHERE isodow(service_date) <= 5 GROUP BY 1),
m AS (SELECT (SELECT CAST(avg(parcels) AS DOUBLE) FROM day) AS mean_day, (SELECT CAST(sum(capacity) AS DOUBLE) FROM v_vans) AS capacity,
 (SELECT CAST(count(*) AS DOUBLE) FROM v_vans) AS vans, (SELECT CAST(count(*) AS DOUBLE) FROM v_drivers) AS drivers,
 (SELECT sum(share / stops_per_route) FROM v_zones) AS routes_per_parcel,
 (SELECT max(planned_minutes) FROM v_routes WHERE wave = 'morning') AS morning, (SELECT max(planned_minutes) FROM v_routes WHERE wave = 'afternoon') AS afternoon),
rules AS (SELECT 'fleet_holds_mean_weekday' AS rule, 'error' AS severity, capacity AS measured, mean_day AS lowest, CAST(NULL AS DOUBLE) AS highest FROM m
 UNION ALL SELECT 'driver_for_each_van', 'error', drivers, vans, NULL FROM m
 UNION ALL SELECT 'morning_route_fits_shift', 'error', morning, NULL, {SHIFT_MINUTES["morning"]} FROM m
 UNION ALL SELECT 'afternoon_route_fits_shift', 'error', afternoon, NULL, {SHIFT_MINUTES["afternoon"]} FROM m
 UNION ALL SELECT 'routes_per_van_plausible', 'warning', round(routes_per_parcel * mean_day / vans, 3), {ROUTES_PER_VAN[0]}, {ROUTES_PER_VAN[1]} FROM m)
SELECT rule, severity, measured, lowest, highest, coalesce((lowest IS NULL OR measured >= lowest) AND (highest IS NULL OR measured <= highest), false) AS passed FROM rules""")  # fmt: skip
def dq_fleet(t: Inputs) -> DataFrame:
    """Whether the fleet can do the work: its load against the mean weekday, drivers against vans, the longest route of each wave against
    its shift, and routes a van and day at one parcel a stop. What can't be measured has not passed."""
    per_day = t.orders().where(F.weekday("service_date") < 5).groupBy("service_date").agg(F.sum("parcels").alias("parcels"))
    vans, wave = t.vans(), F.col("wave")
    longest = [F.max(F.when(wave == w, F.col("planned_minutes"))).alias(w) for w in SHIFT_MINUTES]
    parts = [
        per_day.agg(F.avg("parcels").alias("mean_day")), t.drivers().agg(F.count(F.lit(1)).alias("drivers")),
        vans.agg(F.sum("capacity").alias("capacity"), F.count(F.lit(1)).alias("vans")),
        t.zones().agg(F.sum(F.col("share") / F.col("stops_per_route")).alias("routes_per_parcel")), t.routes().agg(*longest),
    ]
    # Each part is one row; they meet as rows of a union, not in a join without keys.
    rows: DataFrame | None = None
    for part in parts:
        part = part.select([F.col(c).cast("double").alias(c) for c in part.columns])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    m = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    none = F.lit(None).cast("double")

    def rule(name: str, measured: Column, lowest: Column = none, highest: Column = none, severity: str = "error") -> Column:
        low, high = lowest.isNull() | (measured >= lowest), highest.isNull() | (measured <= highest)
        return F.struct(
            F.lit(name).alias("rule"), F.lit(severity).alias("severity"), measured.alias("measured"), lowest.alias("lowest"), highest.alias("highest"),
            F.coalesce(low & high, F.lit(False)).alias("passed"),
        )

    per_van = F.round(F.col("routes_per_parcel") * F.col("mean_day") / F.nullif(F.col("vans"), F.lit(0.0)), 3)
    fits = [rule(f"{w}_route_fits_shift", F.col(w), highest=F.lit(float(most))) for w, most in SHIFT_MINUTES.items()]
    return m.select(F.inline(F.array(
        rule("fleet_holds_mean_weekday", F.col("capacity"), F.col("mean_day")), rule("driver_for_each_van", F.col("drivers"), F.col("vans")),
        *fits, rule("routes_per_van_plausible", per_van, *map(F.lit, ROUTES_PER_VAN), severity="warning"),
    )))


@query("dq_ids", """SELECT 'vans' AS table_name, count(*) AS n, count(*) - count(DISTINCT vehicle_id) AS repeated, count(*) FILTER (NOT regexp_matches(vehicle_id, '^V-[0-9]{1,2}$')) AS malformed FROM v_vans
UNION ALL SELECT 'drivers', count(*), count(*) - count(DISTINCT driver_id), count(*) FILTER (NOT regexp_matches(driver_id, '^D-[0-9]{1,2}$')) FROM v_drivers""")  # fmt: skip
def dq_ids(t: Inputs) -> DataFrame:
    def judged(name: str, df: DataFrame, key: str, form: str) -> DataFrame:
        per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(
            F.lit(name).alias("table_name"), F.sum("n").alias("n"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"),
            F.sum(F.when(~F.col(key).rlike(form), F.col("n")).otherwise(0)).alias("malformed"),
        )

    return judged("vans", t.vans(), "vehicle_id", "^V-[0-9]{1,2}$").unionByName(
        judged("drivers", t.drivers(), "driver_id", "^D-[0-9]{1,2}$")
    )


# Samples -----------------------------------------------------------------------------------------


def _uniform_sql(key: str, seed: int) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {key}, '{seed}')), 1, 15)) AS BIGINT) / 1152921504606846976e0)"


@query("weighted_draw", f"""WITH w AS (SELECT segment, shipper_id % 10 AS k, sum(weight) AS w FROM v_shippers GROUP BY 1, 2),
c AS (SELECT segment, k, CASE WHEN k = max(k) OVER (PARTITION BY segment) THEN 1e0 ELSE sum(w) OVER (PARTITION BY segment ORDER BY k) / sum(w) OVER (PARTITION BY segment) END AS c FROM w),
u AS (SELECT c_custkey, c_mktsegment AS segment, {_uniform_sql("CAST(c_custkey AS VARCHAR)", 7)} AS u FROM customer)
SELECT c_custkey, min(k) AS k FROM u JOIN c ON u.segment = c.segment AND c.c > u.u GROUP BY 1""")  # fmt: skip
def weighted_draw(t: Inputs) -> DataFrame:
    weights = t.shippers().groupBy("segment", (F.col("shipper_id") % 10).alias("k")).agg(F.sum("weight").alias("w"))
    shares = cumulative_share(weights, ["segment"], ["k"], "w", "upper")
    rows = t.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), ids.uniform("c_custkey", seed=7).alias("u"))
    return pick_by_share(rows, shares, ["segment"], "u", "k", "upper").select("c_custkey", "k")


@query("attach_notes", f"SELECT order_id, {_uniform_sql('CAST(order_id AS VARCHAR)', 8)} < 1 / 3e0 AS noted FROM v_orders")
def attach_notes(t: Inputs) -> DataFrame:
    return sampling.bernoulli(t.orders().select("order_id"), ["order_id"], 1 / 3, 8, "noted")


@query("stratified_sample", f"""SELECT row_no, district_code FROM (SELECT row_no, district_code, row_number() OVER (PARTITION BY district_code ORDER BY {_uniform_sql('CAST(row_no AS VARCHAR)', 3)}, row_no) AS rn FROM v_city) x WHERE rn <= 5""")
def stratified_sample(t: Inputs) -> DataFrame:
    return sampling.top_k_by_draw(t.city_addresses().select("row_no", "district_code"), ["district_code"], ["row_no"], 5, 3)


@query("sampled_streets", f"""WITH s AS (SELECT street_code FROM (SELECT street_code, row_number() OVER (PARTITION BY district_code ORDER BY {_uniform_sql('CAST(row_no AS VARCHAR)', 3)}, row_no) AS rn FROM v_city) x WHERE rn <= 5)
SELECT street_code, street_name FROM v_streets WHERE street_code IN (SELECT street_code FROM s)""")  # fmt: skip
def sampled_streets(t: Inputs) -> DataFrame:
    """The rows of the street register that the sampled addresses need."""
    city = t.city_addresses().select("row_no", "district_code", "street_code")
    sample = sampling.top_k_by_draw(city, ["district_code"], ["row_no"], 5, 3)
    return t.streets().join(sample.select("street_code").distinct(), "street_code", "left_semi")


@query("stable_sample", f"SELECT order_id FROM v_orders ORDER BY {_uniform_sql('CAST(order_id AS VARCHAR)', 11)}, order_id LIMIT 100")
def stable_sample(t: Inputs) -> DataFrame:
    return sampling.top_k_by_draw(t.orders().select("order_id"), [], ["order_id"], 100, 11)


DRAWS = (("B2B", 1, ("business",), 0.8), ("B2B", 2, ("neutral",), 0.2), ("B2C", 1, ("home", "neutral"), 1.0))
_NAMED = " || ".join(f"CASE WHEN {hit} THEN '{text.PLACES[p] or 'outside'};' ELSE '' END" for p, hit in PLACE_SQL.items())


@query("candidate_weights", f"""WITH n AS (SELECT language, {CONTEXT_SQL} AS context, list_distinct(list_filter(string_split({_NAMED}, ';'), lambda x: x <> '')) AS zs FROM v_notes),
mix AS (SELECT language, count(*) / sum(count(*)) OVER () AS mix FROM n GROUP BY 1),
d AS (SELECT * FROM (VALUES ('B2B', 1, 'business', 0.8e0), ('B2B', 2, 'neutral', 0.2e0), ('B2C', 1, 'home', 1e0), ('B2C', 1, 'neutral', 1e0)) v(recipient, grp, context, share)),
c AS (SELECT d.recipient, z.zone_id, d.grp, d.share, n.language, count(*) AS n FROM d JOIN n USING (context) JOIN v_zones z ON len(n.zs) = 0 OR (len(n.zs) = 1 AND n.zs[1] = z.zone_id) GROUP BY 1, 2, 3, 4, 5),
a AS (SELECT c.*, mix.mix / sum(mix.mix) OVER (PARTITION BY recipient, zone_id, grp) AS f, mix.mix FROM c JOIN mix USING (language)),
p AS (SELECT a.recipient, a.zone_id, a.language, a.share * a.f AS given FROM a WHERE grp = 1),
b AS (SELECT a.recipient, a.zone_id, a.grp, a.share, a.language, a.n, CASE WHEN a.grp = 1 THEN a.mix ELSE greatest(a.mix - coalesce(p.given, 0), 0) END AS wanted FROM a LEFT JOIN p ON a.grp = 2 AND a.recipient = p.recipient AND a.zone_id = p.zone_id AND a.language = p.language),
w AS (SELECT *, sum(wanted) OVER (PARTITION BY recipient, zone_id, grp) AS total, count(*) OVER (PARTITION BY recipient, zone_id, grp) AS kinds FROM b),
x AS (SELECT *, share * CASE WHEN total <= 0 THEN 1e0 / kinds ELSE wanted / total END AS mass FROM w)
SELECT recipient, zone_id, grp, language, n, round(mass / n / sum(mass) OVER (PARTITION BY recipient, zone_id), 9) AS weight FROM x""")  # fmt: skip
def candidate_weights(t: Inputs) -> DataFrame:
    """Probability of each note an order of a recipient and zone can get, per group and language. Notes
    are counted by (context, language, place) first; a note that names no place counts for every zone,
    so notes and zones are never paired."""
    zs = text.zones_named(F.col("text"), text.PLACES)
    tagged = contexts(t).groupBy("context", "language", zs.alias("zs")).agg(F.count(F.lit(1)).alias("n"))
    counted = tagged.where(F.size("zs") <= 1).select(
        "context", "language", "n", F.coalesce(F.get("zs", F.lit(0)), F.lit("any")).alias("place")
    )
    corpus = t.notes().groupBy("language").agg(F.count(F.lit(1)).alias("m"))
    mix = corpus.select("language", (F.col("m") / F.sum("m").over(Window.partitionBy())).alias("mix"))
    zones = t.zones().agg(F.collect_list("zone_id").alias("all")).withColumn("_one", F.lit(1))
    placed = counted.withColumn("_one", F.lit(1)).join(zones, "_one").select(
        "context", "language", "n", "all",
        F.explode(F.when(F.col("place") == "any", F.col("all")).otherwise(F.array("place"))).alias("zone_id"),
    ).where(F.array_contains("all", F.col("zone_id")))
    draws: Column = F.array(*[
        F.struct(F.lit(r).alias("recipient"), F.lit(g).alias("grp"), F.lit(s).alias("share"), F.lit(c).alias("c"))
        for r, g, kinds, s in DRAWS for c in kinds
    ])
    offered = placed.select("*", F.explode(draws).alias("d")).where("d.c = context").groupBy(
        "d.recipient", "zone_id", "d.grp", "d.share", "language"
    ).agg(F.sum("n").alias("n")).join(mix, "language")
    # The languages of a zone's notes are a short list, and so are the two groups.
    group = Window.partitionBy("recipient", "zone_id", "grp")
    first = F.when(F.col("grp") == 1, F.col("share") * F.col("mix") / F.sum("mix").over(group))
    wanted = F.when(F.col("grp") == 1, F.col("mix")).otherwise(F.greatest(F.col("mix") - F.coalesce("given", F.lit(0.0)), F.lit(0.0)))
    left = offered.withColumn("first", first).withColumn("given", F.sum("first").over(Window.partitionBy("recipient", "zone_id", "language")))
    sized = left.withColumn("wanted", wanted).withColumn("total", F.sum("wanted").over(group)).withColumn("kinds", F.count(F.lit(1)).over(group))
    part = F.when(F.col("total") <= 0, F.lit(1.0) / F.col("kinds")).otherwise(F.col("wanted") / F.col("total"))
    massed = sized.withColumn("mass", F.col("share") * part)
    whole = F.sum("mass").over(Window.partitionBy("recipient", "zone_id"))
    return massed.select(
        "recipient", "zone_id", "grp", "language", "n", F.round(F.col("mass") / F.col("n") / whole, 9).alias("weight")
    )

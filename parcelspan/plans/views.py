"""The delivery tables as SQL for the independent check: the same columns as `inputs.py`."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_hub": "SELECT * FROM (VALUES ('HUB', 41.3395e0, 2.1365e0, 400e0), ('HUB-N', 41.3415e0, 2.1385e0, 500e0)) h(hub_id, lat, lon, radius_m)",
    "v_sources": """SELECT * FROM (VALUES ('simulator/gps','simulated','MIT'),('simulator/telemetry','simulated','MIT'),
  ('simulator/handheld','simulated','MIT'),('opendata/sections','real','CC BY 4.0'),('planner/baseline','platform','MIT')) s(source_id, kind, license)""",
    "v_zones": """SELECT concat('Z', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS zone_id, n_name AS name, n_nationkey AS zone_no,
  CAST(n_nationkey % 7 + 1 AS DOUBLE) / 100 AS share, CAST(40 + n_nationkey AS INT) AS stops_per_route,
  2.5e0 + n_nationkey % 4 AS minutes_per_stop,
  CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS difficulty,
  41.3e0 + (n_nationkey % 5) * 0.03e0 AS lat, 2.05e0 + CAST(n_nationkey - n_nationkey % 5 AS DOUBLE) / 5 * 0.03e0 AS lon FROM nation""",
    "v_vans": """SELECT concat('V-', CAST(s_suppkey AS VARCHAR)) AS vehicle_id, concat('Z', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS home_zone_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'electric' WHEN 1 THEN 'diesel' ELSE 'cng' END AS type_id, CAST(80 + s_suppkey % 5 * 20 AS INT) AS capacity,
  s_suppkey % 4 = 0 AS afternoon FROM supplier""",
    "v_drivers": """SELECT concat('D-', CAST(s_suppkey AS VARCHAR)) AS driver_id, CASE WHEN s_suppkey % 4 = 0 THEN 'afternoon' ELSE 'morning' END AS shift_id,
  [concat('Z', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')), concat('Z', lpad(CAST((s_nationkey + 1) % 25 AS VARCHAR), 2, '0')), concat('Z', lpad(CAST((s_nationkey + 2) % 25 AS VARCHAR), 2, '0'))] AS zones,
  CASE WHEN s_suppkey % 2 = 0 THEN ['electric','diesel'] ELSE ['cng'] END AS vehicle_types FROM supplier""",
    "v_shippers": """SELECT c_custkey AS shipper_id, CAST(c_custkey % 10 + 1 AS DOUBLE) AS weight, CAST(c_custkey % 5 AS DOUBLE) / 4 AS business_share,
  CAST(c_custkey % 4 AS DOUBLE) / 4 AS same_day_share, c_custkey % 3 = 0 AS midday,
  [concat('Z', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')), concat('Z', lpad(CAST((c_nationkey + 7) % 25 AS VARCHAR), 2, '0'))] AS zones,
  c_mktsegment AS segment, c_name AS name FROM customer""",
    "v_notes": """SELECT d.doc_id AS note_id, concat(d.text, CASE d.doc_id % 7 WHEN 0 THEN ' Leave it at the office reception.' WHEN 1 THEN ' Es un pis, 3r 2a, El Prat.'
    WHEN 2 THEN ' Call 612 345 678, Sant Boi.' WHEN 3 THEN ' Porta del costat, Vallvidrera 22@.' ELSE '' END) AS text, d.lang AS language,
  CASE WHEN d.doc_id % 11 = 0 THEN 'business hours' WHEN d.doc_id % 2 = 0 THEN 'access' ELSE 'schedule' END AS category,
  l.quality = 1 AS likely_longer_stop, l.toxic = 1 AS likely_failed_attempt FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_orders": """SELECT o_orderkey AS order_id, o_custkey AS shipper_id, concat('Z', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS zone_id,
  CAST(o_orderdate AS DATE) AS service_date, CAST(1 + o_orderkey % 4 AS INT) AS parcels,
  CASE WHEN o_orderkey % 10 < 5 THEN 'small' WHEN o_orderkey % 10 < 8 THEN 'medium' ELSE 'large' END AS parcel_size,
  CASE WHEN o_custkey % 3 = 0 THEN 'B2B' ELSE 'B2C' END AS customer_type,
  CASE WHEN o_orderkey % 8 = 0 THEN 'same_day' ELSE 'next_day' END AS service_level,
  CASE WHEN o_orderkey % 5 < 3 THEN 'morning' ELSE 'afternoon' END AS wave,
  CASE WHEN o_custkey % 3 = 0 THEN 'opening_hours' WHEN o_orderkey % 2 = 0 THEN 'slot' ELSE 'wave' END AS window_type,
  CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate + INTERVAL 8 HOUR ELSE o_orderdate + INTERVAL 15 HOUR END AS window_start,
  CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate + INTERVAL 10 HOUR ELSE o_orderdate + INTERVAL 17 HOUR END AS window_end,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % (SELECT count(*) FROM documents) END AS note_id,
  41.3e0 + (c_nationkey % 5) * 0.03e0 + CAST((o_orderkey * 37) % 401 - 200 AS DOUBLE) / 20000 AS lat,
  2.05e0 + CAST(c_nationkey - c_nationkey % 5 AS DOUBLE) / 5 * 0.03e0 + CAST((o_orderkey * 53) % 401 - 200 AS DOUBLE) / 20000 AS lon,
  CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate ELSE o_orderdate - INTERVAL 1 DAY END + to_minutes(o_orderkey % 1440) AS registered_at
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_plan_stops": """SELECT concat('P-', CAST(l_suppkey AS VARCHAR), '-', CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS route_id, concat('V-', CAST(l_suppkey AS VARCHAR)) AS vehicle_id,
  l_orderkey AS order_id, l_linenumber AS line_no, CAST(o_orderdate AS DATE) AS service_date,
  o_orderdate + INTERVAL 8 HOUR + to_minutes((l_orderkey * 7 + l_linenumber * 45) % 540) AS planned_arrival, l_shipdate AS actual_arrival,
  l_quantity AS leg_distance_km FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_pings": """SELECT concat('V-', CAST(user_id AS VARCHAR)) AS vehicle_id,
  concat('R-', CAST(CAST(ts AS DATE) AS VARCHAR), '-', CAST(user_id % 20 AS VARCHAR)) AS route_id, ts AS event_time,
  41.3395e0 + CAST((event_id * 37) % 401 - 200 AS DOUBLE) / 20000 AS lat,
  2.1365e0 + CAST((event_id * 53) % 401 - 200 AS DOUBLE) / 20000 AS lon, value / 10 AS speed_kmh, event_id, CASE WHEN user_id % 20 < 15 THEN 'HUB' ELSE 'HUB-N' END AS hub_id FROM events""",
    "v_scans": """SELECT event_id, event_id // 3 AS order_id, concat('R-', CAST(CAST(ts AS DATE) AS VARCHAR), '-', CAST(user_id % 20 AS VARCHAR)) AS route_id,
  CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'out_for_delivery' ELSE 'arrived' END AS status,
  CASE WHEN event_type = 'error' THEN 'recipient_absent' END AS failure_reason, ts AS event_time,
  CASE WHEN event_type = 'purchase' THEN concat('pod/', CAST(CAST(ts AS DATE) AS VARCHAR), '/', CAST(event_id AS VARCHAR), '.jpg') END AS pod_object_key FROM events""",
    "v_telemetry": """SELECT concat('V-', CAST(user_id AS VARCHAR)) AS vehicle_id,
  concat('R-', CAST(CAST(ts AS DATE) AS VARCHAR), '-', CAST(user_id % 20 AS VARCHAR)) AS route_id, ts AS event_time,
  CAST(event_id AS DOUBLE) / 10 AS odometer_km, CAST(event_id AS DOUBLE) / 40 AS energy_used_total,
  event_id % 3 <> 0 AS ignition_on, CASE WHEN event_id % 4 = 0 THEN 0e0 ELSE value / 10 END AS speed_kmh,
  event_id % 5 < 2 AS cargo_door_open FROM events""",
    "v_routes": """SELECT route_id, service_date, route_no, CASE WHEN route_no < 12 THEN 'morning' ELSE 'afternoon' END AS wave,
  concat('Z', lpad(CAST(route_no % 10 AS VARCHAR), 2, '0')) AS zone_id,
  CASE route_no % 3 WHEN 0 THEN 'electric' WHEN 1 THEN 'diesel' ELSE 'cng' END AS type_id, CAST(300 + route_no * 7 AS DOUBLE) AS planned_minutes
  FROM (SELECT DISTINCT concat('R-', CAST(CAST(ts AS DATE) AS VARCHAR), '-', CAST(user_id % 20 AS VARCHAR)) AS route_id, CAST(ts AS DATE) AS service_date,
    CAST(user_id % 20 AS INT) AS route_no FROM events) r""",
    "v_promises": """SELECT order_id, first_seen - to_minutes(order_id % 90) AS window_start, first_seen - to_minutes(order_id % 90) + INTERVAL 60 MINUTE AS window_end
  FROM (SELECT event_id // 3 AS order_id, min(ts) AS first_seen FROM events GROUP BY 1) p""",
    "v_photos": """SELECT concat('pod/', CAST(CAST(ts AS DATE) AS VARCHAR), '/', CAST(event_id AS VARCHAR), '.jpg') AS path, event_id AS length
  FROM events WHERE event_type IN ('purchase', 'click') AND value > 2""",
    "v_weather": """SELECT concat('Z', lpad(CAST(user_id % 10 AS VARCHAR), 2, '0')) AS zone_id, ts AS read_at,
  max(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 61 ELSE 95 END) AS weather_code, max(value / 100) AS precipitation_mm
  FROM events WHERE event_type = 'signup' GROUP BY 1, 2""",
    "v_traffic": """SELECT CASE WHEN event_type = 'click' THEN 'trams' ELSE 'itineraris' END AS feed, CAST(user_id % 50 AS INT) AS feed_item_id, ts AS event_time,
  CAST(event_id % 7 AS INT) AS state, CAST(event_id % 5 AS INT) AS forecast FROM events WHERE event_type IN ('click', 'view')""",
    "v_fuel_prices": """SELECT CASE event_id % 2 WHEN 0 THEN 'diesel' ELSE 'cng' END AS product, ts AS priced_at, max(1.2e0 + CAST(event_id % 90 AS DOUBLE) / 100) AS price
  FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
    "v_streets": "SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS street_code, p_name AS street_name FROM part",
    "v_city": """SELECT c_custkey AS row_no, lpad(CAST(c_custkey % ((SELECT count(*) FROM part) + 20) + 1 AS VARCHAR), 6, '0') AS street_code, lpad(CAST(c_custkey % 300 AS VARCHAR), 4, '0') AS street_number,
  CASE WHEN c_custkey % 7 = 0 THEN 'A ' ELSE '  ' END AS number_letter, lpad(CAST(c_nationkey % 12 AS VARCHAR), 2, '0') AS district_code,
  lpad(CAST(c_custkey % 42 AS VARCHAR), 2, '0') AS postal_district, 41.4e0 + CAST(c_custkey % 100 AS DOUBLE) / 1000 AS lat,
  CASE WHEN c_custkey % 13 <> 0 THEN 2.1e0 + CAST(c_custkey % 90 AS DOUBLE) / 1000 END AS lon FROM customer""",
    "v_regional": """SELECT concat('A', CAST(s_suppkey AS VARCHAR)) AS address_id, concat('NÀTION ', CAST(s_nationkey AS VARCHAR)) AS municipality,
  CASE WHEN s_suppkey % 9 = 0 THEN 'bloc' ELSE 'vianum ' END AS address_type, 'carrer' AS street_type,
  CASE s_suppkey % 3 WHEN 0 THEN 'de l''' WHEN 1 THEN 'del' ELSE '' END AS street_article, s_name AS street_name,
  CASE WHEN s_suppkey % 5 = 0 THEN '0' ELSE CAST(s_suppkey % 50 AS VARCHAR) END AS number_from, CASE WHEN s_suppkey % 4 = 1 THEN 'B' ELSE '' END AS number_from_suffix,
  CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey % 50 + 2 AS VARCHAR) ELSE '' END AS number_to, '' AS number_to_suffix,
  concat('08', lpad(CAST(s_suppkey % 990 AS VARCHAR), 3, '0')) AS postcode, 425000e0 + s_suppkey * 11 % 20000 AS easting, 4580000e0 + s_suppkey * 17 % 20000 AS northing FROM supplier""",
    "v_served": """SELECT zone_id, lpad(CAST(zone_no AS VARCHAR), 2, '0') AS district_code, CASE WHEN zone_no > 10 THEN concat('nation', CAST(zone_no AS VARCHAR)) END AS town FROM v_zones WHERE zone_no > 0""",
    "v_health": "SELECT event_type AS service, ts AS checked_at, value > 5 AS up, event_id AS probe_id FROM events",
    "v_messages": """SELECT CASE WHEN event_id % 12 = 11 THEN 'orders.created' ELSE 'gps.pings' END AS topic, CAST(user_id % 3 AS INT) AS kafka_partition, event_id AS kafka_offset,
  CASE event_id % 12 WHEN 11 THEN 'unknown_topic' WHEN 1 THEN 'empty_message' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'missing_field'
    WHEN 5 THEN 'unsupported_schema_version' WHEN 6 THEN 'invalid_field' WHEN 7 THEN 'invalid_field' WHEN 8 THEN 'unknown_source' END AS expected_reason,
  concat('V-', CAST(user_id AS VARCHAR)) AS vehicle_id, ts, user_id, value, event_id FROM events""",
}


def expand(sql: str) -> str:
    """The statement with the views it names in front of it as common table expressions."""
    named: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in named and re.search(rf"\b{view}\b", text):
                visit(VIEWS[view])
                named.append(view)

    visit(sql)
    if not named:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in named)
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {own[1] or ''}{ctes},\n{body[own.end():]}" if own else f"WITH {ctes}\n{body}"

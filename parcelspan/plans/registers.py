"""Queries on registers, feeds, documents, texts and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.functions import calendar as cal
from parcelspan.functions import ids, text
from parcelspan.functions.geo import degrees_to_dms, dms_to_degrees, utm31_to_wgs84
from parcelspan.operators.keyed import left_join_known
from parcelspan.plans.inputs import Inputs
from parcelspan.plans.registry import query
from parcelspan.session import run_folder, small_table
from parcelspan.sinks import tables
from parcelspan.sources import documents, feeds, registers
from parcelspan.operators.spatial import ring_edges

CITY_SQL = """city AS (SELECT concat(c.street_code, '-', c.street_number, trim(c.number_letter)) AS address_ref, v.zone_id,
 concat(s.street_name, ', ', CASE WHEN ltrim(c.street_number, '0') = '' THEN '0' ELSE ltrim(c.street_number, '0') END, trim(c.number_letter)) AS street_address, concat('080', c.postal_district) AS postcode, 'Barcelona' AS municipality, round(c.lat, 7) AS lat, round(c.lon, 7) AS lon
 FROM v_city c JOIN v_streets s USING (street_code) JOIN v_served v USING (district_code) WHERE c.lat IS NOT NULL AND c.lon IS NOT NULL)"""
STREET_SQL = """concat(trim(concat(street_type, ' ', CASE WHEN street_article = '' THEN street_name WHEN street_article LIKE '%''' THEN concat(street_article, street_name) ELSE concat(street_article, ' ', street_name) END)), ', ',
 CASE WHEN concat(number_from, number_from_suffix, CASE WHEN number_to IN ('', '0') THEN '' ELSE concat('-', number_to) END) IN ('', '0') THEN 's/n' ELSE concat(number_from, number_from_suffix, CASE WHEN number_to IN ('', '0') THEN '' ELSE concat('-', number_to) END) END)"""
TOWN_SQL = "regexp_replace(replace(lower(municipality), 'à', 'a'), '[^a-z0-9]', '', 'g')"
def _utm_sql() -> str:
    from parcelspan.functions.geo import UTM, UTM_FALSE_EASTING, UTM_SCALE

    r = UTM["radius"] * UTM_SCALE
    xi = "xi" + "".join(f" - {b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(UTM["beta"], 1))
    eta = "eta" + "".join(f" - {b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(UTM["beta"], 1))
    lat = "chi" + "".join(f" + {d!r} * sin({2 * j} * chi)" for j, d in enumerate(UTM["delta"], 1))
    return f"""a AS (SELECT address_id, northing / {r!r} AS xi, (easting - {UTM_FALSE_EASTING!r}) / {r!r} AS eta FROM v_regional),
b AS (SELECT address_id, {xi} AS x1, {eta} AS e1 FROM a), c AS (SELECT address_id, asin(sin(x1) / cosh(e1)) AS chi, x1, e1 FROM b),
placed AS (SELECT address_id, round(degrees({lat}), 7) AS lat, round(3 + degrees(atan2(sinh(e1), cos(x1))), 7) AS lon FROM c)"""


REGIONAL_SQL = f"regional AS (SELECT address_id AS address_ref, zone_id, {STREET_SQL} AS street_address, postcode, municipality, lat, lon FROM v_regional r JOIN placed USING (address_id) JOIN v_served v ON v.town = {TOWN_SQL} WHERE trim(address_type) = 'vianum')"


# Sources -----------------------------------------------------------------------------------------


@query("csv_register_scan", "SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS street_code, p_name AS street_name FROM part")
def csv_register_scan(t: Inputs) -> DataFrame:
    """A register written as CSV and scanned back: two of its columns, renamed, values as text."""
    path = run_folder(t.spark, "register")
    t.table("part").select(
        F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("codi"), F.col("p_name").alias("nom"), F.col("p_brand").alias("marca")
    ).write.csv(path, header=True)
    return registers.read_register(t.spark, path, ["codi", "nom", "marca"], {"codi": "street_code", "nom": "street_name"})


@query("semi_filter_register", f"SELECT address_id, municipality FROM v_regional WHERE {TOWN_SQL} IN (SELECT town FROM v_served WHERE town IS NOT NULL)")
def semi_filter_register(t: Inputs) -> DataFrame:
    return registers.served_rows(t.regional_addresses(), t.served()).select("address_id", "municipality")


@query("csv_completeness", "SELECT count(*) AS n_rows, count(*) FILTER (p_partkey % 50 = 0) AS ragged_rows, concat(CAST(count(*) FILTER (p_partkey % 50 = 0) AS VARCHAR), ' lines have other fields than the header') AS reason FROM part")
def csv_completeness(t: Inputs) -> DataFrame:
    """The verdict on a register in which every fiftieth line is cut off before its last field."""
    k = F.col("p_partkey")
    whole = F.concat(k.cast("string"), F.lit(',"'), F.col("p_name"), F.lit(', x",'), F.col("p_brand"))
    cut = F.concat(k.cast("string"), F.lit(",x"))
    lines = t.table("part").select(F.when(k % 50 == 0, cut).otherwise(whole).alias("line"))
    return registers.csv_verdict(lines, "code,name,brand", ("code", "brand"), 100)


@query("csv_file_completeness", """SELECT 'whole' AS name, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS ragged_rows, CAST(0 AS BIGINT) AS open_files FROM part
UNION ALL SELECT 'cut off', count(*) + 1, 1, 1 FROM part""")  # fmt: skip
def csv_file_completeness(t: Inputs) -> DataFrame:
    """The verdicts on the files of two registers, added up: names hold quotes and line breaks in both, and one has a file that ends inside a
    quote."""
    k = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.when(k % 3 == 0, F.lit(',\nsecond "line"')).otherwise(F.lit("")))
    rows = t.table("part").select(k.alias("code"), name.alias("name"), F.col("p_brand").alias("brand"))
    cut = small_table(t.spark, [('code,name,brand\n0,"cut off, x',)], "value string")
    found = []
    for kind in ("whole", "cut off"):
        path = run_folder(t.spark, "verdicts")
        rows.write.csv(path, header=True, escape='"')
        if kind == "cut off":
            cut.write.mode("append").text(path)
        verdict = registers.csv_file_verdict(t.spark, path, ("code", "brand"), 1)
        found.append(verdict.agg(
            F.lit(kind).alias("name"), F.sum("n_rows").alias("n_rows"), F.sum("ragged_rows").alias("ragged_rows"),
            F.count_if(F.col("reason") == "a quote is left open").alias("open_files"),
        ))
    return found[0].unionByName(found[1])


@query("min_rows_per_group", f"""SELECT v.zone_id, count(r.address_id) AS n FROM v_served v LEFT JOIN v_regional r ON v.town = {TOWN_SQL} WHERE v.town IS NOT NULL GROUP BY 1 HAVING count(r.address_id) < 1000""")
def min_rows_per_group(t: Inputs) -> DataFrame:
    """Towns whose part of the register is too small to be complete."""
    served = t.served().where("town IS NOT NULL").select("zone_id", "town")
    rows = t.regional_addresses().select(text.norm_text(F.col("municipality")).alias("town"))
    counted = registers.rows_per_group(served, rows, "town")
    return served.join(counted, "town").where("n < 1000").select("zone_id", "n")


@query("nested_json_flatten", "SELECT n_nationkey, s_suppkey AS item, concat('Z', lpad(CAST((n_nationkey + 1) % 25 AS VARCHAR), 2, '0')) AS second_zone FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def nested_json_flatten(t: Inputs) -> DataFrame:
    """Fleet documents, one per van with a nested list, written as JSON and flattened on the way back."""
    path = run_folder(t.spark, "fleet")
    d, s = t.drivers(), t.table("supplier")
    docs = s.join(d, F.concat(F.lit("D-"), F.col("s_suppkey").cast("string")) == F.col("driver_id")).select(
        F.struct(F.col("s_nationkey").alias("base")).alias("depot"),
        F.array(F.struct(F.col("s_suppkey").alias("item"), F.col("zones"))).alias("vehicles"),
    )
    docs.write.json(path)
    schema = "depot struct<base: int>, vehicles array<struct<item: bigint, zones: array<string>>>"
    read = t.spark.read.schema(schema).json(path)
    return read.select(F.col("depot.base").alias("n_nationkey"), F.explode("vehicles").alias("v")).select(
        "n_nationkey", "v.item", F.get("v.zones", F.lit(1)).alias("second_zone")
    )


@query("partition_scan", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def partition_scan(t: Inputs) -> DataFrame:
    """One day of a dataset partitioned by date: only that day's folder is read."""
    path = run_folder(t.spark, "by-date")
    tables.replace_partitions(t.table("events").withColumn("date", F.col("ts").cast("date")), path, ["date"])
    return t.spark.read.parquet(path).where("date = DATE '2024-01-15'").select("event_id", "event_type")


@query("read_day", "SELECT order_id, shipper_id, zone_id, parcels FROM v_orders WHERE service_date = DATE '1997-05-12' AND wave = 'morning' ORDER BY order_id")
def read_day(t: Inputs) -> DataFrame:
    return t.orders().where("service_date = DATE '1997-05-12' AND wave = 'morning'").select(
        "order_id", "shipper_id", "zone_id", "parcels"
    ).orderBy("order_id")


@query("hash_feed_parse", """SELECT feed, feed_item_id, date_trunc('second', event_time) AS event_time, CASE WHEN feed = 'trams' THEN state END AS state, CASE WHEN feed = 'trams' THEN forecast END AS state_forecast,
 CASE WHEN feed <> 'trams' THEN state * 60 END AS travel_time_s, CASE WHEN feed <> 'trams' THEN forecast * 60 END AS travel_time_forecast_s FROM v_traffic""")  # fmt: skip
def hash_feed_parse(t: Inputs) -> DataFrame:
    stamp = F.date_format(cal.local_time(F.col("event_time")), "yyyyMMddHHmmss")
    parts = {
        True: ["feed_item_id", stamp, "state", "forecast"],
        False: ["feed_item_id", F.lit("1"), stamp, F.col("state") * 60, F.col("forecast") * 60, F.lit("1"), F.lit("1"), F.lit("1")],
    }
    section, itinerary = (
        F.concat_ws("#", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts[k]]) for k in (True, False)
    )
    lines = t.traffic().select(F.when(F.col("feed") == "trams", section).otherwise(itinerary).alias("raw_line"))
    return feeds.traffic_lines(lines).drop("raw_line")


@query("unpivot_decimal_comma", """SELECT CAST(s_suppkey AS VARCHAR) AS station_id, product, round(price, 6) AS price, TIMESTAMP '2026-09-28 17:05:53' AS priced_at
FROM (SELECT s_suppkey, 'diesel' AS product, 1 + CAST(s_suppkey % 97 AS DOUBLE) / 1000 AS price FROM supplier UNION ALL SELECT s_suppkey, 'cng', 1.5e0 + CAST(s_suppkey % 89 AS DOUBLE) / 1000 FROM supplier WHERE s_suppkey % 4 <> 0) x""")  # fmt: skip
def unpivot_decimal_comma(t: Inputs) -> DataFrame:
    """Price documents to rows. Every fourth station sells no gas and says so with an empty text."""
    k = F.col("s_suppkey")

    def comma(x: Column) -> Column:
        return F.replace(F.format_string("%.3f", x), F.lit("."), F.lit(","))

    gas = F.when(k % 4 == 0, "").otherwise(comma(F.lit(1.5) + (k % 89).cast("double") / 1000))
    station = F.struct(
        k.cast("string").alias("station_id"), F.lit("41,514583").alias("latitude"),
        comma(1 + (k % 97).cast("double") / 1000).alias("Precio Gasoleo A"), gas.alias("Precio Gas Natural Comprimido"),
    )
    docs = t.table("supplier").select(
        F.to_json(F.struct(F.lit("28/09/2026 17:05:53").alias("taken_at"), F.array(station).alias("ListaEESSPrecio"))).alias("doc")
    )
    products = (("Precio Gasoleo A", "diesel"), ("Precio Gas Natural Comprimido", "cng"))
    rows = documents.fuel_prices(docs, "doc", "ListaEESSPrecio", products)
    return rows.select("station_id", "product", F.round("price", 6).alias("price"), "priced_at")


@query("weather_flatten", """SELECT zone_id, read_at, date_trunc('minute', read_at) AS event_time, 25.3e0 AS temperature_c, round(precipitation_mm, 4) AS precipitation_mm, weather_code FROM v_weather""")
def weather_flatten(t: Inputs) -> DataFrame:
    current = F.struct(
        F.date_format("read_at", "yyyy-MM-dd'T'HH:mm").alias("time"), F.lit(900).alias("interval"), F.lit(25.3).alias("temperature_2m"),
        F.col("precipitation_mm").alias("precipitation"), F.col("weather_code"),
    )
    docs = t.weather().select("zone_id", "read_at", F.to_json(F.struct(F.lit("GMT").alias("timezone"), current.alias("current"))).alias("doc"))
    return documents.weather_reading(docs, "doc", "zone_id", "read_at").withColumn("precipitation_mm", F.round("precipitation_mm", 4))


@query("wkt_rings", """SELECT zone_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM (
 SELECT zone_id, lon - 0.01e0 AS x1, lat - 0.01e0 AS y1, lon + 0.01e0 AS x2, lat - 0.01e0 AS y2 FROM v_zones UNION ALL SELECT zone_id, lon + 0.01e0, lat - 0.01e0, lon, lat + 0.01e0 FROM v_zones
 UNION ALL SELECT zone_id, lon, lat + 0.01e0, lon - 0.01e0, lat - 0.01e0 FROM v_zones) e""")  # fmt: skip
def wkt_rings(t: Inputs) -> DataFrame:
    """Boundaries given as WKT text, to edges."""
    def corner(dx: float, dy: float) -> Column:
        return F.concat_ws(" ", (F.col("lon") + F.lit(dx)).cast("string"), (F.col("lat") + F.lit(dy)).cast("string"))

    ring = F.concat_ws(", ", corner(-0.01, -0.01), corner(0.01, -0.01), corner(0.0, 0.01), corner(-0.01, -0.01))
    wkt = t.zones().select("zone_id", F.concat(F.lit("MULTIPOLYGON ((("), ring, F.lit(")))")).alias("wkt"))
    rings = wkt.select("zone_id", F.explode(documents.wkt_rings(F.col("wkt"))).alias("points"))
    edges = ring_edges(rings, "zone_id", "points")
    return edges.select("zone_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("raw_file_lineage", "SELECT event_id, 'events.parquet' AS raw_object_key FROM events")
def raw_file_lineage(t: Inputs) -> DataFrame:
    """Every row with the file it came from."""
    return t.table("events").select("event_id", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("raw_object_key"))


# Registers ---------------------------------------------------------------------------------------


@query("address_street_join", "SELECT c.row_no, c.street_code, s.street_name FROM v_city c LEFT JOIN v_streets s USING (street_code) WHERE c.lon IS NOT NULL")
def address_street_join(t: Inputs) -> DataFrame:
    placed = t.city_addresses().where("lon IS NOT NULL").select("row_no", "street_code")
    return placed.join(t.streets(), "street_code", "left")


@query("zone_assignment", f"""SELECT 'city' AS register, CAST(c.row_no AS VARCHAR) AS id, v.zone_id FROM v_city c JOIN v_served v USING (district_code)
UNION ALL SELECT 'regional', r.address_id, v.zone_id FROM v_regional r JOIN v_served v ON v.town = {TOWN_SQL}""")  # fmt: skip
def zone_assignment(t: Inputs) -> DataFrame:
    served = t.served()
    city = t.city_addresses().join(served.select("district_code", "zone_id"), "district_code")
    towns = served.where("town IS NOT NULL").select("town", "zone_id")
    regional = t.regional_addresses().withColumn("town", text.norm_text(F.col("municipality"))).join(towns, "town")
    return city.select(F.lit("city").alias("register"), F.col("row_no").cast("string").alias("id"), "zone_id").unionByName(
        regional.select(F.lit("regional").alias("register"), F.col("address_id").alias("id"), "zone_id")
    )


@query("address_pool", f"WITH {CITY_SQL}, {_utm_sql()}, {REGIONAL_SQL} SELECT * FROM city UNION ALL SELECT * FROM regional")
def address_pool(t: Inputs) -> DataFrame:
    return registers.address_pool(t.city_addresses(), t.streets(), t.regional_addresses(), t.served())


@query("dim_address", f"WITH {CITY_SQL}, {_utm_sql()}, {REGIONAL_SQL}, p AS (SELECT * FROM city UNION ALL SELECT * FROM regional) SELECT address_ref, min(zone_id) AS zone_id, min(street_address) AS street_address, min(postcode) AS postcode, min(municipality) AS municipality, min(lat) AS lat, min(lon) AS lon FROM p GROUP BY 1")
def dim_address(t: Inputs) -> DataFrame:
    """One row per postal address."""
    pool = registers.address_pool(t.city_addresses(), t.streets(), t.regional_addresses(), t.served())
    return pool.groupBy("address_ref").agg(*[F.min(c).alias(c) for c in ("zone_id", "street_address", "postcode", "municipality", "lat", "lon")])


@query("dangling_address_ref", f"""WITH refs AS (SELECT row_no, CASE WHEN row_no % 5 = 0 THEN concat('A', CAST(row_no AS VARCHAR)) ELSE concat(street_code, '-', street_number, CASE WHEN row_no % 11 = 0 THEN 'Z' ELSE trim(number_letter) END) END AS address_ref FROM v_city)
SELECT row_no, address_ref FROM refs WHERE NOT EXISTS (SELECT 1 FROM v_city c WHERE concat(c.street_code, '-', c.street_number, trim(c.number_letter)) = refs.address_ref) AND NOT EXISTS (SELECT 1 FROM v_regional r WHERE r.address_id = refs.address_ref)""")  # fmt: skip
def dangling_address_ref(t: Inputs) -> DataFrame:
    """Address references that neither register holds."""
    k = F.col("row_no")
    letter = F.when(k % 11 == 0, "Z").otherwise(F.col("number_letter"))
    city = t.city_addresses()
    refs = city.select(
        "row_no",
        F.when(k % 5 == 0, F.concat(F.lit("A"), k.cast("string")))
        .otherwise(text.register_ref(F.col("street_code"), F.col("street_number"), letter)).alias("address_ref"),
    )
    known = city.select(
        text.register_ref(F.col("street_code"), F.col("street_number"), F.col("number_letter")).alias("address_ref")
    ).unionByName(t.regional_addresses().select(F.col("address_id").alias("address_ref")))
    return refs.join(known, "address_ref", "left_anti").select("row_no", "address_ref")


@query("address_format", f"SELECT address_id, {STREET_SQL} AS street_address FROM v_regional")
def address_format(t: Inputs) -> DataFrame:
    line = text.street_line(*[F.col(c) for c in ("street_type", "street_article", "street_name", "number_from", "number_from_suffix", "number_to", "number_to_suffix")])
    return t.regional_addresses().select("address_id", line.alias("street_address"))


@query("blank_to_null", "SELECT row_no, nullif(trim(number_letter), '') AS number_letter FROM v_city")
def blank_to_null(t: Inputs) -> DataFrame:
    return t.city_addresses().select("row_no", text.blank_to_null(F.col("number_letter")).alias("number_letter"))


@query("norm_text", "SELECT doc_id, regexp_replace(translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüýÿñç', 'aaaaaaeeeeiiiiooooouuuuyync'), '[^a-z0-9]', '', 'g') AS normal FROM documents")
def norm_text(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", text.norm_text(F.col("text")).alias("normal"))


@query("regex_extract", "SELECT c_custkey, regexp_extract(concat('Hub ', c_mktsegment, ' (', split_part(c_name, '#', 2), ')'), '\\(([^)]+)\\)', 1) AS code, split_part(lower(c_mktsegment || ' shift'), ' ', 1) AS first_word FROM customer")
def regex_extract(t: Inputs) -> DataFrame:
    """The code in brackets of a depot's name, and the first word of a shift's."""
    depot = F.concat(F.lit("Hub "), F.col("c_mktsegment"), F.lit(" ("), F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit(")"))
    shift = F.lower(F.concat(F.col("c_mktsegment"), F.lit(" shift")))
    return t.table("customer").select(
        "c_custkey", F.regexp_extract(depot, r"\(([^)]+)\)", 1).alias("code"), F.split(shift, " ")[0].alias("first_word")
    )


# Notes -------------------------------------------------------------------------------------------


def _re2(words: tuple[str, ...]) -> str:
    """The same whole-word pattern for an engine without look-around."""
    import re

    body = "|".join(re.escape(w[:-1]) + r"[\p{L}\p{N}_]*" if w.endswith("*") else re.escape(w) for w in words)
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{body})(?:$|[^\p{{L}}\p{{N}}_])".replace("'", "''")


FLAT_RE2 = r"(?i)(?:^|[^\p{L}\p{N}_])\d+\s*(?:º|°|r|n|t|è)\.?\s+\d+\s*(?:ª|a)(?:$|[^\p{L}\p{N}_])|floor,? door \d"
OPENING_RE2 = r"(?i)^[^\p{L}\p{N}_]*(?:(?:es|és) una? |it''?s an? )?(?:" + "|".join(text.BUSINESS_OPENINGS) + r")(?:$|[^\p{L}\p{N}_])"
CONTEXT_SQL = f"""CASE WHEN category = 'business hours' THEN 'business' WHEN regexp_matches(text, '{_re2(text.HOME_WORDS)}') OR regexp_matches(text, '{FLAT_RE2}') THEN 'home'
 WHEN regexp_matches(text, '{_re2(text.BUSINESS_WORDS)}') OR regexp_matches(text, '{OPENING_RE2}') THEN 'business' ELSE 'neutral' END"""
PLACE_SQL = {p: f"regexp_matches(text, '{_re2((p,))}')" for p in sorted(text.PLACES)}


def contexts(t: Inputs) -> DataFrame:
    return t.notes().withColumn("context", text.note_context(F.col("text"), F.col("category")))


@query("note_context", f"SELECT note_id, {CONTEXT_SQL} AS context FROM v_notes")
def note_context(t: Inputs) -> DataFrame:
    return contexts(t).select("note_id", "context")


PLACES_SQL = ", ".join(f"CASE WHEN {hit} THEN '{place.replace(chr(39), chr(39) * 2)}' END" for place, hit in PLACE_SQL.items())
ELSEWHERE_SQL = " OR ".join(f"({hit} AND '{text.PLACES[place] or 'outside'}' <> o.zone_id)" for place, hit in PLACE_SQL.items())


@query("places_named", f"SELECT note_id, concat_ws(',', {PLACES_SQL}) AS places FROM v_notes")
def places_named(t: Inputs) -> DataFrame:
    return t.notes().select("note_id", F.array_join(text.places_named(F.col("text"), text.PLACES), ",").alias("places"))


@query("note_fits_zone", f"SELECT o.order_id, NOT coalesce({ELSEWHERE_SQL}, false) AS fits FROM v_orders o LEFT JOIN v_notes n ON o.note_id = n.note_id")
def note_fits_zone(t: Inputs) -> DataFrame:
    """Whether an order's note can be read at a door of its zone: it names no place, or only that zone's."""
    named = t.notes().select("note_id", text.zones_named(F.col("text"), text.PLACES).alias("zs"))
    read = left_join_known(t.orders().select("order_id", "zone_id", "note_id"), named, "note_id")
    fits = F.size(F.array_except("zs", F.array("zone_id"))) == 0
    return read.select("order_id", F.coalesce(fits, F.lit(True)).alias("fits"))


@query("pii_scan", r"""SELECT note_id, regexp_matches(text, '(?:\+34[\s.-]?)?\b[6789]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}\b') AS phone, regexp_matches(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b') AS email,
 regexp_matches(text, '(?i)\b(?:\d{8}|[XYZ]\d{7})[\s-]?[A-Z]\b') AS identity FROM v_notes""")  # fmt: skip
def pii_scan(t: Inputs) -> DataFrame:
    body = F.col("text")
    return t.notes().select(
        "note_id", body.rlike(text.PHONE).alias("phone"), body.rlike(text.EMAIL).alias("email"), body.rlike(text.IDENTITY_NUMBER).alias("identity")
    )


@query("note_mix", """SELECT n.language, n.category, count(*) AS orders, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM v_orders o JOIN v_notes n ON o.note_id = n.note_id GROUP BY 1, 2""")
def note_mix(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    labels = t.notes().select("note_id", "language", "category")
    # Orders are counted per note before they meet the labels, so a much used note is one row.
    per_note = t.orders().where("note_id IS NOT NULL").groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per_note.join(labels, "note_id").groupBy("language", "category").agg(F.sum("n").alias("orders"))
    return counted.withColumn("share", F.round(F.col("orders") / F.sum("orders").over(Window.partitionBy()), 9))


@query("recipient_context_pivot", f"""WITH n AS (SELECT note_id, {CONTEXT_SQL} AS context FROM v_notes)
SELECT customer_type, count(*) FILTER (context = 'business') AS business, count(*) FILTER (context = 'home') AS home, count(*) FILTER (context = 'neutral') AS neutral FROM v_orders o JOIN n ON o.note_id = n.note_id GROUP BY 1""")  # fmt: skip
def recipient_context_pivot(t: Inputs) -> DataFrame:
    kinds = ["business", "home", "neutral"]
    # Orders are counted per note first, so the texts are tagged once per note and moved once.
    per_note = t.orders().where("note_id IS NOT NULL").groupBy("note_id", "customer_type").agg(F.count(F.lit(1)).alias("n"))
    tagged = per_note.join(contexts(t).select("note_id", "context"), "note_id")
    return tagged.groupBy("customer_type").pivot("context", kinds).agg(F.sum("n")).na.fill(0, kinds)


# Scalars -----------------------------------------------------------------------------------------


@query("id_format", """SELECT order_id, concat('O-', strftime(service_date, '%Y%m%d'), '-', lpad(CAST(order_id AS VARCHAR), 9, '0')) AS order_name, concat('pod/', strftime(service_date, '%Y-%m-%d'), '/', CAST(order_id AS VARCHAR), '.jpg') AS photo_key,
 concat('orders/date=', strftime(service_date, '%Y-%m-%d'), '/orders.parquet') AS object_key FROM v_orders""")  # fmt: skip
def id_format(t: Inputs) -> DataFrame:
    day = F.col("service_date")
    return t.orders().select(
        "order_id",
        F.concat(F.lit("O-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad(F.col("order_id").cast("string"), 9, "0")).alias("order_name"),
        ids.photo_key(day, F.col("order_id")).alias("photo_key"),
        F.concat(F.lit("orders/date="), F.date_format(day, "yyyy-MM-dd"), F.lit("/orders.parquet")).alias("object_key"),
    )


@query("clock_minutes", """SELECT order_id, CAST(hour(registered_at) * 60 + minute(registered_at) AS INT) AS minutes, strftime(registered_at, '%H:%M') AS clock, CAST(hour(registered_at) * 60 + minute(registered_at) + 90 AS INT) AS span_end FROM v_orders""")
def clock_minutes(t: Inputs) -> DataFrame:
    """'HH:MM' texts to minutes and back, and both ends of a period."""
    clock = F.date_format("registered_at", "HH:mm")
    m = cal.clock_minutes(clock)
    period = F.concat(clock, F.lit("-"), cal.minutes_clock(m + 90))
    ends = cal.span_minutes(period)
    return t.orders().select("order_id", m.alias("minutes"), cal.minutes_clock(m).alias("clock"), ends[1].alias("span_end"))


LOCAL_SQL = "timezone('Europe/Madrid', timezone('UTC', event_time))"


@query("local_calendar", f"""SELECT event_id, {LOCAL_SQL} AS local_time, CAST(isodow({LOCAL_SQL}) - 1 AS INT) AS weekday, CAST(hour({LOCAL_SQL}) AS INT) AS hour, timezone('UTC', timezone('Europe/Madrid', {LOCAL_SQL})) AS utc_again FROM v_pings""")
def local_calendar(t: Inputs) -> DataFrame:
    local = cal.local_time(F.col("event_time"))
    return t.pings().select(
        "event_id", local.alias("local_time"), F.weekday(local).alias("weekday"), F.hour(local).alias("hour"),
        cal.utc_time(local).alias("utc_again"),
    )


PEAKS = {11: 1.6, 12: 1.4, 7: 0.9}
FRIDAY_SQL = "(make_date(year(service_date), 11, 1) + CAST(((4 - (isodow(make_date(year(service_date), 11, 1)) - 1)) % 7 + 7) % 7 + 21 AS INT))"


@query("seasonal_multiplier", f"""SELECT order_id, CAST({FRIDAY_SQL} AS VARCHAR) AS black_friday, CASE WHEN service_date BETWEEN {FRIDAY_SQL} - 4 AND {FRIDAY_SQL} + 3 THEN 1.6e0 WHEN month(service_date) = 11 THEN 1e0 WHEN month(service_date) = 12 THEN 1.4e0 WHEN month(service_date) = 7 THEN 0.9e0 ELSE 1e0 END AS multiplier FROM v_orders""")
def seasonal_multiplier(t: Inputs) -> DataFrame:
    day = F.col("service_date")
    return t.orders().select("order_id", cal.black_friday(day).cast("string").alias("black_friday"), cal.seasonal_multiplier(day, PEAKS).alias("multiplier"))


@query("window_starts", """WITH h AS (SELECT c_custkey, 480 + CAST(c_custkey % 4 AS INT) * 45 AS o, 1080 + CAST(c_custkey % 3 AS INT) * 60 AS c, c_custkey % 2 = 0 AS lunch FROM customer),
r AS (SELECT c_custkey, o AS a, CASE WHEN lunch THEN 810 ELSE c END AS b FROM h UNION ALL SELECT c_custkey, 930, c FROM h WHERE lunch),
s AS (SELECT c_custkey, unnest(range(0, 48)) * 30 AS start, a, b FROM r)
SELECT c_custkey, start FROM s WHERE start >= greatest(a, 480) AND start <= least(b, 900) - 120""")  # fmt: skip
def window_starts(t: Inputs) -> DataFrame:
    """Half-hour starts of two-hour windows inside a business's hours and the morning wave."""
    k = F.col("c_custkey")
    hours = t.table("customer").select(
        k, cal.minutes_clock((480 + k % 4 * 45).cast("int")).alias("opens"), cal.minutes_clock((1080 + k % 3 * 60).cast("int")).alias("closes"),
        F.when(k % 2 == 0, "13:30-15:30").alias("lunch"),
    )
    ranges = cal.opening_ranges(F.col("opens"), F.col("closes"), F.col("lunch"))
    return hours.select("c_custkey", F.explode(cal.window_starts(ranges, F.lit(480), F.lit(900), 120)).alias("start"))


@query("dms", """WITH x AS (SELECT order_id, lon, CAST(round(abs(lat) * 36000000e0) AS BIGINT) AS t, lat FROM v_orders)
SELECT order_id, CAST(t // 36000000 AS INT) AS degrees, CAST(t // 600000 % 60 AS INT) AS minutes, (t % 600000) / 10000e0 AS seconds, round(CAST(t // 36000000 AS INT) + CAST(t // 600000 % 60 AS INT) / 60e0 + ((t % 600000) / 10000e0) / 3600e0, 6) AS again FROM x""")  # fmt: skip
def dms(t: Inputs) -> DataFrame:
    d, m, s = degrees_to_dms(F.col("lat"))
    split = t.orders().select("order_id", d.alias("degrees"), m.alias("minutes"), s.alias("seconds"))
    again = dms_to_degrees(F.col("degrees"), F.col("minutes"), F.col("seconds"), F.lit("N"))
    return split.withColumn("again", F.round(again, 6))


@query("utm_to_wgs84", f"WITH {_utm_sql()} SELECT * FROM placed")
def utm_to_wgs84(t: Inputs) -> DataFrame:
    lat, lon = utm31_to_wgs84(F.col("easting"), F.col("northing"))
    return t.regional_addresses().select("address_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


EVENT_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 9562


@query("event_uuid", f"""WITH d AS (SELECT event_id, sha1(unhex('{EVENT_NAMESPACE.hex}') || encode(concat_ws('/', route_id, CAST(order_id AS VARCHAR), status))) AS d FROM v_scans)
SELECT event_id, concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), '5' || substr(d, 14, 3), substr('89ab', CAST(('0x' || substr(d, 17, 1)) AS INT) % 4 + 1, 1) || substr(d, 18, 3), substr(d, 21, 12)) AS event_uuid FROM d""")  # fmt: skip
def event_uuid(t: Inputs) -> DataFrame:
    """The same id for the same route, order and status in every run."""
    name = F.concat_ws("/", "route_id", F.col("order_id").cast("string"), "status")
    return t.scans().select("event_id", ids.uuid5(EVENT_NAMESPACE, name).alias("event_uuid"))


@query("json_fields", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, array_to_string(json_keys(props), ',') AS keys, concat('{"id":', CAST(event_id AS VARCHAR), ',"k":', CAST(json_extract(props, '$.k') AS VARCHAR), '}') AS rebuilt FROM events""")
def json_fields(t: Inputs) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.table("events").select(
        "event_id", k.alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys"),
        F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("rebuilt"),
    )


@query("table_metadata", """SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_brand END AS owner, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS schema_version FROM part""")
def table_metadata(t: Inputs) -> DataFrame:
    """Owner and version from each table's JSON comment; a comment that is not JSON, or a version that is
    not a number of up to nine digits, gives NULL."""
    k = F.col("p_partkey")
    version = F.when(k % 3 == 0, F.col("p_size").cast("string")).otherwise("v2")
    comment = F.when(k % 3 == 2, "plain text").otherwise(
        F.to_json(F.struct(F.col("p_brand").alias("owner"), version.alias("schema_version")))
    )
    meta = t.table("part").select(k, F.try_parse_json(comment).alias("meta"))
    stated = F.try_variant_get("meta", "$.schema_version", "string")
    return meta.select(
        k, F.try_variant_get("meta", "$.owner", "string").alias("owner"),
        F.when(stated.rlike("^[0-9]{1,9}$"), stated.try_cast("int")).alias("schema_version"),
    )


@query("dq_closed_list", "SELECT parcel_size, window_type, count(*) AS n FROM v_orders WHERE parcel_size NOT IN ('small', 'medium') OR window_type NOT IN ('slot', 'opening_hours') GROUP BY 1, 2")
def dq_closed_list(t: Inputs) -> DataFrame:
    """Values outside the allowed lists, which here leave out one size and one window type."""
    bad = ~F.col("parcel_size").isin("small", "medium") | ~F.col("window_type").isin("slot", "opening_hours")
    return t.orders().where(bad).groupBy("parcel_size", "window_type").agg(F.count(F.lit(1)).alias("n"))

"""The delivery tables the queries run on, derived from the given tables.

Every method is a lazy DataFrame over whole tables; `views.py` holds the same columns as SQL for the
independent check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspan.session import bound_tasks, prepare, small_table


def zone_name(number: Column) -> Column:
    return F.concat(F.lit("Z"), F.lpad(number.cast("string"), 2, "0"))


def _jitter(key: Column, factor: int) -> Column:
    """A spread of about a hundredth of a degree that depends only on the key."""
    return ((key * factor) % 401 - 200).cast("double") / F.lit(20000.0)


HUB = {"hub_id": "HUB", "lat": 41.3395, "lon": 2.1365, "radius_m": 400.0}
HUBS = (HUB, {"hub_id": "HUB-N", "lat": 41.3415, "lon": 2.1385, "radius_m": 500.0})
# Sources a message may name, their kind and license.
SOURCES = (
    ("simulator/gps", "simulated", "MIT"),
    ("simulator/telemetry", "simulated", "MIT"),
    ("simulator/handheld", "simulated", "MIT"),
    ("opendata/sections", "real", "CC BY 4.0"),
    ("planner/baseline", "platform", "MIT"),
)
FLEET = 40  # vans of the depot


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = bound_tasks(prepare(spark))
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Reference data -----------------------------------------------------------------------------

    def hub(self) -> DataFrame:
        return small_table(
            self.spark, [tuple(h.values()) for h in HUBS], "hub_id string, lat double, lon double, radius_m double"
        )

    def sources(self) -> DataFrame:
        return small_table(self.spark, list(SOURCES), "source_id string, kind string, license string")

    def zones(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            zone_name(k).alias("zone_id"),
            F.col("n_name").alias("name"),
            k.alias("zone_no"),
            ((k % 7 + 1).cast("double") / 100).alias("share"),
            (40 + k).cast("int").alias("stops_per_route"),
            (F.lit(2.5) + k % 4).alias("minutes_per_stop"),
            F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int")).alias("difficulty"),
            (F.lit(41.3) + (k % 5) * F.lit(0.03)).alias("lat"),
            (F.lit(2.05) + (k - k % 5).cast("double") / 5 * F.lit(0.03)).alias("lon"),
        )

    def vans(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            F.concat(F.lit("V-"), k.cast("string")).alias("vehicle_id"),
            zone_name(F.col("s_nationkey")).alias("home_zone_id"),
            F.element_at(F.array(F.lit("electric"), F.lit("diesel"), F.lit("cng")), (k % 3 + 1).cast("int")).alias("type_id"),
            (80 + k % 5 * 20).cast("int").alias("capacity"),
            (k % 4 == 0).alias("afternoon"),
        )

    def drivers(self) -> DataFrame:
        k, n = F.col("s_suppkey"), F.col("s_nationkey")
        return self.table("supplier").select(
            F.concat(F.lit("D-"), k.cast("string")).alias("driver_id"),
            F.when(k % 4 == 0, "afternoon").otherwise("morning").alias("shift_id"),
            F.array(zone_name(n), zone_name((n + 1) % 25), zone_name((n + 2) % 25)).alias("zones"),
            F.when(k % 2 == 0, F.array(F.lit("electric"), F.lit("diesel"))).otherwise(F.array(F.lit("cng"))).alias("vehicle_types"),
        )

    def shippers(self) -> DataFrame:
        k, n = F.col("c_custkey"), F.col("c_nationkey")
        return self.table("customer").select(
            k.alias("shipper_id"),
            (k % 10 + 1).cast("double").alias("weight"),
            ((k % 5).cast("double") / 4).alias("business_share"),
            ((k % 4).cast("double") / 4).alias("same_day_share"),
            (k % 3 == 0).alias("midday"),
            F.array(zone_name(n), zone_name((n + 7) % 25)).alias("zones"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_name").alias("name"),
        )

    def mixed_envelopes(self) -> DataFrame:
        return envelope_columns(mixed_message_columns(self.table("events")))

    def size(self, name: str) -> Column:
        """The number of rows of a table, as a scalar subquery: keys derived with it reach all of the table."""
        return self.table(name).agg(F.count(F.lit(1))).scalar()

    def notes(self) -> DataFrame:
        k = F.col("d.doc_id")
        suffix = (
            F.when(k % 7 == 0, " Leave it at the office reception.")
            .when(k % 7 == 1, " Es un pis, 3r 2a, El Prat.")
            .when(k % 7 == 2, " Call 612 345 678, Sant Boi.")
            .when(k % 7 == 3, " Porta del costat, Vallvidrera 22@.")
            .otherwise("")
        )
        return (
            self.table("documents").alias("d")
            .join(self.table("labels").alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left")
            .select(
                k.alias("note_id"),
                F.concat(F.col("d.text"), suffix).alias("text"),
                F.col("d.lang").alias("language"),
                F.when(k % 11 == 0, "business hours").when(k % 2 == 0, "access").otherwise("schedule").alias("category"),
                (F.col("l.quality") == 1).alias("likely_longer_stop"),
                (F.col("l.toxic") == 1).alias("likely_failed_attempt"),
            )
        )

    # Registers ----------------------------------------------------------------------------------

    def streets(self) -> DataFrame:
        return self.table("part").select(
            F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("street_code"), F.col("p_name").alias("street_name")
        )

    def city_addresses(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("row_no"),
            F.lpad((k % (self.size("part") + 20) + 1).cast("string"), 6, "0").alias("street_code"),
            F.lpad((k % 300).cast("string"), 4, "0").alias("street_number"),
            F.when(k % 7 == 0, "A ").otherwise("  ").alias("number_letter"),
            F.lpad((F.col("c_nationkey") % 12).cast("string"), 2, "0").alias("district_code"),
            F.lpad((k % 42).cast("string"), 2, "0").alias("postal_district"),
            (F.lit(41.4) + (k % 100).cast("double") / 1000).alias("lat"),
            F.when(k % 13 != 0, F.lit(2.1) + (k % 90).cast("double") / 1000).alias("lon"),
        )

    def regional_addresses(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            F.concat(F.lit("A"), k.cast("string")).alias("address_id"),
            F.concat(F.lit("NÀTION "), F.col("s_nationkey").cast("string")).alias("municipality"),
            F.when(k % 9 == 0, "bloc").otherwise("vianum ").alias("address_type"),
            F.lit("carrer").alias("street_type"),
            F.when(k % 3 == 0, "de l'").when(k % 3 == 1, "del").otherwise("").alias("street_article"),
            F.col("s_name").alias("street_name"),
            F.when(k % 5 == 0, "0").otherwise((k % 50).cast("string")).alias("number_from"),
            F.when(k % 4 == 1, "B").otherwise("").alias("number_from_suffix"),
            F.when(k % 6 == 0, (k % 50 + 2).cast("string")).otherwise("").alias("number_to"),
            F.lit("").alias("number_to_suffix"),
            F.concat(F.lit("08"), F.lpad((k % 990).cast("string"), 3, "0")).alias("postcode"),
            (F.lit(425000.0) + k * 11 % 20000).alias("easting"),
            (F.lit(4580000.0) + k * 17 % 20000).alias("northing"),
        )

    def served(self) -> DataFrame:
        """District codes and normalised town names of the served zones."""
        n = F.col("zone_no")
        return self.zones().where(n > 0).select(
            "zone_id",
            F.lpad(n.cast("string"), 2, "0").alias("district_code"),
            F.when(n > 10, F.concat(F.lit("nation"), n.cast("string"))).alias("town"),
        )

    def health(self) -> DataFrame:
        """Probes of the services."""
        return self.table("events").select(
            F.col("event_type").alias("service"), F.col("ts").alias("checked_at"), (F.col("value") > 5).alias("up"),
            F.col("event_id").alias("probe_id"),
        )

    # Operations ---------------------------------------------------------------------------------

    def orders(self) -> DataFrame:
        k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
        n = F.col("c_nationkey")
        morning = k % 5 < 3
        return (
            self.table("orders")
            .join(self.table("customer").select("c_custkey", "c_nationkey"), c == F.col("c_custkey"))
            .select(
                k.alias("order_id"),
                c.alias("shipper_id"),
                zone_name(n).alias("zone_id"),
                day.cast("date").alias("service_date"),
                (1 + k % 4).cast("int").alias("parcels"),
                F.when(k % 10 < 5, "small").when(k % 10 < 8, "medium").otherwise("large").alias("parcel_size"),
                F.when(c % 3 == 0, "B2B").otherwise("B2C").alias("customer_type"),
                F.when(k % 8 == 0, "same_day").otherwise("next_day").alias("service_level"),
                F.when(morning, "morning").otherwise("afternoon").alias("wave"),
                F.when(c % 3 == 0, "opening_hours").when(k % 2 == 0, "slot").otherwise("wave").alias("window_type"),
                F.when(morning, F.expr("o_orderdate + INTERVAL 8 HOUR")).otherwise(F.expr("o_orderdate + INTERVAL 15 HOUR")).alias("window_start"),
                F.when(morning, F.expr("o_orderdate + INTERVAL 10 HOUR")).otherwise(F.expr("o_orderdate + INTERVAL 17 HOUR")).alias("window_end"),
                F.when(k % 3 == 0, k % self.size("documents")).alias("note_id"),
                (F.lit(41.3) + (n % 5) * F.lit(0.03) + _jitter(k, 37)).alias("lat"),
                (F.lit(2.05) + (n - n % 5).cast("double") / 5 * F.lit(0.03) + _jitter(k, 53)).alias("lon"),
                F.when(k % 8 == 0, F.expr("o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))"))
                .otherwise(F.expr("o_orderdate - INTERVAL 1 DAY + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))"))
                .alias("registered_at"),
            )
        )

    def plan_stops(self) -> DataFrame:
        day = F.col("o_orderdate")
        return (
            self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat(F.lit("P-"), F.col("l_suppkey").cast("string"), F.lit("-"), day.cast("date").cast("string")).alias("route_id"),
                F.concat(F.lit("V-"), F.col("l_suppkey").cast("string")).alias("vehicle_id"),
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_no"),
                day.cast("date").alias("service_date"),
                F.expr("o_orderdate + INTERVAL 8 HOUR + make_dt_interval(0, 0, CAST((l_orderkey * 7 + l_linenumber * 45) % 540 AS INT))").alias("planned_arrival"),
                F.col("l_shipdate").alias("actual_arrival"),
                F.col("l_quantity").alias("leg_distance_km"),
            )
        )

    # Streams ------------------------------------------------------------------------------------

    @staticmethod
    def _route() -> Column:
        return F.concat(
            F.lit("R-"), F.col("ts").cast("date").cast("string"), F.lit("-"), (F.col("user_id") % 20).cast("string")
        )

    def pings(self) -> DataFrame:
        return ping_columns(self.table("events"))

    def scans(self) -> DataFrame:
        return scan_columns(self.table("events"))

    def telemetry(self) -> DataFrame:
        return telemetry_columns(self.table("events"))

    def routes(self) -> DataFrame:
        """One row per route of the vans: its wave, main zone, van type and planned times."""
        n = F.col("route_no")
        per_route = self.table("events").select(
            self._route().alias("route_id"), F.col("ts").cast("date").alias("service_date"),
            (F.col("user_id") % 20).cast("int").alias("route_no"),
        ).distinct()
        return per_route.select(
            "route_id", "service_date", "route_no",
            F.when(n < 12, "morning").otherwise("afternoon").alias("wave"),
            zone_name(n % 10).alias("zone_id"),
            F.element_at(F.array(F.lit("electric"), F.lit("diesel"), F.lit("cng")), n % 3 + 1).alias("type_id"),
            (300 + n * 7).cast("double").alias("planned_minutes"),
        )

    def promises(self) -> DataFrame:
        """The window promised for each order of the scans."""
        return self.table("events").groupBy(F.expr("event_id div 3").alias("order_id")).agg(
            F.min("ts").alias("first_seen")
        ).select(
            "order_id",
            F.expr("first_seen - make_dt_interval(0, 0, CAST(order_id % 90 AS INT))").alias("window_start"),
            F.expr("first_seen - make_dt_interval(0, 0, CAST(order_id % 90 AS INT)) + INTERVAL 60 MINUTE").alias("window_end"),
        )

    def photos(self) -> DataFrame:
        """Listing of stored photos: most delivered orders, and some that no scan names."""
        d = self.table("events").where("event_type IN ('purchase', 'click')").where("value > 2")
        return d.select(
            F.concat(F.lit("pod/"), F.col("ts").cast("date").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"),
            F.col("event_id").alias("length"),
        )

    def weather(self) -> DataFrame:
        """Readings per zone: time, WMO code and rain."""
        return self.table("events").where("event_type = 'signup'").select(
            zone_name((F.col("user_id") % 10).cast("int")).alias("zone_id"),
            F.col("ts").alias("read_at"),
            F.element_at(F.array(*[F.lit(c) for c in (0, 3, 61, 95)]), (F.col("event_id") % 4 + 1).cast("int")).alias("weather_code"),
            (F.col("value") / 100).alias("precipitation_mm"),
        ).groupBy("zone_id", "read_at").agg(F.max("weather_code").alias("weather_code"), F.max("precipitation_mm").alias("precipitation_mm"))

    def traffic(self) -> DataFrame:
        """States per section from two feeds."""
        k = F.col("event_id")
        return self.table("events").where("event_type IN ('click', 'view')").select(
            F.when(F.col("event_type") == "click", "trams").otherwise("itineraris").alias("feed"),
            (F.col("user_id") % 50).cast("int").alias("feed_item_id"),
            F.col("ts").alias("event_time"),
            (k % 7).cast("int").alias("state"),
            (k % 5).cast("int").alias("forecast"),
        )

    def fuel_prices(self) -> DataFrame:
        """Price per product and moment."""
        return self.table("events").where("event_type = 'error'").select(
            F.element_at(F.array(F.lit("diesel"), F.lit("cng")), (F.col("event_id") % 2 + 1).cast("int")).alias("product"),
            F.col("ts").alias("priced_at"),
            (F.lit(1.2) + (F.col("event_id") % 90).cast("double") / 100).alias("price"),
        ).groupBy("product", "priced_at").agg(F.max("price").alias("price"))

    def messages(self) -> DataFrame:
        """Stream messages, valid ones and one of every defect, with the reason each should get."""
        return message_columns(self.table("events"))

    def envelopes(self) -> DataFrame:
        return envelope_columns(self.messages())


# Columns of the streams, also used on streaming reads of the events ------------------------------


def ping_columns(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select(
        F.concat(F.lit("V-"), F.col("user_id").cast("string")).alias("vehicle_id"),
        Inputs._route().alias("route_id"),
        F.col("ts").alias("event_time"),
        (F.lit(41.3395) + _jitter(k, 37)).alias("lat"),
        (F.lit(2.1365) + _jitter(k, 53)).alias("lon"),
        (F.col("value") / 10).alias("speed_kmh"),
        k,
        F.when(F.col("user_id") % 20 < 15, HUBS[0]["hub_id"]).otherwise(HUBS[1]["hub_id"]).alias("hub_id"),
    )


def scan_columns(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.expr("event_id div 3").alias("order_id"),
        Inputs._route().alias("route_id"),
        F.when(kind == "purchase", "delivered").when(kind == "error", "failed")
        .when(kind == "signup", "out_for_delivery").otherwise("arrived").alias("status"),
        F.when(kind == "error", "recipient_absent").alias("failure_reason"),
        F.col("ts").alias("event_time"),
        F.when(kind == "purchase", F.concat(F.lit("pod/"), F.col("ts").cast("date").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg"))).alias("pod_object_key"),
    )


def telemetry_columns(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select(
        F.concat(F.lit("V-"), F.col("user_id").cast("string")).alias("vehicle_id"),
        Inputs._route().alias("route_id"),
        F.col("ts").alias("event_time"),
        (k.cast("double") / 10).alias("odometer_km"),
        (k.cast("double") / 40).alias("energy_used_total"),
        (k % 3 != 0).alias("ignition_on"),
        F.when(k % 4 == 0, F.lit(0.0)).otherwise(F.col("value") / 10).alias("speed_kmh"),
        (k % 5 < 2).alias("cargo_door_open"),
    )


def message_columns(events: DataFrame) -> DataFrame:
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    iso = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    case = k % 12

    def ping(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    end = ',"source":"simulator/gps","schema_version":1}'
    value = (
        F.when(case == 1, F.lit(None).cast("string"))
        .when(case == 2, "not json")
        .when(case == 3, "[1, 2]")
        .when(case == 4, ping('{"vehicle_id":"V-', user, '"', end))
        .when(case == 5, ping('{"vehicle_id":"V-1","event_time":"', iso, 'Z","source":"simulator/gps","schema_version":2}'))
        .when(case == 6, ping('{"vehicle_id":"V-1","event_time":"', iso, '"', end))
        .when(case == 7, ping('{"vehicle_id":"V-1","event_time":"', iso, 'Z","heading_deg":134.5,"lat":"x"', end))
        .when(case == 8, ping('{"vehicle_id":"V-1","event_time":"', iso, 'Z","source":"simulator/drone","schema_version":1}'))
        .otherwise(
            ping(
                '{"vehicle_id":"V-', user, '","event_time":"', iso, 'Z","lat":41.3,"lon":2.1,"speed_kmh":',
                F.col("value").cast("string"), ',"source":"simulator/gps","schema_version":1,"satellites":',
                (k % 15).cast("string"), "}",
            )
        )
    )
    expected = {
        11: "unknown_topic", 1: "empty_message", 2: "invalid_json", 3: "not_an_object", 4: "missing_field",
        5: "unsupported_schema_version", 6: "invalid_field", 7: "invalid_field", 8: "unknown_source",
    }
    reason = F.lit(None).cast("string")
    for number, name in expected.items():
        reason = F.when(case == number, name).otherwise(reason)
    return events.select(
        F.when(case == 11, "orders.created").otherwise("gps.pings").alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("kafka_partition"),
        k.alias("kafka_offset"),
        value.alias("value"),
        reason.alias("expected_reason"),
        F.concat(F.lit("V-"), user).alias("vehicle_id"),
        F.col("ts"),
    )


def mixed_message_columns(events: DataFrame) -> DataFrame:
    """Messages of all topics in about the mix of a working day: 82 pings, 14 of telemetry and 3 delivery events in a hundred, and
    one of a topic nobody reads, each under a name of its own."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    iso = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    case = k % 100
    topic = (
        F.when(case < 82, "gps.pings").when(case < 96, "vehicle.telemetry").when(case < 99, "delivery.events")
        .otherwise(F.concat(F.lit("other."), k.cast("string")))
    )
    head = F.concat(
        F.lit('{"vehicle_id":"V-'), user, F.lit('","event_time":"'), iso, F.lit('Z","source":"simulator/gps","schema_version":1'),
    )
    ping = F.concat(F.lit(',"lat":41.3,"lon":2.1,"speed_kmh":'), (k % 90).cast("string"))
    telemetry = F.concat(
        F.lit(',"odometer_km":'), F.floor(k / 8).cast("string"), F.lit(".5,"), F.lit('"energy_used_total":'), (k % 1000).cast("string"),
        F.lit('.25,"ignition_on":'), F.when(k % 3 != 0, "true").otherwise("false"), F.lit(',"energy_unit":"kWh"'),
    )
    scan = F.concat(
        F.lit(',"event_id":"00000000-0000-4000-8000-'), F.lpad(k.cast("string"), 12, "0"), F.lit('","order_id":"O-'), k.cast("string"),
        F.lit('","stop_sequence":'), (k % 70).cast("string"), F.lit(',"status":"'), F.when(k % 2 == 0, "delivered").otherwise("arrived"), F.lit('"'),
    )
    body = F.when(topic == "vehicle.telemetry", telemetry).when(topic == "delivery.events", scan).otherwise(ping)
    return events.select(
        topic.alias("topic"), (F.col("user_id") % 3).cast("int").alias("kafka_partition"), k.alias("kafka_offset"),
        F.concat(head, body, F.lit("}")).alias("value"), F.concat(F.lit("V-"), user).alias("vehicle_id"), F.col("ts"),
    )


def envelope_columns(messages: DataFrame) -> DataFrame:
    return messages.select(
        "topic",
        F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"),
        F.encode("vehicle_id", "UTF-8").alias("key"),
        F.encode("value", "UTF-8").alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )

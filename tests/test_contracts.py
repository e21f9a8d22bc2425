"""The contract on messages whose outcome is known because they were built for it."""

import json

import pytest

from parcelspan.operators.contracts import (
    CONTRACTS, DELIVERY_EVENTS, ENVELOPE, GPS_PINGS, VEHICLE_TELEMETRY, classify, clean_error, dead_letters_of,
    refuse_unstorable, rows_of,
)

PING = {
    "vehicle_id": "V-1", "route_id": "R-1", "event_time": "2026-09-28T06:14:30Z", "lat": 41.3, "lon": 2.1, "speed_kmh": 12.5,
    "heading_deg": 134, "accuracy_m": 4.2, "source": "simulator/gps", "schema_version": 1,
}
TELEMETRY = {
    "vehicle_id": "V-1", "event_time": "2026-09-28T06:14:30Z", "speed_kmh": 0.0, "odometer_km": 48213.46, "ignition_on": False,
    "energy_level_pct": 88.6, "energy_used_total": 28687.5184, "energy_unit": "kWh", "cargo_door_open": True,
    "source": "simulator/telemetry", "schema_version": 1,
}
EVENT = {
    "event_id": "6BA7B8109DAD11D180B400C04FD430C8", "order_id": "O-1", "stop_sequence": 3.0, "status": "delivered",
    "event_time": "2026-09-28T08:14:30+02:00", "source": "simulator/handheld", "schema_version": 1,
}
SOURCES = ["simulator/gps", "simulator/telemetry", "simulator/handheld"]


def outcomes(spark, values, topic="gps.pings"):
    rows = [
        (topic, 0, i, b"k", v if isinstance(v, (bytes, type(None))) else json.dumps(v).encode(), None) for i, v in enumerate(values)
    ]
    sources = spark.createDataFrame([(s,) for s in SOURCES], "source_id string")
    judged = refuse_unstorable(classify(spark.createDataFrame(rows, ENVELOPE), sources))
    return judged


def reasons(spark, values, topic="gps.pings"):
    found = {r["offset"]: r["reason"] for r in outcomes(spark, values, topic).select("offset", "reason").collect()}
    return [found[i] for i in range(len(values))]


def changed(base, **fields):
    return {k: v for k, v in {**base, **fields}.items() if v is not ...}


def test_stages(spark):
    cases = [
        (PING, None),
        (None, "empty_message"),
        (b"", "empty_message"),
        (b"not json", "invalid_json"),
        (b'{"lat": NaN}', "invalid_json"),
        (b'{"lat": Infinity}', "invalid_json"),
        (b'{"a":1} x', "invalid_json"),
        (b'{"a":1}}', "invalid_json"),
        (b'{"a":1}, {"b":2}', "invalid_json"),
        (b'{"a":1}]', "invalid_json"),
        (b'{"m":"\xff"}', "invalid_json"),
        (b"[1, 2]", "not_an_object"),
        (b"null", "not_an_object"),
        (b"true", "not_an_object"),
        (b"12", "not_an_object"),
        (b'"text"', "not_an_object"),
        (changed(PING, vehicle_id=...), "missing_field"),
        (changed(PING, event_time=None), "missing_field"),
        (changed(PING, source=""), "missing_field"),
        (changed(PING, schema_version=2), "unsupported_schema_version"),
        (changed(PING, schema_version="1"), "unsupported_schema_version"),
        (changed(PING, schema_version=True), "unsupported_schema_version"),
        (changed(PING, schema_version=[1]), "unsupported_schema_version"),
        (changed(PING, schema_version=1.0), None),
        (changed(PING, source="simulator/drone"), "unknown_source"),
        (changed(PING, lat=0, heading_deg=720, speed_kmh=-4), None),
        (changed(PING, extra={"a": "x\u0000y"}), "rejected_by_database"),
        (changed(PING, extra={"a": "x\\u0000y"}), None),
        (b" " + json.dumps(PING).encode() + b"\n", None),
    ]
    assert reasons(spark, [c for c, _ in cases]) == [r for _, r in cases]


INVALID = {
    "gps.pings": (PING, [
        {"lat": "41.3"}, {"lat": True}, {"heading_deg": 134.5}, {"heading_deg": 40000}, {"heading_deg": "134"}, {"speed_kmh": 1e39},
        {"vehicle_id": 7}, {"vehicle_id": "V\u0000"}, {"route_id": {"a": 1}}, {"event_time": "yesterday"}, {"event_time": "2026-09-28T06:14:30"},
        {"event_time": "2026-02-30T06:14:30Z"}, {"event_time": 1790000000},
    ]),
    "vehicle.telemetry": (TELEMETRY, [{"ignition_on": 1}, {"odometer_km": 1e9}, {"energy_used_total": "5"}]),
    "delivery.events": (EVENT, [{"event_id": "not-a-uuid"}, {"stop_sequence": True}, {"lat": []}]),
}


@pytest.mark.parametrize("topic", INVALID)
def test_invalid_fields(spark, topic):
    base, cases = INVALID[topic]
    judged = outcomes(spark, [changed(base, **fields) for fields in cases], topic).orderBy("offset").collect()
    for row, fields in zip(judged, cases, strict=True):
        assert row["reason"] == "invalid_field" and row["error"].startswith(next(iter(fields)) + ": "), fields


def test_all_bad_fields_are_named_in_order(spark):
    judged = outcomes(spark, [changed(PING, heading_deg=1.5, lat="x", vehicle_id=3)]).first()
    assert [part.split(":")[0] for part in judged["error"].split("; ")] == ["vehicle_id", "lat", "heading_deg"]
    judged = outcomes(spark, [changed(PING, source=None, vehicle_id="")]).first()
    assert judged["error"] == "missing vehicle_id, source"


def test_accepted_times(spark):
    texts = ["2026-09-28T06:14:30Z", "2026-09-28T08:14:30+02:00", "2026-09-28 08:14:30+0200", "20260928T061430Z", "2026-09-28T06:14:30.000Z"]
    rows = rows_of(outcomes(spark, [changed(PING, event_time=t) for t in texts]), GPS_PINGS)
    assert [r["t"] for r in rows.selectExpr("cast(event_time as string) t").collect()] == ["2026-09-28 06:14:30"] * len(texts)
    (short,) = rows_of(outcomes(spark, [changed(PING, event_time="2026-09-28T08:14+02:00")]), GPS_PINGS).collect()
    assert str(short["event_time"]) == "2026-09-28 06:14:00"


def test_rows_are_typed(spark):
    row = rows_of(outcomes(spark, [changed(TELEMETRY, charging=False, tyres=[4.7, None])], "vehicle.telemetry"), VEHICLE_TELEMETRY).first()
    assert str(row["odometer_km"]) == "48213.5" and str(row["energy_used_total"]) == "28687.518"
    assert json.loads(row["readings"]) == {"charging": False, "tyres": [4.7, None]}
    row = rows_of(outcomes(spark, [TELEMETRY], "vehicle.telemetry"), VEHICLE_TELEMETRY).first()
    assert row["readings"] == "{}" and row["ignition_on"] is False
    row = rows_of(outcomes(spark, [EVENT], "delivery.events"), DELIVERY_EVENTS).first()
    assert row["event_id"] == "6ba7b810-9dad-11d1-80b4-00c04fd430c8" and row["stop_sequence"] == 3 and row["extra_fields"] is None


def test_last_of_repeated_keys_counts(spark):
    value = json.dumps(PING)[:-1] + ', "lat": 40.0}'
    assert rows_of(outcomes(spark, [value.encode()]), GPS_PINGS).first()["lat"] == 40.0


def test_unknown_topic_and_bytes_kept(spark):
    assert reasons(spark, [PING], "orders.created") == ["unknown_topic"]
    dead = dead_letters_of(outcomes(spark, [b"\x00\xff broken"])).first()
    assert bytes(dead["payload"]) == b"\x00\xff broken" and dead["reason"] == "invalid_json"


def test_errors_are_cleaned_and_cut(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(clean_error(F.concat(F.lit("a\u0000b"), F.repeat(F.lit("x"), 2000))).alias("e")).first()
    assert row["e"].startswith("a\\x00b") and len(row["e"]) == 1000


def test_contracts_have_their_keys():
    for c in CONTRACTS:
        assert set(c.key) <= set(c.names) and set(c.required) <= set(c.names)

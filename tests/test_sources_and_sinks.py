import json

import pytest
from pyspark.sql import functions as F

from parcelspan.functions import calendar as cal
from parcelspan.functions import text
from parcelspan.operators.keyed import content_digest, multiset_difference, upper_median
from parcelspan.sinks import tables
from parcelspan.sources import documents, feeds, registers


def test_geojson_polygon_and_multipolygon(spark, tmp_path):
    square = [[2.0, 41.0], [2.1, 41.0], [2.1, 41.1], [2.0, 41.0]]
    hole = [[2.05, 41.02], [2.06, 41.02], [2.06, 41.03], [2.05, 41.02]]
    features = [
        {"properties": {"zone_id": "A"}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"properties": {"zone_id": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [hole]]}},
    ]
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rings = documents.geojson_rings(spark, str(path), "zone_id").collect()
    assert sorted((r["zone_id"], len(r["points"]), r["points"][0]["lon"]) for r in rings) == [("A", 4, 2.0), ("A", 4, 2.05), ("B", 4, 2.0), ("B", 4, 2.05)]


def test_company_document(spark, tmp_path):
    path = tmp_path / "company.json"
    path.write_text(json.dumps({"zones": [{"zone_id": "Z01", "districts": ["x", "y"]}, {"zone_id": "Z02", "districts": []}]}, indent=2))
    doc = documents.read_document(spark, str(path), "zones array<struct<zone_id: string, districts: array<string>>>")
    assert [tuple(r) for r in documents.flatten_company(doc, "zones").orderBy("zone_id").collect()] == [("Z01", ["x", "y"]), ("Z02", [])]


def test_traffic_lines(spark):
    lines = ["1#20260928220554#6#6", "3#1#20260928221054#306#304#1#1#1", "broken", "5#20260128220554#1#"]
    got = {r["raw_line"]: r for r in feeds.traffic_lines(spark.createDataFrame([(x,) for x in lines], "raw_line string")).collect()}
    assert str(got[lines[0]]["event_time"]) == "2026-09-28 20:05:54" and got[lines[0]]["state"] == 6
    assert got[lines[1]]["feed"] == "itineraris" and got[lines[1]]["travel_time_forecast_s"] == 304
    assert got["broken"]["feed_item_id"] is None and got["broken"]["event_time"] is None
    assert str(got[lines[3]]["event_time"]) == "2026-01-28 21:05:54" and got[lines[3]]["state_forecast"] is None


@pytest.mark.parametrize(
    "lines,reason",
    [
        (['1,"a, b",c', "2,d,e"], None),
        (["1,a,b", "2,c"], "1 lines have other fields than the header"),
        (["1,a,b", '2,"c,d'], "a quote is left open"),
        (["1,a,b"], "1 data rows, fewer than 2"),
        ([""], "no data rows"),
    ],
)
def test_csv_verdict(spark, lines, reason):
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert registers.csv_verdict(df, "k,a,b", ("k",), 2).first()["reason"] == reason


def test_csv_verdict_names_missing_columns(spark):
    df = spark.createDataFrame([("1,2",)], "line string")
    assert registers.csv_verdict(df, "k,a", ("k", "x", "y"), 1).first()["reason"] == "the header lacks x, y"


def test_regional_rows_of_served_towns(spark):
    served = spark.createDataFrame([("Z10", "01", "viladecans")], "zone_id string, district_code string, town string")
    rows = [
        ("A1", "Viladecans", "vianum ", "carrer", "de l'", "Art", "5", "B", "7", "", "08901", 430000.0, 4580000.0),
        ("A2", "VILADECANS", "vianum", "avinguda", "del", "Mar", "0", "", "0", "", "08902", 430000.0, 4580000.0),
        ("A3", "viladecans", "bloc", "carrer", "", "X", "1", "", "", "", "08903", 430000.0, 4580000.0),
        ("A4", "Girona", "vianum", "carrer", "", "X", "1", "", "", "", "17001", 430000.0, 4580000.0),
    ]
    names = "address_id municipality address_type street_type street_article street_name number_from number_from_suffix number_to number_to_suffix postcode easting northing"
    df = spark.createDataFrame(rows, names.split())
    got = {r["address_ref"]: r["street_address"] for r in registers.regional_pool(df, served).collect()}
    place = registers.regional_pool(df, served).first()
    assert (place.municipality.lower(), round(place.lat, 2), round(place.lon, 2)) == ("viladecans", 41.37, 2.16)
    assert got == {"A1": "carrer de l'Art, 5B-7", "A2": "avinguda del Mar, s/n"}
    assert {r["address_id"] for r in registers.served_rows(df, served).collect()} == {"A1", "A2", "A3"}


def test_guard_and_unchanged_content(spark, tmp_path):
    path = str(tmp_path / "plans")
    base = spark.createDataFrame([("r1", "morning", 0), ("r2", "afternoon", 0), ("r2", "afternoon", 1)], "route string, wave string, plan_version int")
    tables.replace_partitions(base, path, ["wave"])
    tables.guarded_replace(base.where("wave = 'morning'"), path, ["wave"])
    with pytest.raises(tables.GuardError):
        tables.guarded_replace(base.where("plan_version = 0"), path, ["wave"])
    assert spark.read.parquet(path).count() == 3
    out = str(tmp_path / "seed")
    first = tables.stamped(base, "x")
    assert tables.write_if_changed(first, out, "x", "o", 1)
    assert not tables.write_if_changed(tables.stamped(base.repartition(3), "x"), out, "x", "o", 1)
    assert tables.write_if_changed(tables.stamped(base.limit(2), "x"), out, "x", "o", 1)


def test_days_are_cleared_archived_and_dropped(spark, tmp_path):
    path, archive = str(tmp_path / "days"), str(tmp_path / "old")
    days = spark.createDataFrame([(i, f"2026-09-0{1 + i % 4}") for i in range(8)], "n int, d string").withColumn("d", F.col("d").cast("date"))
    tables.replace_partitions(days, path, ["d"])
    again = days.where("d = DATE '2026-09-01'").limit(1)
    tables.replace_days(again, path, "d", ["2026-09-01", "2026-09-02"])
    count = lambda p: {str(r[0]): r[1] for r in spark.read.parquet(p).groupBy("d").count().collect()}
    assert count(path) == {"2026-09-01": 1, "2026-09-03": 2, "2026-09-04": 2}
    with pytest.raises(tables.GuardError):
        tables.replace_days(days, path, "d", ["2026-09-01"])
    assert tables.archive_before(spark.read.parquet(path), "d", "2026-09-02", archive, path) == 1
    assert tables.archive_before(spark.read.parquet(path), "d", "2026-09-04", archive, path) == 2
    assert tables.archive_before(spark.read.parquet(path), "d", "2026-09-04", archive, path) == 0
    assert count(path) == {"2026-09-04": 2} and count(archive) == {"2026-09-01": 1, "2026-09-03": 2}


def test_guarded_replace_keeps_other_sources(spark, tmp_path):
    path, schema = str(tmp_path / "plans"), "route string, wave string, plan_version int, source string"
    rows = spark.createDataFrame([("a", "morning", 0, "mine"), ("b", "morning", 0, "theirs"), ("c", "late", 1, "mine")], schema)
    tables.replace_partitions(rows, path, ["wave"])
    new = spark.createDataFrame([("d", "morning", 0, "mine")], schema)
    tables.guarded_replace(new, path, ["wave"], source="mine")
    assert {r.route for r in spark.read.parquet(path).where("wave = 'morning'").collect()} == {"b", "d"}
    with pytest.raises(tables.GuardError):
        tables.guarded_replace(new.withColumn("wave", F.lit("late")), path, ["wave"], source="mine")


def test_digest_sees_nulls_copies_and_not_order(spark):
    a = spark.createDataFrame([("a", None), (None, "a"), ("b", "c")], "x string, y string")
    digest = lambda df: content_digest(df).first()["digest"]
    assert digest(a) == digest(a.orderBy("x").repartition(2)) and digest(a) != digest(a.union(a))
    assert digest(a.where("x = 'a'")) != digest(a.where("y = 'a'"))
    assert multiset_difference(a.union(a), a).count() == 3 and multiset_difference(a, a.repartition(2)).count() == 0


def test_upper_median(spark):
    df = spark.createDataFrame([("k", v) for v in (5, 1, 1, 9)] + [("q", 4)], "k string, v bigint")
    assert {tuple(r) for r in upper_median(df, ["k"], "v").collect()} == {("k", 1, 5, 9, 4), ("q", 4, 4, 4, 1)}


def test_notes(spark):
    cases = [
        ("Office 3, second floor", "access", "business"), ("deixar a l'oficina", "access", "business"), ("Es una tienda de ropa", "access", "business"),
        ("leave it at the office, flat 2", "access", "home"), ("4º 2ª", "access", "home"), ("barcelona", "access", "neutral"),
        ("Dejar en la PORTERÍA", "schedule", "home"), ("casas", "schedule", "neutral"), ("anything", "business hours", "business"), ("vecinos", "other", "home"),
    ]
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, t string, c string")
    got = {r["i"]: r["x"] for r in df.select("i", text.note_context(F.col("t"), F.col("c")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]
    places = spark.createDataFrame([("al 22@, el prat y EL PRAT",), ("Sant Joan Despí",), ("pratense",)], "t string")
    assert [r[0] for r in places.select(F.array_join(text.places_named(F.col("t"), text.PLACES), ",")).collect()] == ["22@,El Prat", "Sant Joan Despí", ""]
    assert places.select(text.zones_named(F.col("t"), text.PLACES)).collect()[1][0] == ["outside"]


def test_calendar(spark):
    days = {"2026-11-23": 1.6, "2026-11-22": 1.0, "2026-11-30": 1.6, "2026-12-01": 1.4, "2025-12-01": 1.6, "2025-12-02": 1.4, "2026-07-01": 0.9, "2026-01-01": 1.0}
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", cal.seasonal_multiplier(F.col("d").cast("date"), {11: 1.6, 12: 1.4, 7: 0.9}).alias("m"))
    assert {r["d"]: r["m"] for r in df.collect()} == days
    ranges = cal.opening_ranges(F.lit("09:15"), F.lit("19:00"), F.lit("14:00-16:00"))
    starts = spark.range(1).select(cal.window_starts(ranges, F.lit(480), F.lit(900), 120).alias("s")).first()["s"]
    assert starts == [570, 600, 630, 660, 690, 720]
    promise = [cal.promised_start(F.lit(m), F.lit(480), F.lit(900), 120).alias(f"m{m}") for m in (500, 605, 629, 2000)]
    assert list(spark.range(1).select(*promise).first()) == [480, 540, 540, 780]


def test_verdict_on_files_of_unlike_faults(spark, tmp_path):
    from parcelspan.sources.registers import csv_file_verdict

    head = "code,name,brand\n"
    bodies = {
        "whole": '1,"a, ""b""\nsecond line",x\n2,c,y\n', "open": '1,a,x\n2,"b,y\n3,c,z\n', "ragged": '1,a,x\n2,b\n3,c,z,9\n', "few": "1,a,x\n", "none": "",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_text(head + body)
    got = {r["file"].split("/")[-1][:-4]: tuple(r)[1:] for r in csv_file_verdict(spark, f"{tmp_path}/*.csv", ("code", "brand"), 2).collect()}
    assert got["whole"] == (2, 0, None)
    assert got["open"] == (2, 1, "a quote is left open")
    assert got["ragged"] == (3, 2, "2 lines have other fields than the header")
    assert got["few"] == (1, 0, "1 data rows, fewer than 2") and got["none"] == (0, 0, "no data rows")
    lacking = csv_file_verdict(spark, f"{tmp_path}/few.csv", ("code", "town"), 1).first()
    assert lacking["reason"] == "the header lacks town"


def test_section_points_skip_what_is_no_point(spark, tmp_path):
    from parcelspan.operators.traffic import nearest_section, polylines
    from parcelspan.sources.feeds import section_points

    (tmp_path / "s.csv").write_text("section_id,point_seq,lon,lat\n1,2,2.002,41.0\n1,1,2.0,41.0\nx,1,2.0,41.0\n2,1,2.0,41.5\n3,1,,41.0\n")
    lines = polylines(section_points(spark, str(tmp_path / "s.csv")))
    got = {r["section_id"]: (r["n_points"], round(r["length_m"])) for r in lines.collect()}
    assert got == {1: (2, 168), 2: (1, 0)}
    places = spark.createDataFrame([(1, 41.0005, 2.001), (2, 41.1, 2.0), (3, None, 2.0), (4, 41.0, 2.0025)], "id int, lat double, lon double")
    near = {r["id"]: (r["section_id"], r["distance_m"] and round(r["distance_m"])) for r in nearest_section(places, lines, "lat", "lon").collect()}
    assert near == {1: (1, 56), 2: (None, None), 3: (None, None), 4: (1, 42)}

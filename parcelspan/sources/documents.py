"""Nested documents: company files, feeds with a header object, boundaries as GeoJSON or WKT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<struct<lon:double,lat:double>>"


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one document, with its schema given and never guessed."""
    return spark.read.schema(schema).json(path, multiLine=True)


def fuel_prices(documents: DataFrame, column: str, stations: str, products: Sequence[tuple[str, str]]) -> DataFrame:
    """A price document to one row per station and product sold. Numbers have decimal commas; an empty
    text means the product is not sold. `products` pairs the document's key with the product's name."""
    keys = "".join(f", `{key}`: string" for key, _ in products)
    schema = f"struct<`taken_at`: string, `{stations}`: array<struct<`station_id`: string, `latitude`: string{keys}>>>"
    doc = documents.select(F.from_json(column, schema).alias("d")).select("d.taken_at", F.explode(F.col("d")[stations]).alias("s"))
    offers = F.array(*[F.struct(F.lit(name).alias("product"), F.col("s")[key].alias("raw")) for key, name in products])
    sold = doc.select("taken_at", "s.station_id", decimal_comma(F.col("s.latitude")).alias("lat"), F.explode(offers).alias("o"))
    return sold.where(F.trim("o.raw") != "").select(
        "station_id", "lat", "o.product", decimal_comma(F.col("o.raw")).alias("price"),
        F.try_to_timestamp("taken_at", F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz").alias("priced_at"),
    )


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def weather_reading(documents: DataFrame, column: str, *carried: str) -> DataFrame:
    """A forecast answer to one row: the nested current values with their units in the names."""
    schema = "struct<`current`: struct<`time`: string, temperature_2m: double, precipitation: double, weather_code: int>>"
    current = documents.select(*carried, F.from_json(column, schema)["current"].alias("c"))
    return current.select(
        *carried,
        F.try_to_timestamp("c.time", F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz").alias("event_time"),
        F.col("c.temperature_2m").alias("temperature_c"),
        F.col("c.precipitation").alias("precipitation_mm"),
        F.col("c.weather_code").alias("weather_code"),
    )


# Meaning of the weather codes.
WMO_CODES = {
    0: "clear", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "rime fog",
    51: "light drizzle", 53: "drizzle", 55: "dense drizzle", 61: "light rain", 63: "rain", 65: "heavy rain",
    71: "light snow", 73: "snow", 75: "heavy snow", 80: "light showers", 81: "showers", 82: "violent showers",
    95: "thunderstorm", 96: "thunderstorm with hail", 99: "thunderstorm with heavy hail",
}


def wkt_rings(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text as an array of point arrays."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def point(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(xy[0].cast("double").alias("lon"), xy[1].cast("double").alias("lat"))

    return F.transform(rings, lambda ring: F.transform(F.split(ring, ","), point))


def geojson_rings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rings of a boundary file, one row per ring: a Polygon is read as a MultiPolygon of one."""
    schema = f"features array<struct<properties: struct<`{name}`: string>, geometry: struct<type: string, coordinates: string>>>"
    feature = read_document(spark, path, schema).select(F.explode("features").alias("f"))
    depth4, depth3 = "array<array<array<array<double>>>>", "array<array<array<double>>>"
    raw = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(raw, depth4)).otherwise(
        F.array(F.from_json(raw, depth3))
    )
    ring = feature.select(F.col("f.properties")[name].alias(name), F.explode(F.flatten(polygons)).alias("r"))
    return ring.select(
        name, F.transform("r", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).cast(POINTS).alias("points")
    )


def flatten_company(document: DataFrame, part: str) -> DataFrame:
    """One list of a nested company document as a table: `part` is the list's name."""
    return document.select(F.explode(part).alias("x")).select("x.*")

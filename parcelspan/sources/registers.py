"""Address and street registers: CSV scans, completeness checks and the common address pool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspan.functions.geo import utm31_to_wgs84
from parcelspan.functions.text import norm_text, register_ref, street_line, zero_stripped


BAD_RECORD = "_bad"


def read_register(spark: SparkSession, path: str, header: Sequence[str], names: Mapping[str, str], sep: str = ",") -> DataFrame:
    """A CSV with a header, every value as text, the named columns under their new names. Only those
    columns are parsed."""
    schema = ", ".join(f"`{c}` string" for c in header)
    raw = spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=False)
    return raw.select(*[F.col(old).alias(new) for old, new in names.items()])


def field_count(line: Column, sep: str = ",") -> Column:
    """Fields of a CSV line: separators outside quotes, plus one. An open quote counts as cut off (-1)."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*"', "")
    quotes = F.char_length(bare) - F.char_length(F.replace(bare, F.lit('"'), F.lit("")))
    separators = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit("")))
    return F.when(quotes > 0, F.lit(-1)).otherwise(separators + 1)


def csv_verdict(lines: DataFrame, header: str, columns: Sequence[str], min_rows: int, sep: str = ",") -> DataFrame:
    """Why a CSV is not complete, NULL when it is: header columns, fields of every line, number of rows.
    `lines` has one data line per row in `line`; the verdict is one aggregation."""
    names = header.split(sep)
    lacking = [c for c in columns if c not in names]
    fields = field_count(F.col("line"), sep)
    figures = lines.where("line <> ''").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(fields != len(names)).alias("ragged"),
        F.count_if(fields == -1).alias("open_quotes"),
    )
    reason = (
        F.when(F.lit(bool(lacking)), F.lit(f"the header lacks {', '.join(lacking)}"))
        .when(F.col("open_quotes") > 0, F.lit("a quote is left open"))
        .when(F.col("ragged") > 0, F.concat(F.col("ragged").cast("string"), F.lit(" lines have other fields than the header")))
        .when(F.col("n") == 0, F.lit("no data rows"))
        .when(F.col("n") < min_rows, F.concat(F.col("n").cast("string"), F.lit(f" data rows, fewer than {min_rows}")))
    )
    return figures.select(F.col("n").alias("n_rows"), F.col("ragged").alias("ragged_rows"), reason.alias("reason"))


def csv_file_verdict(spark: SparkSession, path: str, columns: Sequence[str], min_rows: int, sep: str = ",") -> DataFrame:
    """The same verdict on CSV files as they are read: a quoted line break belongs to its record, and a quote that is open at the end of a file
    takes the rest of it. One row per file, with its path; all files have the header of the first line of the first one."""
    first = spark.read.option("multiLine", True).option("header", False).option("sep", sep).csv(path).limit(1)
    names = [str(v) for v in first.first()] if not first.isEmpty() else []
    kept = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"`{c}` string" for c in [*kept, BAD_RECORD])
    raw = (
        spark.read.schema(schema).option("multiLine", True).option("header", True).option("sep", sep).option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD).option("enforceSchema", True).csv(path)
    ).select(*kept, BAD_RECORD, F.col("_metadata.file_path").alias("file"))
    bad = F.col(BAD_RECORD)
    quotes = F.char_length(bad) - F.char_length(F.replace(bad, F.lit('"'), F.lit("")))
    # Names all columns: records are only judged by those that are asked for.
    read = F.char_length(F.concat_ws("", *kept)) >= 0
    figures = raw.groupBy("file").agg(
        F.count_if(read).alias("n_rows"), F.count_if(bad.isNotNull()).alias("ragged_rows"), F.count_if(quotes % 2 == 1).alias("_open")
    )
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    lacking = [c for c in columns if c not in names]
    n, ragged = F.coalesce("n_rows", F.lit(0)), F.coalesce("ragged_rows", F.lit(0))
    reason = (
        F.when(F.lit(bool(lacking)), F.lit(f"the header lacks {', '.join(lacking)}"))
        .when(F.coalesce("_open", F.lit(0)) > 0, F.lit("a quote is left open"))
        .when(ragged > 0, F.concat(ragged.cast("string"), F.lit(" lines have other fields than the header")))
        .when(n == 0, F.lit("no data rows"))
        .when(n < min_rows, F.concat(n.cast("string"), F.lit(f" data rows, fewer than {min_rows}")))
    )
    return listed.join(figures, "file", "left").select("file", n.alias("n_rows"), ragged.alias("ragged_rows"), reason.alias("reason"))


def served_rows(addresses: DataFrame, served: DataFrame, town: str = "municipality") -> DataFrame:
    """Rows of a large register whose town is served: a semi-join on the normalised name."""
    keys = served.where("town IS NOT NULL").select("town").distinct()
    return addresses.withColumn("_town", norm_text(F.col(town))).join(keys, F.col("_town") == F.col("town"), "left_semi").drop("_town")


def rows_per_group(groups: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Row count of every group, 0 for a group without rows."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


CITY = "Barcelona"  # fixed value: the town of the city register


def city_pool(addresses: DataFrame, streets: DataFrame, served: DataFrame) -> DataFrame:
    """City register rows as delivery addresses: those with a street name, a served district and a place."""
    zones = served.select("district_code", "zone_id")
    named = addresses.where("lat IS NOT NULL AND lon IS NOT NULL").join(streets, "street_code", "left")
    number = F.concat(zero_stripped(F.col("street_number")), F.trim("number_letter"))
    return named.where("street_name <> ''").join(zones, "district_code").select(
        register_ref(F.col("street_code"), F.col("street_number"), F.col("number_letter")).alias("address_ref"),
        "zone_id",
        F.concat(F.col("street_name"), F.lit(", "), number).alias("street_address"),
        F.concat(F.lit("080"), F.col("postal_district")).alias("postcode"),
        F.lit(CITY).alias("municipality"),
        F.round("lat", 7).alias("lat"),
        F.round("lon", 7).alias("lon"),
    )


def regional_pool(addresses: DataFrame, served: DataFrame) -> DataFrame:
    """Regional register rows as delivery addresses: street addresses of the served towns, placed from their UTM coordinates."""
    towns = served.where("town IS NOT NULL").select("town", "zone_id")
    kept = addresses.where(F.trim("address_type") == "vianum").withColumn("town", norm_text(F.col("municipality")))
    lat, lon = utm31_to_wgs84(F.col("easting").cast("double"), F.col("northing").cast("double"))
    return kept.join(towns, "town").select(
        F.col("address_id").alias("address_ref"),
        "zone_id",
        street_line(*[F.col(c) for c in (
            "street_type", "street_article", "street_name", "number_from", "number_from_suffix", "number_to", "number_to_suffix",
        )]).alias("street_address"),
        F.trim("postcode").alias("postcode"),
        "municipality",
        F.round(lat, 7).alias("lat"),
        F.round(lon, 7).alias("lon"),
    )


def address_pool(city: DataFrame, streets: DataFrame, regional: DataFrame, served: DataFrame) -> DataFrame:
    """Both registers as one pool."""
    return city_pool(city, streets, served).unionByName(regional_pool(regional, served))

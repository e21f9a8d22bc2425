"""Street sections as polylines, and the traffic factor of a place and moment by one of two strategies."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.functions import calendar as cal
from parcelspan.functions.geo import EARTH_RADIUS_M, haversine_m
from parcelspan.operators.temporal import asof_join, profile_asof

# Distances inside a section are measured on a plane scaled to the place's latitude.
NEAR_M = 200.0


def polylines(points: DataFrame) -> DataFrame:
    """One row per section: its points in order as an array, how many there are, and its length. `points` has section_id, point_seq, lon,
    lat; a section is as long as a street between two crossings."""
    line = F.array_sort(F.collect_list(F.struct("point_seq", "lon", "lat")))
    drawn = points.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("section_id").agg(line.alias("line"))
    legs = F.transform(
        F.sequence(F.lit(1), F.size("line") - 1),
        lambda k: haversine_m(F.get("line", k - 1).lat, F.get("line", k - 1).lon, F.get("line", k).lat, F.get("line", k).lon),
    )
    length = F.when(F.size("line") > 1, F.aggregate(legs, F.lit(0.0), lambda total, leg: total + leg)).otherwise(F.lit(0.0))
    return drawn.select("section_id", "line", F.size("line").alias("n_points"), length.alias("length_m"))


def segments(lines: DataFrame) -> DataFrame:
    """The straight pieces of the polylines: section_id, segment, and their ends."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("line") - 1),
        lambda k: F.struct(
            k.alias("segment"), F.get("line", k - 1).lon.alias("x1"), F.get("line", k - 1).lat.alias("y1"),
            F.get("line", k).lon.alias("x2"), F.get("line", k).lat.alias("y2"),
        ),
    )
    return lines.where(F.size("line") > 1).select("section_id", F.inline(pieces))


def segment_distance_m(lat: Column, lon: Column) -> Column:
    """Metres from a place to the segment (x1, y1, x2, y2)."""
    metre = F.lit(EARTH_RADIUS_M) * F.radians(F.lit(1.0))
    squeeze = F.cos(F.radians(lat))
    ax, ay = (F.col("x1") - lon) * squeeze * metre, (F.col("y1") - lat) * metre
    dx, dy = (F.col("x2") - F.col("x1")) * squeeze * metre, (F.col("y2") - F.col("y1")) * metre
    square = dx * dx + dy * dy
    along = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square)))
    return F.sqrt(F.pow(ax + along * dx, F.lit(2.0)) + F.pow(ay + along * dy, F.lit(2.0)))


def nearest_section(places: DataFrame, lines: DataFrame, lat: str, lon: str, within_m: float = NEAR_M) -> DataFrame:
    """The section with the segment nearest to each place, at most `within_m` away (ties to the lower id), as section_id and distance_m; NULL
    where there is none. Segments are filed under every cell they come within reach of, so a place reads its own cell only. Places are
    searched once however often they occur."""
    high = within_m / (EARTH_RADIUS_M * 0.017453292519943295) * 1.01  # degrees of latitude, with a margin
    wide = high / F.greatest(F.cos(F.radians(F.greatest(F.abs("y1"), F.abs("y2")) + high)), F.lit(0.01))
    cell = 2 * high
    span = lambda low, up: F.explode(F.sequence(*[F.floor(c / F.lit(cell)).cast("bigint") for c in (low, up)]))
    filed = segments(lines).withColumn("_cy", span(F.least("y1", "y2") - high, F.greatest("y1", "y2") + high))
    filed = filed.withColumn("_cx", span(F.least("x1", "x2") - wide, F.greatest("x1", "x2") + wide))
    here = [F.floor(F.col(c) / F.lit(cell)).cast("bigint") for c in (lon, lat)]
    asked = places.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), here[0].alias("_cx"), here[1].alias("_cy")).distinct()
    met = asked.join(filed, ["_cx", "_cy"]).withColumn("_d", segment_distance_m(F.col("_lat"), F.col("_lon")))
    best = met.where(F.col("_d") <= within_m).groupBy("_lat", "_lon").agg(F.min(F.struct("_d", "section_id")).alias("_b"))
    found = best.select("_lat", "_lon", F.col("_b.section_id").alias("section_id"), F.col("_b._d").alias("distance_m"))
    return places.join(found, (F.col(lat) == F.col("_lat")) & (F.col(lon) == F.col("_lon")), "left").drop("_lat", "_lon")


class Traffic(Protocol):
    """How much longer a way takes at a place and moment than on an empty road."""

    def factor(self, rides: DataFrame, when: str, lat: str, lon: str, into: str) -> DataFrame:
        """The rides with the factor as a column of their own."""


@dataclass(frozen=True)
class ProfileTraffic:
    """The factor of the local minute of the day, the same everywhere: `profile` has start and factor. Saturdays have a share of it."""

    profile: DataFrame

    def factor(self, rides: DataFrame, when: str, lat: str, lon: str, into: str) -> DataFrame:
        local = cal.local_time(F.col(when))
        timed = rides.withColumn("_minute", cal.minute_of_day(local)).withColumn("_saturday", F.weekday(local) == 5)
        looked = profile_asof(timed, self.profile.select("start", F.col("factor").alias("_factor")), "_minute", "start", "_factor")
        eased = 1 + (F.col("_factor") - 1) * F.lit(cal.SATURDAY_SHARE)
        return looked.select(*rides.columns, F.when(F.col("_saturday"), eased).otherwise(F.col("_factor")).alias(into))


@dataclass(frozen=True)
class StateTraffic:
    """The factor of the state last reported for the section nearest to the place, no older than `fresh_minutes`; elsewhere, and where the state
    tells nothing, that of the other strategy. `states` has section_id, event_time and state, one row per section and time."""

    states: DataFrame
    lines: DataFrame
    factors: Mapping[int, float]
    otherwise: Traffic
    fresh_minutes: int = 60
    within_m: float = NEAR_M

    def factor(self, rides: DataFrame, when: str, lat: str, lon: str, into: str) -> DataFrame:
        placed = nearest_section(rides, self.lines, lat, lon, self.within_m).drop("distance_m")
        reports = self.states.select("section_id", F.col("event_time").alias("_reported"), F.col("state").alias("_state"))
        # Rides near no section have no reports to look for and stay out of the time line, where they would be one key.
        near = asof_join(placed.where("section_id IS NOT NULL"), reports, ["section_id"], when, "_reported", ["_reported", "_state"])
        far = placed.where("section_id IS NULL")
        known = near.unionByName(far, allowMissingColumns=True)
        fresh = F.col("_reported") >= F.col(when) - F.expr(f"INTERVAL {self.fresh_minutes} MINUTE")
        live = F.lit(None).cast("double")
        for state, value in self.factors.items():
            live = F.when(F.col("_state") == state, F.lit(float(value))).otherwise(live)
        told = known.withColumn("_live", F.when(fresh, live)).drop("_reported", "_state", "section_id")
        return self.otherwise.factor(told, when, lat, lon, "_usual").select(*rides.columns, F.coalesce("_live", "_usual").alias(into))

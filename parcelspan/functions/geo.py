"""Distances, bearings and coordinate conversions as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from north, from 0 up to but not including 360."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def sweep_angle(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column) -> Column:
    """Angle of a point round a centre, on a plane scaled to the centre's latitude."""
    return F.atan2(lat - centre_lat, (lon - centre_lon) * F.cos(F.radians(centre_lat)))


def _utm_constants() -> dict[str, object]:
    """GRS80 ellipsoid terms of Krüger's series, to the third order in n."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    return {
        "radius": a / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "beta": (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480),
        "delta": (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15),
    }


UTM = _utm_constants()
UTM_SCALE, UTM_FALSE_EASTING, UTM31_MERIDIAN = 0.9996, 500_000.0, 3.0


def utm31_to_wgs84(easting: Column, northing: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of an ETRS89 / UTM zone 31N position, not rounded."""
    xi = northing / F.lit(UTM["radius"] * UTM_SCALE)
    eta = (easting - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM["radius"] * UTM_SCALE)
    xi1, eta1 = xi, eta
    for j, beta in enumerate(UTM["beta"], start=1):
        xi1 = xi1 - F.lit(beta) * F.sin(xi * F.lit(2.0 * j)) * F.cosh(eta * F.lit(2.0 * j))
        eta1 = eta1 - F.lit(beta) * F.cos(xi * F.lit(2.0 * j)) * F.sinh(eta * F.lit(2.0 * j))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, delta in enumerate(UTM["delta"], start=1):
        lat = lat + F.lit(delta) * F.sin(chi * F.lit(2.0 * j))
    lon = F.lit(math.radians(UTM31_MERIDIAN)) + F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lat), F.degrees(lon)


SECOND_PARTS = 10_000  # an angle is kept to a ten-thousandth of an arc second


def degrees_to_dms(value: Column) -> tuple[Column, Column, Column]:
    """Whole degrees, whole minutes and seconds; rounded once on the total so seconds stay under 60."""
    total = F.round(F.abs(value) * F.lit(3600.0 * SECOND_PARTS)).cast("bigint")
    per_minute, per_degree = 60 * SECOND_PARTS, 3600 * SECOND_PARTS
    return (
        F.floor(total / per_degree).cast("int"),
        (F.floor(total / per_minute) % 60).cast("int"),
        (total % per_minute) / F.lit(float(SECOND_PARTS)),
    )


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / F.lit(60.0) + seconds / F.lit(3600.0)
    return F.when(ref.isin("S", "W"), -value).otherwise(value)

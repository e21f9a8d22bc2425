"""Clock, calendar and promise arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "Europe/Madrid"
WINDOW_STEP_MIN = 30
BLACK_FRIDAY_MONTH = 11

# Congestion factor from this minute of a weekday until the next entry.
TRAFFIC_PROFILE = (
    (0, 1.00), (420, 1.20), (450, 1.50), (570, 1.25), (780, 1.35), (900, 1.25), (1050, 1.45), (1200, 1.15), (1320, 1.00),
)
SATURDAY_SHARE = 0.5


def clock_minutes(hhmm: Column) -> Column:
    """Minutes after midnight of an 'HH:MM' text."""
    part = F.split(hhmm, ":")
    return part[0].cast("int") * 60 + part[1].cast("int")


def minutes_clock(minutes: Column) -> Column:
    """'HH:MM' of minutes after midnight."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def span_minutes(period: Column) -> tuple[Column, Column]:
    """Both ends of an 'HH:MM-HH:MM' period, in minutes after midnight."""
    ends = F.split(period, "-")
    return clock_minutes(ends[0]), clock_minutes(ends[1])


def local_time(utc: Column) -> Column:
    """Wall-clock time of the depot of a UTC moment without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), utc)


def utc_time(local: Column) -> Column:
    """UTC moment without zone of a wall-clock time of the depot."""
    return F.convert_timezone(F.lit(LOCAL_TZ), F.lit("UTC"), local)


def minute_of_day(moment: Column) -> Column:
    return F.hour(moment) * 60 + F.minute(moment)


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 with their fraction, as a double, of a timestamp without zone."""
    return F.unix_micros(moment.cast("timestamp")) / F.lit(1_000_000.0)


def minutes_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(60_000_000.0)


def black_friday(day: Column) -> Column:
    """The fourth Friday of November in the year of the date."""
    november = F.make_date(F.year(day), F.lit(BLACK_FRIDAY_MONTH), F.lit(1))
    # weekday() counts Monday as 0 and Friday as 4
    return F.date_add(november, F.pmod(F.lit(4) - F.weekday(november), F.lit(7)) + 21)


def seasonal_multiplier(day: Column, peaks: dict[int, float]) -> Column:
    """The multiplier of the peak a date falls in, 1 outside. November's peak runs from the Monday
    before Black Friday to the Monday after it and may reach into December; others last their month."""
    friday = black_friday(day)
    in_week = day.between(F.date_sub(friday, 4), F.date_add(friday, 3))
    monthly = F.lit(1.0)
    for month, factor in peaks.items():
        if month != BLACK_FRIDAY_MONTH:
            monthly = F.when(F.month(day) == month, F.lit(float(factor))).otherwise(monthly)
    return (
        F.when(in_week, F.lit(float(peaks.get(BLACK_FRIDAY_MONTH, 1.0))))
        .when(F.month(day) == BLACK_FRIDAY_MONTH, F.lit(1.0))
        .otherwise(monthly)
    )


def opening_ranges(opens: Column, closes: Column, lunch: Column) -> Column:
    """Array of {start, end} minutes: the opening hours with an optional 'HH:MM-HH:MM' lunch taken out."""
    start, end = clock_minutes(opens), clock_minutes(closes)
    lunch_start, lunch_end = span_minutes(lunch)

    def piece(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("end"))

    whole = F.array(piece(start, end))
    return F.when(lunch.isNull() | (lunch == ""), whole).otherwise(
        F.array(piece(start, lunch_start), piece(lunch_end, end))
    )


def window_starts(ranges: Column, wave_start: Column, wave_end: Column, window_min: int) -> Column:
    """Array of half-hour starts of windows that lie inside both the open ranges and the wave."""

    def starts(r: Column) -> Column:
        earliest = F.greatest(r["start"], wave_start)
        first = F.ceil(earliest / WINDOW_STEP_MIN).cast("int") * WINDOW_STEP_MIN
        last = F.least(r["end"], wave_end) - window_min
        return F.when(first <= last, F.sequence(first, last, F.lit(WINDOW_STEP_MIN))).otherwise(
            F.array().cast("array<int>")
        )

    return F.flatten(F.transform(ranges, starts))


def promised_start(arrival_minute: Column, wave_start: Column, wave_end: Column, window_min: int) -> Column:
    """Start minute of the promise set from a planned arrival: the half hour at or before an hour
    ahead of it, kept inside the wave."""
    wanted = F.floor((arrival_minute - 60) / WINDOW_STEP_MIN).cast("int") * WINDOW_STEP_MIN
    return F.least(F.greatest(wanted, wave_start), wave_end - window_min)

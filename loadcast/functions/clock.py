"""Clock features of a timestamp, their inverse, and period arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length of each cycle.
CYCLES = {"month": 12, "day": 31, "hour": 24, "minute": 60}
# Cycles whose labels start at 1 (the others start at 0).
ONE_BASED = ("month", "day")
TIME_PARTS = ("year", "month", "day", "hour", "minute")
CYCLE_COLUMNS = [f"{name}_{fn}" for name in CYCLES for fn in ("sin", "cos")]


def part_of(name: str, time: Column) -> Column:
    extract = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "hour": F.hour,
        "minute": F.minute,
    }
    return extract[name](time)


def time_parts(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Year, month, day, hour and minute as integers; a part that exists already is kept."""
    time = F.col(time_col)
    return df.withColumns(
        {
            name: part_of(name, time).cast("int" if name == "year" else "short")
            for name in TIME_PARTS
            if name not in df.columns
        }
    )


def time_cycle(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Sine and cosine of each clock part plus the year.

    The phase is (part - 1) / length for all parts, also for the 0-based hour and minute.
    """
    time = F.col(time_col)
    new = {}
    for name, length in CYCLES.items():
        angle = (part_of(name, time) - 1) * F.lit(2 * math.pi / length)
        new[f"{name}_sin"] = F.sin(angle)
        new[f"{name}_cos"] = F.cos(angle)
    new["year"] = F.year(time)
    return df.withColumns(new)


def cycle_part(name: str) -> Column:
    """The clock part held in its sine and cosine; the nearest step, so float32 is safe."""
    length = CYCLES[name]
    turns = F.atan2(F.col(f"{name}_sin"), F.col(f"{name}_cos")) / F.lit(2 * math.pi)
    step = F.pmod(F.round(turns * length).cast("int"), F.lit(length)) + 1
    return step if name in ONE_BASED else F.pmod(step, F.lit(length))


def time_cycle_decode(df: DataFrame, out: str = "datetime", year_col: str = "year") -> DataFrame:
    """The timestamp held in the cycle columns and the year; an impossible date gives NULL."""
    year = F.col(year_col).cast("int")
    month, day, hour, minute = (cycle_part(n) for n in CYCLES)
    stamp = F.try_make_timestamp(year, month, day, hour, minute, F.lit(0))
    return df.withColumn(out, stamp)


def floor_hour(time: Column, lookback_days: int = 0) -> Column:
    """The full hour at or before ``time``, moved back by whole days."""
    return F.date_trunc("hour", time) - F.make_dt_interval(days=F.lit(lookback_days))


def period_format(time: Column) -> Column:
    """The ``yyyyMMddHHmm`` text used in period bounds."""
    return F.date_format(time, "yyyyMMddHHmm")


# A duration of days, hours, minutes and seconds, and the seconds of each.
DURATION = r"^P(?=\d|T\d)(?:(\d{1,6})D)?(?:T(?=\d)(?:(\d{1,6})H)?(?:(\d{1,6})M)?(?:(\d{1,6})S)?)?$"
UNIT_SECONDS = (86_400, 3_600, 60, 1)


def resolution_seconds(text: Column) -> Column:
    """Seconds in a duration such as ``PT15M``, ``PT1H30M``, ``P1D`` or ``PT30S``; NULL for anything else, also for
    months and years, which have no fixed length."""
    parts = [F.regexp_extract(text, DURATION, i + 1) for i in range(4)]
    seconds = [F.coalesce(F.nullif(p, F.lit("")).cast("long"), F.lit(0)) * s for p, s in zip(parts, UNIT_SECONDS)]
    return F.when(text.rlike(DURATION), seconds[0] + seconds[1] + seconds[2] + seconds[3])


def resolution_minutes(text: Column) -> Column:
    """Minutes in a duration of whole minutes; NULL for anything else."""
    seconds = resolution_seconds(text)
    return F.when(seconds % 60 == 0, F.call_function("div", seconds, F.lit(60))).cast("int")


def point_time(start: Column, position: Column, minutes: Column) -> Column:
    """Time of the 1-based point ``position`` in a period that starts at ``start``."""
    return start + F.make_dt_interval(mins=(position - 1) * minutes)


def point_time_seconds(start: Column, position: Column, seconds: Column) -> Column:
    """As ``point_time``, for steps given in seconds."""
    return start + F.make_dt_interval(secs=((position - 1) * seconds).cast("decimal(18,6)"))


def parse_period_start(text: Column) -> Column:
    """``2024-01-01T00:00Z`` and the same with seconds; NULL if it cannot be read."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmXXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
    )

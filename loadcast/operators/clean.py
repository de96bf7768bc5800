"""From raw readings to an hourly panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.columns import null_safe, require_columns
from loadcast.operators.positions import BUCKET_ROWS, SMALL_BYTES, dealt, in_buckets, per_bucket


def drop_bad_time(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Time as timestamp; rows whose time cannot be read are dropped."""
    column = F.col(time_col)
    if df.schema[time_col].dataType.simpleString() == "string":
        column = F.try_to_timestamp(column)
    return df.withColumn(time_col, column.cast("timestamp")).where(F.col(time_col).isNotNull())


def union_days(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of several days, series or landings appended by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_by(value: str, order: Sequence[str]) -> Column:
    """The value of the first row in the given order, as an aggregate.

    With one order column the aggregation runs on a hash table; a composite order needs a
    sort of each task's rows (but see ``hourly_first``), so give just the time where times are distinct.
    """
    if len(order) == 1:
        # Without any key the smallest value stands in, so that no value is lost.
        return F.coalesce(F.min_by(value, order[0]), F.min(value))
    return F.min_by(value, F.struct(*order))


def dedup_first(
    df: DataFrame,
    order: Sequence[str],
    value: str = "quantity_MW",
    time_col: str = "datetime",
    group: str = "country",
) -> DataFrame:
    """One row per (time, series): the first non-NULL value in the given order."""
    require_columns(df, [time_col, group, value, *order])
    return df.where(F.col(value).isNotNull()).groupBy(time_col, group).agg(first_by(value, order).alias(value))


def hourly_first(
    df: DataFrame,
    order: Sequence[str] = (),
    value: str = "quantity_MW",
    time_col: str = "datetime",
    group: str = "country",
) -> DataFrame:
    """One row per (hour, series): the first non-NULL value in the hour, at the hour's start. Rows without a
    time belong to no hour; ``unread_points`` counts those of documents.

    Raw readings may be given directly: with ``order`` breaking equal times, the result equals
    de-duplicating first, at the price of one aggregation instead of two.
    """
    hour = F.date_trunc("hour", time_col).alias(time_col)
    kinds = [df.schema[c].dataType.simpleString() for c in (time_col, *order)]
    if len(kinds) == 2 and kinds[0] == "timestamp" and kinds[1] in ("tinyint", "smallint", "int", "bigint"):
        first = F.min_by(value, _place_in_hour(time_col, order[0]))
    else:
        first = first_by(value, [time_col, *order])
    timed = df.where(F.col(value).isNotNull() & F.col(time_col).isNotNull())
    return timed.groupBy(hour, F.col(group)).agg(first.alias(value))


def _place_in_hour(time_col: str, key: str) -> Column:
    """(time, integer key) inside an hour as one number, NULL keys first. Unlike a struct it fits a hash table's row, so
    tasks need not sort. The factor is beyond the number of 64-bit keys."""
    since = F.unix_micros(time_col) - F.unix_micros(F.date_trunc("hour", time_col))
    number = F.coalesce(F.col(key).cast("decimal(20,0)"), F.expr("-9223372036854775809BD"))
    return since.cast("decimal(12,0)") * F.expr("100000000000000000000BD") + number


def hourly_grid(df: DataFrame, time_col: str = "datetime", group: str = "country") -> DataFrame:
    """The hourly panel with a row for every hour between a series' first and last, NULL in gaps.

    Full hours are laid out per day of each series, so one series is spread over many tasks. Every row given
    is among the result, also one off the full hour, without a time or without a series.
    """
    span = df.groupBy(group).agg(F.date_trunc("hour", F.min(time_col)).alias("_lo"), F.max(time_col).alias("_hi"))
    day = F.make_dt_interval(days=F.lit(1))
    hour = F.make_dt_interval(hours=F.lit(1))
    days = span.withColumn("_day", F.explode(F.sequence(F.date_trunc("day", "_lo"), F.col("_hi"), day)))
    hours = F.sequence(
        F.greatest("_day", "_lo"), F.least(F.col("_day") + day - hour, F.col("_hi")), hour
    )
    grid = days.select(F.explode(hours).alias(time_col), group)
    return null_safe(grid, df, [time_col, group], "full")


def ffill(
    df: DataFrame,
    value: str = "quantity_MW",
    time_col: str = "datetime",
    groups: Sequence[str] = ("country",),
    order: Sequence[str] = (),
    seconds: int | None = None,
    rows: int = BUCKET_ROWS,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """NULLs take the last earlier value of the series.

    Rows are dealt once by (series, bucket); each bucket is filled on its own and hands its last value on to later
    ones, by a table with one row per bucket. Buckets are those of ``time_idx``.
    """
    keys = ["_group", "_bucket"]
    placed = dealt(in_buckets(df, groups, time_col, order, seconds, rows, small_bytes), groups)
    # A single order column keeps the aggregation on a hash table.
    # NULLs come last, as among the rows of a bucket.
    ranks = [x for i, c in enumerate((time_col, *order)) for x in (F.col(c).isNull().alias(f"null{i}"), F.col(c).alias(f"value{i}"))]
    position = F.struct(*ranks) if order else F.col(time_col)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), position))
    earlier = (
        Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_bucket(placed, {"_last": last}).select(
        *keys, F.last("_last", ignorenulls=True).over(earlier).alias("_carry")
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(c).asc_nulls_last() for c in (time_col, *order)])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry")
    return placed.join(carry, keys).withColumn(value, filled).drop(*keys, "_carry")

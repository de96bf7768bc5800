"""Chronological splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.operators.positions import at_or_before, before, row_boundaries, with_buckets, with_positions

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SplitCuts:
    """The last training row and the last validation row of a chronological split."""

    time_col: str
    train_end: dict | None
    val_end: dict | None

    def label(self) -> Column:
        """The split name of a row, NULL without a time; a plain expression, so applying it moves no data."""
        return (
            F.when(F.col(self.time_col).isNull(), F.lit(None).cast("string"))
            .when(at_or_before(self.train_end, self.time_col), SPLITS[0])
            .when(at_or_before(self.val_end, self.time_col), SPLITS[1])
            .otherwise(SPLITS[2])
        )


    def bounds(self, keep: Sequence[str]) -> Column:
        """Time bounds that hold for every row of the named splits; simple enough for a scan."""
        time = F.col(self.time_col)
        after = None if "train" in keep else self.train_end if "val" in keep else self.val_end
        until = None if "test" in keep else self.val_end if "val" in keep else self.train_end
        test = F.lit(True)
        if after:
            test = test & (time >= F.timestamp_micros(F.lit(after["us"])))
        if until:
            test = test & (time <= F.timestamp_micros(F.lit(until["us"])))
        return test


def fit_split(
    df: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    time_col: str = "datetime",
    order: Sequence[str] = ("country",),
) -> SplitCuts:
    """Cut points of the split by row share over the whole table in (time, ``order``) order.

    The first ``int(n * train)`` rows are for training and the next ``int(n * val)`` for
    validation. Only counts are shuffled and one row per cut reaches the driver.
    """
    if not math.isclose(train + val + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("train, val and test must sum to 1")
    total = F.col("_total").cast("double")
    first = F.floor(total * F.lit(float(train)))
    second = first + F.floor(total * F.lit(float(val)))
    ends = row_boundaries(df, [first, second], list(order), time_col)
    return SplitCuts(time_col, ends[0], ends[1])


def split_fraction(df: DataFrame, cuts: SplitCuts) -> DataFrame:
    """Adds column ``split``."""
    return df.withColumn("split", cuts.label())


def split_calendar(
    df: DataFrame, val_start: str, test_start: str, time_col: str = "datetime"
) -> DataFrame:
    """Split by date: before ``val_start`` training, from ``test_start`` on test."""
    time = F.col(time_col)
    label = (
        F.when(time < F.lit(val_start).cast("timestamp"), SPLITS[0])
        .when(time < F.lit(test_start).cast("timestamp"), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return df.withColumn("split", label)


def split_keep(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows of the named splits."""
    return df.where(F.col("split").isin(list(keep)))


def split_rows(df: DataFrame, cuts: SplitCuts, keep: Sequence[str]) -> DataFrame:
    """The named splits with their ``split`` column; times outside them are not scanned."""
    return split_keep(split_fraction(df.where(cuts.bounds(keep)), cuts), keep)


def head_fraction(
    df: DataFrame, size: float, time_col: str = "datetime", order: Sequence[str] = ()
) -> DataFrame:
    """The first ``int(n * size)`` rows in the order (time, ``order``); rows without a time do not count."""
    rank = F.floor(F.col("_total").cast("double") * F.lit(float(size)))
    return _head(df, rank, time_col, order)


def max_samples(
    df: DataFrame, n: int | None, time_col: str = "datetime", order: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` rows in the order (time, ``order``); all of them for no or a non-positive ``n``."""
    if not n or n <= 0:
        return df
    return _head(df, F.least(F.lit(int(n)), F.col("_total")), time_col, order)


def _head(df: DataFrame, rank: Column, time_col: str, order: Sequence[str]) -> DataFrame:
    """Exactly as many rows as ``rank`` says. If several share the last place, which of them stay is decided
    by a hash of all their columns, the same under any partitioning; they are ranked in buckets of that hash."""
    last = row_boundaries(df, [rank], list(order), time_col)[0]
    if last is None:
        return df.where(F.lit(False))
    until, below = at_or_before(last, time_col), before(last, time_col)
    tied = until & ~below
    timed = df.where(F.col(time_col).isNotNull())
    wanted, sure, ties = (
        timed.agg(F.count(F.lit(1)).alias("_total"), F.count_if(below).alias("_sure"), F.count_if(tied).alias("_ties"))
        .select(rank.cast("long"), "_sure", "_ties")
        .first()
    )
    if sure + ties == wanted:
        return df.where(until)
    hashed = timed.where(tied).withColumn("_hash", F.xxhash64(*df.columns))
    placed = with_buckets(hashed, (), None, ["_hash"])
    ranked = with_positions(placed, "_bucket", [F.col("_hash")], (), "_nth")
    return df.where(below).unionByName(ranked.where(F.col("_nth") < wanted - sure).select(*df.columns))

"""Standard and min-max scaling with fitted state, globally or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.columns import GLOBAL_GROUP, NOISE_SUFFIX, as_double, series_label, unique
from loadcast.operators.bounds import broadcast_if_bounded

METHODS = ("standard", "minmax")


def fit_scaler(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """State ``(col, group, mean, std, min, max)``: one row per column and group, one pass.

    ``std`` is the population deviation. Fit on training rows only.
    """
    stats = F.array(
        *[
            F.struct(
                F.lit(c).alias("col"),
                F.avg(as_double(df, c)).alias("mean"),
                F.stddev_pop(as_double(df, c)).alias("std"),
                F.min(as_double(df, c)).alias("min"),
                F.max(as_double(df, c)).alias("max"),
            )
            for c in columns
        ]
    )
    keyed = df.withColumn("group", series_label(groups)) if groups else df.withColumn("group", F.lit(GLOBAL_GROUP))
    rows = keyed.groupBy("group").agg(stats.alias("_stats"))
    return rows.select("group", F.inline("_stats")).select("col", "group", "mean", "std", "min", "max")


def scaler_state(state: DataFrame, method: str) -> DataFrame:
    """The offset and scale each method subtracts and divides by; no spread means scale 1."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    offset, spread = ("mean", F.col("std")) if method == "standard" else ("min", F.col("max") - F.col("min"))
    scale = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return state.select("col", "group", F.col(offset).alias("offset"), scale.alias("scale"))


def base_column(name: str, bases: Sequence[str]) -> str | None:
    """The scaled column a derived column belongs to: itself, or the longest ``base_`` prefix."""
    fits = [b for b in bases if name == b or name.startswith(b + "_")]
    return max(fits, key=len, default=None)


def _apply(df: DataFrame, state: DataFrame, method: str, pairs: dict[str, str], groups: Sequence[str], formula) -> DataFrame:
    params = scaler_state(state, method).where(F.col("col").isin(unique(pairs.values())))
    if not groups:
        # One row per scaled column: as wide as the schema, whatever the data size.
        fitted = {r["col"]: r for r in params.collect()}
        offset = {b: F.lit(fitted[b]["offset"]) for b in fitted}
        scale = {b: F.lit(fitted[b]["scale"]) for b in fitted}
        return df.withColumns({c: formula(df, c, offset[b], scale[b]) for c, b in pairs.items()})
    bases = unique(pairs.values())
    wide = params.groupBy(F.col("group").alias("_group")).agg(
        *[F.max(F.when(F.col("col") == b, F.col("offset"))).alias(f"_o{i}") for i, b in enumerate(bases)],
        *[F.max(F.when(F.col("col") == b, F.col("scale"))).alias(f"_s{i}") for i, b in enumerate(bases)],
    )
    joined = df.withColumn("_group", series_label(groups)).join(broadcast_if_bounded(wide), "_group", "left")
    new = {
        c: formula(df, c, F.col(f"_o{bases.index(b)}"), F.col(f"_s{bases.index(b)}")) for c, b in pairs.items()
    }
    return joined.withColumns(new).select(*df.columns)


def scale_transform(
    df: DataFrame,
    state: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Columns as (x - offset) / scale; a ``_noise`` column uses the state of its base."""
    pairs = {c: c.removesuffix(NOISE_SUFFIX) for c in columns}
    return _apply(df, state, method, pairs, groups, lambda d, c, o, s: (as_double(d, c) - o) / s)


def scale_inverse(
    df: DataFrame,
    state: DataFrame,
    bases: Sequence[str],
    method: str = "standard",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Undo the scaling of each base column and of every column derived from it."""
    pairs = {c: b for c in df.columns if (b := base_column(c, bases))}
    return _apply(df, state, method, pairs, groups, lambda d, c, o, s: as_double(d, c) * s + o)


def inverse_arrays(
    df: DataFrame,
    state: DataFrame,
    base: str,
    arrays: Sequence[str],
    method: str = "standard",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Undo the scaling of ``base`` in every element of the given array columns."""

    def formula(_: DataFrame, c: str, offset: Column, scale: Column) -> Column:
        return F.transform(F.col(c).cast("array<double>"), lambda v: v * scale + offset)

    return _apply(df, state, method, {a: base for a in arrays}, groups, formula)


def column_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample standard deviation of each column, one row."""
    return df.agg(*[F.stddev_samp(as_double(df, c)).alias(c) for c in columns])

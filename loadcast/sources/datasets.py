"""Model datasets in Parquet: flat matrices, sequences and panels, each with its metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.functions.clock import TIME_PARTS
from loadcast.functions.columns import (
    feature_target_lists,
    series_key,
    numeric_columns,
    quoted,
    require_columns,
    unique,
)
from loadcast.operators.windows import flat_arrays, panel_windows, to_steps

ROWS_PER_FILE = 200_000
_LISTS = "feature_cols array<string>, target_cols array<string>"
META = {
    "flat": f"split string, kind string, basename string, path string, rows bigint, x_dim int, y_dim int, key_cols array<string>, {_LISTS}",
    "sequence": f"split string, kind string, basename string, path string, rows bigint, x_dim int, y_dim int, seq_len int, lead int, {_LISTS}",
    "panel": (
        "split string, kind string, basename string, path string, rows bigint, groups bigint, min_time string, max_time string, "
        f"lag int, lead int, x_dim int, y_dim int, {_LISTS}, group_cols array<string>, time_col string, "
        "time_part_cols array<string>, continuous_cols array<string>, dtypes map<string,string>, generated_at string, "
        "tft_schema struct<static_categoricals: array<string>, time_varying_known_categoricals: array<string>, "
        "time_varying_known_reals: array<string>, time_varying_unknown_categoricals: array<string>, "
        "time_varying_unknown_reals: array<string>, target: string, group_ids: array<string>, "
        "max_encoder_length: int, max_prediction_length: int>"
    ),
}


def texts(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def write_splits(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per split, written where the rows are; no gathering into one task."""
    (
        df.write.mode("errorifexists")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("split")
        .parquet(path)
    )


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the other folders are not read."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def _write_meta(meta: DataFrame, path: str) -> DataFrame:
    # One row per split.
    meta.coalesce(1).write.mode("errorifexists").json(f"{path}.meta")
    return meta


def read_meta(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The metadata written beside a dataset: one row per split."""
    return spark.read.schema(META[kind]).json(f"{path}.meta")


def _split_meta(spark: SparkSession, path: str, split: str, kind: str) -> T.Row:
    row = read_meta(spark, path, kind).where(F.col("split") == split).first()
    if row is None:
        raise ValueError(f"no split {split!r} in {path}")
    return row


def _with_literals(counts: DataFrame, kind: str, path: str, values: dict[str, Column]) -> DataFrame:
    base = path.rstrip("/").rsplit("/", 1)[-1]
    named = {
        "kind": F.lit(kind),
        "path": F.lit(path),
        "basename": F.concat(F.lit(f"{base}_"), F.col("split")),
        **values,
    }
    return counts.withColumns(named).to(T.StructType.fromDDL(META[kind]))


def group_profile(df: DataFrame, groups: Sequence[str], time_col: str = "datetime", by: Sequence[str] = ()) -> DataFrame:
    """Rows, number of series, first and last time, overall or per ``by``.

    Rows are counted per series first, so no distinct set grows with the data.
    """
    per_series = df.groupBy(*by, series_key(groups).alias("_group")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi")
    )
    return per_series.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("_group").alias("groups"),
        F.min("_lo").alias("min_time"),
        F.max("_hi").alias("max_time"),
    )


def write_flat_split(
    df: DataFrame, path: str, features: Sequence[str], targets: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Flat matrix with a ``split`` column: keys, features, targets; returns the metadata."""
    names, wanted = feature_target_lists(df, features, targets)
    kept_keys = [k for k in unique(keys) if k not in {*names, *wanted, "split"}]
    write_splits(df.select("split", *kept_keys, *names, *wanted), path)
    counts = df.sparkSession.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    values = {
        "x_dim": F.lit(len(names)),
        "y_dim": F.lit(len(wanted)),
        "key_cols": texts(kept_keys),
        "feature_cols": texts(names),
        "target_cols": texts(wanted),
    }
    return _write_meta(_with_literals(counts, "flat", path, values), path)


def read_flat_split(spark: SparkSession, path: str, split: str, arrays: bool = False) -> DataFrame:
    """Key columns, then features and targets as float in the order of the metadata.

    With ``arrays`` the features and targets come as ``X`` and ``Y``.
    """
    meta = _split_meta(spark, path, split, "flat")
    values = [*meta["feature_cols"], *meta["target_cols"]]
    rows = read_split(spark, path, split).selectExpr(
        *map(quoted, meta["key_cols"]), *[f"float({quoted(c)}) AS {quoted(c)}" for c in values]
    )
    return flat_arrays(rows, meta["feature_cols"], meta["target_cols"]) if arrays else rows


def write_seq_split(
    df: DataFrame, path: str, features: Sequence[str], targets: Sequence[str], seq_len: int, lead: int
) -> DataFrame:
    """Sequences with a ``split`` column; ``X`` and ``Y`` stored as float; returns the metadata."""
    require_columns(df, ["split", "X", "Y", "country_id"])
    stored = df.withColumns({"X": F.col("X").cast("array<float>"), "Y": F.col("Y").cast("array<float>")})
    write_splits(stored, path)
    counts = df.sparkSession.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    values = {
        "x_dim": F.lit(len(features)),
        "y_dim": F.lit(len(targets)),
        "seq_len": F.lit(seq_len),
        "lead": F.lit(lead),
        "feature_cols": texts(features),
        "target_cols": texts(targets),
    }
    return _write_meta(_with_literals(counts, "sequence", path, values), path)


def read_seq_split(spark: SparkSession, path: str, split: str, steps: bool = True) -> DataFrame:
    """Sequences; with ``steps`` as (seq_len, x_dim) and (lead, y_dim) nested arrays."""
    rows = read_split(spark, path, split)
    if not steps:
        return rows
    meta = _split_meta(spark, path, split, "sequence")
    return rows.withColumns(
        {"X": to_steps("X", meta["seq_len"], meta["x_dim"]), "Y": to_steps("Y", meta["lead"], meta["y_dim"])}
    )


def known_reals(df: DataFrame, also: Sequence[str] = ()) -> list[str]:
    """Reals known ahead of time: position, clock parts, and what the caller names."""
    return unique(["time_idx", *[c for c in df.columns if c in TIME_PARTS], *also])


def observed_reals(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], groups: Sequence[str], known: Sequence[str]
) -> list[str]:
    """Numeric features that are measured and so not known ahead; a noisy target is one."""
    numeric = set(numeric_columns(df))
    return [c for c in unique(features) if c in numeric and c not in {*targets, *groups, *known}]


def write_panel_split(
    df: DataFrame,
    path: str,
    features: Sequence[str],
    targets: Sequence[str],
    lag: int,
    lead: int,
    groups: Sequence[str] = ("country",),
    time_col: str = "datetime",
    known: Sequence[str] = (),
) -> DataFrame:
    """Panel frame with a ``split`` column; returns the metadata.

    Position, clock parts and the features named in ``known`` are known ahead; all other numeric features count
    as observed, as the targets are.
    """
    ahead = known_reals(df, known)
    require_columns(df, ["split", "_group_id", "time_idx", time_col, *groups])
    write_splits(df, path)
    written = df.sparkSession.read.parquet(path)
    counts = group_profile(written, groups, time_col, ["split"])
    iso = "yyyy-MM-dd'T'HH:mm:ssxxx"
    columns = [c for c in df.columns if c != "split"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtypes = F.create_map(*[F.lit(v) for c in columns for v in (c, kinds[c])])
    schema = {
        "static_categoricals": texts(groups),
        "time_varying_known_categoricals": texts([]),
        "time_varying_known_reals": texts(ahead),
        "time_varying_unknown_categoricals": texts([]),
        "time_varying_unknown_reals": texts([*targets, *observed_reals(df, features, targets, groups, ahead)]),
        "target": F.lit(targets[0]),
        "group_ids": texts(groups),
        "max_encoder_length": F.lit(lag),
        "max_prediction_length": F.lit(lead),
    }
    values = {
        "min_time": F.date_format("min_time", iso),
        "max_time": F.date_format("max_time", iso),
        "lag": F.lit(lag),
        "lead": F.lit(lead),
        "x_dim": F.lit(len(features)),
        "y_dim": F.lit(len(targets)),
        "feature_cols": texts(features),
        "target_cols": texts(targets),
        "group_cols": texts(groups),
        "time_col": F.lit(time_col),
        "time_part_cols": texts([c for c in df.columns if c in TIME_PARTS]),
        "continuous_cols": texts([c for c in numeric_columns(df) if c != "time_idx"]),
        "dtypes": dtypes,
        "generated_at": F.date_format(F.current_timestamp(), iso),
        "tft_schema": F.struct(*[v.alias(k) for k, v in schema.items()]),
    }
    return _write_meta(_with_literals(counts, "panel", path, values), path)


def read_panel_split(
    spark: SparkSession, path: str, split: str, windows: bool = False, known: Sequence[str] | None = None
) -> DataFrame:
    """The panel as written, or its fixed encoder/decoder windows. Observed features reach the encoder only."""
    rows = read_split(spark, path, split)
    if not windows:
        return rows
    meta = _split_meta(spark, path, split, "panel")
    reals = known or meta["tft_schema"]["time_varying_known_reals"]
    schema = meta["tft_schema"]
    observed = [c for c in schema["time_varying_unknown_reals"] if c not in {*meta["target_cols"], *reals}]
    return panel_windows(
        rows, schema["target"], meta["lag"], meta["lead"], reals, meta["group_cols"], meta["time_col"], observed=observed
    )

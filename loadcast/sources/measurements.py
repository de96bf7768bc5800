"""Measurement tables and fitted state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.functions.columns import require_columns

def as_measurements(df: DataFrame, time: str, series: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Any table as ``(datetime, country, quantity_MW, keep…)``; NaN becomes NULL."""
    require_columns(df, [time, series, value, *keep])
    reading = F.col(value).cast("double")
    return df.select(
        F.col(time).cast("timestamp").alias("datetime"),
        F.col(series).cast("string").alias("country"),
        F.when(~F.isnan(reading), reading).alias("quantity_MW"),
        *keep,
    )


def filter_countries(df: DataFrame, countries: Sequence[str] | None, column: str = "country") -> DataFrame:
    """Rows of the listed series; no list means all rows."""
    return df.where(F.col(column).isin(list(countries))) if countries else df


def scan_measurements(spark: SparkSession, path: str, countries: Sequence[str] | None = None) -> DataFrame:
    """The base table in Parquet. The series filter and the columns used reach the scan."""
    return filter_countries(as_measurements(spark.read.parquet(path), "datetime", "country", "quantity_MW"), countries)


def write_base(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "zstd"
) -> str:
    """The table in Parquet. Partition columns let later reads skip whole folders.

    Rows are first brought together by partition value, so that not every task writes a file for every value;
    adaptive execution splits a value with many rows again.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    writer = rows.write.mode("errorifexists").option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def save_state(state: DataFrame, path: str) -> str:
    """A fitted dictionary or scaler state as Parquet."""
    state.write.mode("errorifexists").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_forecast_csv(df: DataFrame, path: str) -> str:
    """A forecast table (scalar columns) as CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def read_forecast_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)

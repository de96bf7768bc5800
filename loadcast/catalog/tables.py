"""Input roles, result tidying, and the SQL fragments the checks are built from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.operators.clean import hourly_first, union_days
from loadcast.operators.windows import sequence_windows
from loadcast.plans.evaluate import naive_forecast
from loadcast.session import use_utc
from loadcast.sources.measurements import as_measurements

LAG, SEQ, LEAD = 24, 12, 6
VALUE = "quantity_MW"
SHARES = (0.8, 0.15, 0.05)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular readings: event type as series."""
    return as_measurements(table(spark, sf, "events"), "ts", "event_type", "value", ["event_id"])


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly panel of the readings."""
    return hourly_first(raw(spark, sf), ["event_id"])


def order_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings over several years: order priority as series."""
    orders = table(spark, sf, "orders")
    return as_measurements(orders, "o_orderdate", "o_orderpriority", "o_totalprice", ["o_orderkey"])


def both(spark: SparkSession, sf: str) -> DataFrame:
    """The readings of both tables, so that all clock parts and many labels occur."""
    rows = union_days([raw(spark, sf), order_readings(spark, sf)])
    return rows.withColumn("key", F.coalesce("event_id", "o_orderkey")).drop("event_id", "o_orderkey")


def naive(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts that repeat the value of a day before."""
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], LAG, LEAD)
    return naive_forecast(windows, LAG, LEAD)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, floats as doubles, times without zone: comparable anywhere."""

    def column(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def unpack(df: DataFrame, array: str, prefix: str, n: int) -> DataFrame:
    """The first ``n`` entries of an array as columns ``prefix1`` … in place of the array."""
    cells = [F.get(F.col(array), F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(n)]
    return df.select(*[c for c in df.columns if c != array], *cells)


class Registry(dict):
    """``name -> (query, sql)``; the query's result is tidied."""

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(build: Callable[[SparkSession, str], DataFrame]):
            self[name] = (lambda spark, sf: tidy(build(use_utc(spark), sf)), sql)
            return build

        return register


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def columns(exprs: Sequence[str]) -> str:
    return ", ".join(exprs)


RAW = "raw AS (SELECT ts AS datetime, event_type AS country, value AS quantity_MW, event_id FROM events)"
ORDERS = (
    "orders_raw AS (SELECT o_orderdate AS datetime, o_orderpriority AS country, "
    "o_totalprice AS quantity_MW, o_orderkey FROM orders)"
)
BOTH = (
    f"{RAW}, {ORDERS}, both_raw AS (SELECT datetime, country, quantity_MW, event_id AS key FROM raw "
    "UNION ALL SELECT datetime, country, quantity_MW, o_orderkey FROM orders_raw)"
)
HOURLY = (
    f"{RAW}, hourly AS (SELECT date_trunc('hour', raw.datetime) AS datetime, country, "
    "first(quantity_MW ORDER BY raw.datetime, event_id) AS quantity_MW FROM raw "
    "WHERE quantity_MW IS NOT NULL GROUP BY 1, 2)"
)
IDX = (
    f"{HOURLY}, idx AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY datetime) - 1 AS time_idx, "
    "count(*) OVER (PARTITION BY country) AS n FROM hourly)"
)
# The global chronological split of the hourly panel, and positions inside each split.
SPLIT = (
    f"{HOURLY}, numbered AS (SELECT *, row_number() OVER (ORDER BY datetime, country) AS rn, count(*) OVER () AS total FROM hourly), "
    "parts AS (SELECT datetime, country, quantity_MW, CASE WHEN rn <= floor(total * 0.8::DOUBLE) THEN 'train' "
    "WHEN rn <= floor(total * 0.8::DOUBLE) + floor(total * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM numbered), "
    "sidx AS (SELECT *, row_number() OVER (PARTITION BY split, country ORDER BY datetime) - 1 AS time_idx, "
    "count(*) OVER (PARTITION BY split, country) AS n FROM parts)"
)
SCALER = (
    "scaler AS (SELECT avg(quantity_MW) AS m, stddev_pop(quantity_MW) AS s FROM parts WHERE split = 'train')"
)
def frame_sql(name: str, first: str, last: str, by: str = "country", value: str = "quantity_MW") -> str:
    return f"list({value}) OVER (PARTITION BY {by} ORDER BY datetime ROWS BETWEEN {first} AND {last}) AS {name}"


def windows_sql(length: int, source: str = "idx", by: str = "country") -> str:
    """Full windows: ``xs`` the last ``length`` values, ``ys`` the next LEAD values."""
    xs = frame_sql("xs", f"{length - 1} PRECEDING", "CURRENT ROW", by)
    ys = frame_sql("ys", "1 FOLLOWING", f"{LEAD} FOLLOWING", by)
    return f"wins AS (SELECT * FROM (SELECT *, {xs}, {ys} FROM {source}) WHERE len(xs) = {length} AND len(ys) = {LEAD})"


# Day-before forecasts, one row per window and step.
NAIVE = (
    f"{IDX}, {windows_sql(LAG)}, fc AS (SELECT country, datetime, time_idx, quantity_MW AS last_value, "
    f"unnest(range(1, {LEAD + 1})) AS lead, unnest(ys) AS y_true, unnest(xs[1:{LEAD}]) AS y_pred FROM wins)"
)
METRICS = columns(
    [
        "count(*) AS n",
        r("avg(abs(y_pred - y_true))", "mae"),
        r("avg((y_pred - y_true) ** 2)", "mse"),
        r("sqrt(avg((y_pred - y_true) ** 2))", "rmse"),
        r("corr(y_true, y_pred)", "correlacao_pearson"),
        r("1 - avg((y_pred - y_true) ** 2) / var_pop(y_true)", "r2"),
    ]
)


# Rows of a grouping set that does not use a column carry a name instead of NULL.
OVERALL = {"lead": 0, "country": "all"}
LEVEL = "coalesce(lead, 0)::INTEGER AS lead, coalesce(country, 'all') AS country"


def lag_sql(prefix: str, steps: Sequence[int], source: str = "quantity_MW", over: str = "w") -> list[str]:
    return [f"lag({source}, {k}) OVER {over} AS {prefix}{k}" for k in steps]


def lead_sql(prefix: str, steps: Sequence[int], source: str = "quantity_MW", over: str = "w") -> list[str]:
    return [f"lead({source}, {k}) OVER {over} AS {prefix}{k}" for k in steps]


def hash_sql(text: str, part: int = 0) -> str:
    """The 48-bit hash of a text, as the seeded operators use it."""
    return f"('0x' || substr(md5({text}), {1 + 12 * part}, 12))::BIGINT"


EVENT_KEY = "event_id::VARCHAR || '|42'"


def gauss_sql(text: str) -> str:
    u1 = f"(({hash_sql(text)} + 0.5::DOUBLE) / 281474976710656::DOUBLE)"
    u2 = f"(({hash_sql(text, 1)} + 0.5::DOUBLE) / 281474976710656::DOUBLE)"
    return f"(sqrt(-2 * ln({u1})) * cos({u2} * 2 * pi()))"

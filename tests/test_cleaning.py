import datetime as dt

import pytest
from helpers import T0, as_set, at, hours
from pyspark.sql import functions as F

from loadcast.functions.columns import (
    feature_target_lists,
    noise_rename,
    numeric_only,
    require_columns,
    select_columns,
)
from loadcast.operators.clean import (
    dedup_first,
    drop_bad_time,
    ffill,
    hourly_first,
    hourly_grid,
    union_days,
)
from loadcast.sources.measurements import as_measurements, filter_countries


def test_first_value_by_order_not_by_arrival(spark):
    rows = [
        ("2024-01-01 00:00:00", "A", None, 1),
        ("2024-01-01 00:00:00", "A", 5.0, 3),
        ("2024-01-01 00:00:00", "A", 7.0, 2),
        ("2024-01-01 01:00:00", "A", None, 4),
    ]
    for parts in (1, 7):
        out = dedup_first(at(spark, rows).repartition(parts), ["key"])
        assert as_set(out) == {(T0, "A", 7.0)}


def test_hourly_first_and_gaps(spark):
    rows = [
        ("2024-01-01 00:15:00", "A", 2.0, 1),
        ("2024-01-01 00:00:00", "A", 1.0, 2),
        ("2024-01-01 03:00:00", "A", 4.0, 3),
        ("2024-01-01 00:30:00", "B", 9.0, 4),
    ]
    panel = hourly_first(at(spark, rows), ["key"])
    three = T0 + dt.timedelta(hours=3)
    assert as_set(panel) == {(T0, "A", 1.0), (three, "A", 4.0), (T0, "B", 9.0)}
    grid = hourly_grid(panel)
    assert {(r.datetime.hour, r.country, r.quantity_MW) for r in grid.collect()} == {
        (0, "A", 1.0),
        (1, "A", None),
        (2, "A", None),
        (3, "A", 4.0),
        (0, "B", 9.0),
    }
    filled = {(r.datetime.hour, r.country): r.quantity_MW for r in ffill(grid).collect()}
    assert filled == {(0, "A"): 1.0, (1, "A"): 1.0, (2, "A"): 1.0, (3, "A"): 4.0, (0, "B"): 9.0}


def test_hourly_first_equals_dedup_first_then_hour(spark):
    rows = [
        (f"2024-01-01 {h:02d}:{m:02d}:00", c, float(h * 60 + m + k), 100 * k + m)
        for c in "AB"
        for h in range(3)
        for m in (0, 7, 7, 31)
        for k in (2, 1)
    ]
    raw = at(spark, rows)
    assert as_set(hourly_first(raw, ["key"])) == as_set(hourly_first(dedup_first(raw, ["key"])))


@pytest.mark.parametrize("seconds", [3600, 86_400, 7 * 86_400])
def test_ffill_carries_over_buckets(spark, seconds):
    values = [None, 1.0] + [None] * 60 + [2.0] + [None] * 40
    df = hours(spark, {"A": values, "B": [None] * 5})
    out = {(r.country, r.datetime): r.quantity_MW for r in ffill(df, seconds=seconds).collect()}
    last = None
    for i, v in enumerate(values):
        last = v if v is not None else last
        assert out["A", T0 + dt.timedelta(hours=i)] == last
    assert all(v is None for (c, _), v in out.items() if c == "B")


def test_bad_time_is_dropped(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("no", 2), (None, 3)], "datetime string, k int")
    assert [r.k for r in drop_bad_time(df).collect()] == [1]


def test_nan_becomes_null_and_filter(spark):
    df = spark.createDataFrame([(T0, "A", float("nan")), (T0, "B", 1.0)], "t timestamp, c string, v double")
    rows = as_measurements(df, "t", "c", "v")
    assert as_set(rows) == {(T0, "A", None), (T0, "B", 1.0)}
    assert filter_countries(rows, ["B"]).count() == 1
    assert filter_countries(rows, []).count() == 2


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert as_set(union_days([a, b])) == {(1, 2), (3, None)}


def test_column_lists(spark):
    df = spark.createDataFrame([(1, "a", True, 2.0)], "n int, s string, b boolean, t double")
    assert select_columns(df, ["t", "gone", "n", "t"], ["n"]).columns == ["t", "n"]
    assert numeric_only(df, ["s", "b", "n"]) == ["b", "n"]
    with pytest.raises(ValueError):
        numeric_only(df, ["s"])
    assert feature_target_lists(df, ["n", "t", "n", "s"], ["t"]) == (["n"], ["t"])
    with pytest.raises(ValueError):
        require_columns(df, ["n", "z"])


def test_noise_column_takes_the_name_and_place(spark):
    df = spark.createDataFrame([(1.0, 2, 1.5)], "v double, k int, v_noise double")
    out = noise_rename(df)
    assert out.columns == ["v", "k"] and out.first().v == 1.5
    assert noise_rename(df.select("k", F.col("v_noise"))).columns == ["k", "v"]


def test_first_of_an_hour_by_time_and_integer_key(spark):
    """As a plain sort by (time, key): extreme, negative and missing keys, any zone, and no sort in the plan."""
    keys = [0, -1, 7, -(1 << 63), (1 << 63) - 1, None]
    rows = [(s, t, k, float(100 * t + i)) for s in ("a", None) for t in (-5, 0, 1, 1799, 1800, 3599, 3600, 253_402_300_799) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "country string, t long, key long, quantity_MW double").select("*", F.timestamp_seconds("t").alias("datetime"))
    one = df.where("t != 1800 or key is not null").where("t != 0 or key > 0")
    for zone in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for kind in ("bigint", "string"):
                typed = one.withColumn("key", F.col("key").cast(kind)) if kind == "bigint" else one.withColumn("key", F.lpad((F.col("key").cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0"))
                got = hourly_first(typed.repartition(3), ["key"])
                hours = {(r.country, r.datetime): r.quantity_MW for r in got.collect()}
                if kind == "bigint":
                    fast = hours
                    plan = got._jdf.queryExecution().executedPlan().toString()
                    assert "HashAggregate" in plan and "SortAggregate" not in plan
            assert fast == hours and len(hours) == got.count()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")

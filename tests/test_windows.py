import random

import pytest
from helpers import T0, as_set, hours, noise_series
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadcast.operators.clean import ffill
from loadcast.operators.positions import time_idx, with_buckets
from loadcast.operators.windows import (
    chunked,
    drop_incomplete,
    flat_arrays,
    flat_matrix,
    flat_windows,
    lag_lead,
    last_step_features,
    min_length_groups,
    panel_frame,
    panel_windows,
    sequence_windows,
    time_lag_lead,
    to_flat,
    to_steps,
    window_country_id,
)

V = "quantity_MW"
SERIES = {"A": noise_series(157, 1), "B": noise_series(31, 2), "C": noise_series(9, 3), "D": [None, 1, 2, None] * 9}


def plain(df, lags, leads):
    w = Window.partitionBy("country").orderBy("datetime")
    return df.select(
        "datetime",
        "country",
        V,
        (F.row_number().over(w) - 1).cast("bigint").alias("time_idx"),
        *[F.lag(V, k).over(w).alias(f"{V}_lag{k}") for k in range(1, lags + 1)],
        *[F.lead(V, k).over(w).alias(f"{V}_lead{k}") for k in range(1, leads + 1)],
    )


@pytest.mark.parametrize("chunk", [3, 7, 50, None])
@pytest.mark.parametrize("parts", [1, 7])
def test_chunks_equal_plain_windows(spark, chunk, parts):
    df = hours(spark, SERIES).repartition(parts)
    out = lag_lead(df, [V], [V], range(1, 13), range(1, 6), chunk_rows=chunk)
    expected = plain(df, 12, 5)
    assert as_set(out.select(expected.columns)) == as_set(expected)


@pytest.mark.parametrize("seconds", [3600, 5 * 3600, 86_400, 10**9])
def test_positions_equal_row_number(spark, seconds):
    df = hours(spark, SERIES)
    w = Window.partitionBy("country").orderBy("datetime")
    expected = df.withColumn("time_idx", (F.row_number().over(w) - 1).cast("bigint"))
    assert as_set(time_idx(df, seconds=seconds)) == as_set(expected)


def test_positions_of_equal_times_null_times_and_old_dates(spark):
    rows = [(None, "A", 1), ("1969-12-31 23:00:00", "A", 2), ("1969-12-30 00:00:00", "A", 3), ("2024-01-01", "A", 5), ("2024-01-01", "A", 4), ("2024-01-01", None, 6)]
    df = spark.createDataFrame(rows, "t string, country string, k int").selectExpr("cast(t as timestamp) datetime", "country", "k")
    got = {r.k: r.time_idx for r in time_idx(df, order=["k"]).collect()}
    assert got == {3: 0, 2: 1, 4: 2, 5: 3, 1: 4, 6: 0}


def test_a_hot_day_or_timestamp_is_spread(spark):
    """Half of all rows are one series, all of whose rows share a timestamp; the rest share one day."""
    n = 60_000
    row = F.col("id")
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    hot = row % 2 == 0
    df = spark.range(n).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), (row % 7).cast("string"))).alias("country"),
        F.when(hot, F.lit(0)).otherwise(mixed % 86_400).cast("timestamp").alias("datetime"),
        F.when(row % 5 > 0, mixed).alias("key"),
        F.when(row % 3 > 0, F.lit(1.5)).alias(V),
        row.alias("odd name"),
    )
    order = ["key", "odd name"]
    placed = with_buckets(df, ["country"], "datetime", order, rows=2000, small_bytes=0)
    sizes = [r["count"] for r in placed.groupBy("country", "_bucket").count().collect()]
    assert max(sizes) <= 2000
    assert len([r for r in placed.where("country = 'hot'").groupBy("_bucket").count().collect()]) > 25
    w = Window.partitionBy("country").orderBy("datetime", F.col("key").asc_nulls_last(), "odd name")
    expected = df.withColumn("time_idx", (F.row_number().over(w) - 1).cast("bigint"))
    got = time_idx(df, order=order, rows=2000, small_bytes=0)
    assert got.exceptAll(expected.select(got.columns)).count() == 0 and got.count() == n
    filled = ffill(df.withColumn(V, F.when(F.col("odd name") % 3 > 0, F.col("odd name").cast("double"))), order=order, rows=2000, small_bytes=0)
    known = F.when(F.col("odd name") % 3 > 0, F.col("odd name").cast("double"))
    plain_fill = df.withColumn(V, F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert filled.exceptAll(plain_fill.select(filled.columns)).count() == 0


def test_positions_and_fills_read_their_input_once(spark, tmp_path):
    hours(spark, SERIES).write.parquet(str(tmp_path / "panel"))
    df = spark.read.parquet(str(tmp_path / "panel"))
    for out in (time_idx(df), ffill(df), time_idx(df, rows=40, small_bytes=0)):
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1


def test_flat_matrix_drops_incomplete_rows_only(spark):
    df = hours(spark, SERIES)
    full = flat_matrix(df, [V], [V], 12, 5)
    expected = drop_incomplete(plain(df, 12, 5), [f"{V}_lag{k}" for k in range(1, 13)] + [f"{V}_lead{k}" for k in range(1, 6)])
    assert as_set(full.select(expected.columns)) == as_set(expected)
    assert full.count() == (157 - 17) + (31 - 17)
    assert flat_matrix(df, [V], [V], 12, 5, drop_nulls=False).count() == df.count()


def test_masked_lags_and_noise_names(spark):
    df = hours(spark, {"A": noise_series(20)}).withColumn(f"{V}_noise", F.col(V) + 1000)
    out = flat_matrix(df, [f"{V}_noise"], [V], 6, 2, seq_len=3, mask_value=-999.0)
    assert f"{V}_noise" not in out.columns
    values = noise_series(20)
    row = out.where("time_idx = 10").first()
    assert row[V] == pytest.approx(values[10] + 1000)
    assert [row[f"{V}_lag{k}"] for k in range(1, 7)] == pytest.approx([values[9] + 1000, values[8] + 1000, values[7] + 1000, -999, -999, -999])
    assert row[f"{V}_lead2"] == values[12]
    assert out.count() == 20 - 3 - 2


def test_flat_windows_equal_flat_matrix_per_history(spark):
    df = hours(spark, SERIES).withColumns({"h": F.hour("datetime"), f"{V}_noise": F.col(V) + 1})
    series = [f"{V}_noise", "h"]
    out = flat_windows(df, ["h", f"{V}_noise"], series, [V], 12, 5, [4, 8, 12], -9.0, chunk_rows=7)
    for h in (4, 8, 12):
        wide = flat_matrix(df, series, [V], 12, 5, seq_len=h, mask_value=-9.0)
        names = ["h", V, *[f"{b}_lag{k}" for b in (V, "h") for k in range(1, 13)]]
        expected = flat_arrays(wide, names, [f"{V}_lead{k}" for k in range(1, 6)])
        pick = lambda d: {(r.country, r.time_idx, tuple(r.X), tuple(r.Y)) for r in d.collect()}
        assert pick(out.where(F.col("seq_len") == h)) == pick(expected) and expected.count() > 100


def test_time_based_lag_is_null_at_gaps(spark):
    df = hours(spark, {"A": [1, 2, 3, 4, 5]}).where(f"{V} <> 3")
    rows = {r[V]: r for r in time_lag_lead(df, [V], [V], [1, 2], [1]).collect()}
    assert rows[4][f"{V}_lag1"] is None and rows[4][f"{V}_lag2"] == 2
    assert rows[2][f"{V}_lead1"] is None and rows[5][f"{V}_lag1"] == 4
    by_row = {r[V]: r[f"{V}_lag1"] for r in lag_lead(df, [V], [], [1], []).collect()}
    assert by_row[4] == 2


@pytest.mark.parametrize("n, windows", [(15, 0), (16, 1), (40, 25), (1, 0)])
def test_window_count(spark, n, windows):
    df = hours(spark, {"A": noise_series(n), "B": noise_series(30)})
    out = sequence_windows(df, [V], [V], 12, 4, chunk_rows=5)
    assert out.where("country = 'A'").count() == windows
    assert out.count() == windows + 15


def test_empty_input_gives_empty_windows(spark):
    out = sequence_windows(hours(spark, {"A": [1.0]}).limit(0), [V], [V], 12, 4)
    assert out.count() == 0 and "X" in out.columns


def test_sequence_layout_and_nulls(spark):
    df = hours(spark, {"A": [1, None, 3, 4, 5]}).withColumn("h", F.hour("datetime")).withColumn("b", F.lit(True))
    out = sequence_windows(df, [V, "h", "b"], [V], 3, 1).orderBy("time_idx").collect()
    assert [r.X for r in out] == [[1, 0, 1, None, 1, 1, 3, 2, 1], [None, 1, 1, 3, 2, 1, 4, 3, 1]]
    assert [r.Y for r in out] == [[4], [5]]
    assert sequence_windows(df, [V], [V], 2, 1, drop_nulls=True).count() == 1


def test_steps_round_trip(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "X array<double>")
    row = df.select(to_steps("X", 3, 2).alias("s"), to_flat(to_steps("X", 3, 2)).alias("f"), last_step_features("X", 2).alias("l")).first()
    assert row.s == [[1, 2], [3, 4], [5, 6]] and row.f == [1, 2, 3, 4, 5, 6] and row.l == [5, 6]


def test_panel_windows(spark):
    df = hours(spark, {"A": list(range(10)), "B": list(range(5))}).withColumn("hour", F.hour("datetime"))
    out = panel_windows(panel_frame(df), V, 4, 2, ["time_idx", "hour"], chunk_rows=3)
    rows = {r.time_idx: r for r in out.collect()}
    assert out.count() == 5 and set(rows) == {3, 4, 5, 6, 7}
    assert rows[5].encoder_target == [2, 3, 4, 5] and rows[5].decoder_target == [6, 7]
    assert rows[5].decoder_known == [6, 6, 7, 7]
    assert rows[5].relative_time_idx == [-1, -0.75, -0.5, -0.25, 0, 0.25] and rows[5].encoder_length == 4


def test_country_id_and_short_groups(spark):
    df = hours(spark, {"A": [1] * 3, "B": [1] * 5})
    assert {r.country for r in min_length_groups(df, 4).collect()} == {"B"}
    assert window_country_id(df.drop("country")).first().country_id == 0


def test_flat_arrays_pick_by_name(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, True)], "k int, a double, b double, c boolean")
    row = flat_arrays(df, ["b", "a"], ["c"]).first()
    assert (row.k, row.X, row.Y) == (1, [3, 2], [1])


def test_chunks_stay_small_for_a_hot_series(spark):
    df = hours(spark, {"hot": [1.0] * 3000, "cold": [1.0] * 20})
    rows = chunked(df, ["country"], {"_v": F.col(V)}, 10, 5, chunk_rows=100)
    assert rows.agg(F.max(F.size("_v"))).first()[0] == 115
    assert rows.count() == 3020


def test_window_tests_stay_compiled(spark):
    plan = flat_matrix(hours(spark, SERIES), [V], [V], 12, 5)._jdf.queryExecution().executedPlan().toString()
    assert "exists(" not in plan and "lambda" not in plan


def test_random_series_property(spark):
    rng = random.Random(5)
    lengths = {f"s{i}": rng.randint(1, 60) for i in range(12)}
    df = hours(spark, {s: noise_series(n, n) for s, n in lengths.items()}, T0)
    for seq, lead in ((1, 1), (7, 3), (24, 6)):
        expected = sum(max(0, n - seq - lead + 1) for n in lengths.values())
        assert sequence_windows(df, [V], [V], seq, lead, chunk_rows=11).count() == expected

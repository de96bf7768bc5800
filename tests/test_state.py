import datetime as dt
import math

import pytest
from helpers import T0, as_set, hours, noise_series
from pyspark.sql import functions as F

from loadcast.functions.clock import time_cycle, time_cycle_decode, time_parts
from loadcast.functions.noise import add_noise, noise_array
from loadcast.operators.encode import label_decode, label_encode, label_fit
from loadcast.operators.positions import row_boundaries
from loadcast.operators.sample import sample_per_group, shuffle_batches
from loadcast.operators.scale import (
    base_column,
    fit_scaler,
    inverse_arrays,
    scale_inverse,
    scale_transform,
)
from loadcast.operators.split import (
    fit_split,
    head_fraction,
    max_samples,
    split_calendar,
    split_fraction,
    split_keep,
    split_rows,
)

V = "quantity_MW"


def test_clock_round_trip_on_edges(spark):
    stamps = [dt.datetime(2024, m, 1, h, 0) for m in range(1, 13) for h in range(24)]
    stamps += [dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 2, 29, 0, 0), dt.datetime(2024, 1, 31, 12, 30)]
    stamps += [dt.datetime(2024, 5, 5, 5, m) for m in range(60)]
    df = spark.createDataFrame([(s,) for s in stamps], "datetime timestamp")
    cycle = time_cycle(df)
    for kind in ("double", "float"):
        cast = cycle.select("datetime", "year", *[F.col(c).cast(kind) for c in cycle.columns if c.endswith(("_sin", "_cos"))])
        assert time_cycle_decode(cast, "back").where("back <> datetime or back is null").count() == 0


def test_phase_starts_before_zero_for_hours(spark):
    row = time_cycle(spark.createDataFrame([(T0,)], "datetime timestamp")).first()
    assert row.hour_sin == pytest.approx(math.sin(-2 * math.pi / 24))
    assert row.month_sin == 0 and row.month_cos == 1 and row.year == 2024


def test_impossible_date_is_null(spark):
    feb = time_cycle(spark.createDataFrame([(dt.datetime(2024, 2, 1),)], "datetime timestamp"))
    day31 = time_cycle(spark.createDataFrame([(dt.datetime(2024, 1, 31),)], "datetime timestamp")).first()
    broken = feb.withColumns({"day_sin": F.lit(day31.day_sin), "day_cos": F.lit(day31.day_cos)})
    assert time_cycle_decode(broken, "back").first().back is None


def test_time_parts_keep_existing(spark):
    df = spark.createDataFrame([(T0, 7)], "datetime timestamp, hour int")
    row = time_parts(df).first()
    assert (row.year, row.month, row.day, row.hour, row.minute) == (2024, 1, 1, 7, 0)


def test_labels_unknown_and_null(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "country string")
    dictionary = label_fit(train, ["country"])
    codes = {r.label: r.code for r in dictionary.collect()}
    assert codes == {"__nan__": 0, "a": 1, "b": 2, "__unknown__": 3}
    df = spark.createDataFrame([("b",), ("new",), (None,)], "country string")
    coded = label_encode(df, dictionary, ["country"])
    assert sorted(r.country for r in coded.collect()) == [0, 2, 3]
    assert {r.country for r in label_decode(coded, dictionary, ["country"]).collect()} == {"b", "__unknown__", "__nan__"}


@pytest.mark.parametrize("method", ["standard", "minmax"])
@pytest.mark.parametrize("groups", [[], ["country"]])
def test_scale_round_trip(spark, method, groups):
    df = hours(spark, {"A": noise_series(20), "B": [5.0] * 4}).withColumn(f"{V}_lag1", F.col(V) + 1)
    state = fit_scaler(df, [V], groups)
    scaled = scale_transform(df, state, [V], method, groups).withColumn(f"{V}_lag1", F.col(V))
    back = scale_inverse(scaled, state, [V], method, groups)
    for r in back.join(df.withColumnRenamed(V, "x").drop(f"{V}_lag1"), ["datetime", "country"]).collect():
        assert r[V] == pytest.approx(r.x) and r[f"{V}_lag1"] == pytest.approx(r.x)
    if groups:
        assert {r[V] for r in scaled.where("country = 'B'").collect()} == {0.0}


def test_noise_column_uses_base_state_in_both_methods(spark):
    df = hours(spark, {"A": [0.0, 10.0]}).withColumn(f"{V}_noise", F.col(V) + 5)
    state = fit_scaler(df, [V])
    assert sorted(r[f"{V}_noise"] for r in scale_transform(df, state, [f"{V}_noise"], "minmax").collect()) == [0.5, 1.5]
    assert sorted(r[f"{V}_noise"] for r in scale_transform(df, state, [f"{V}_noise"]).collect()) == [0.0, 2.0]
    with pytest.raises(ValueError):
        scale_transform(df, state, [V], "robust")


def test_base_column_takes_longest_prefix():
    assert base_column("load_es_lag3", ["load", "load_es"]) == "load_es"
    assert base_column("loads", ["load"]) is None


def test_inverse_arrays(spark):
    df = hours(spark, {"A": [0.0, 10.0]})
    arrays = spark.createDataFrame([([0.0, 1.0, None],)], "y array<double>")
    assert inverse_arrays(arrays, fit_scaler(df, [V]), V, ["y"], "minmax").first().y == [0, 10, None]


def test_split_cuts_fall_inside_a_timestamp(spark):
    df = hours(spark, {c: [1.0] * 4 for c in "ABC"})
    cuts = fit_split(df, 0.6, 0.2, 0.2)
    out = split_fraction(df, cuts).orderBy("datetime", "country").collect()
    assert [r.split for r in out] == ["train"] * 7 + ["val"] * 2 + ["test"] * 3
    assert split_keep(split_fraction(df, cuts), ["val"]).count() == 2


@pytest.mark.parametrize("keep", [["train"], ["val"], ["test"], ["train", "val"], ["val", "test"], ["train", "val", "test"]])
@pytest.mark.parametrize("shares", [(0.6, 0.2, 0.2), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (1.0, 0.0, 0.0)])
def test_split_rows_equal_split_then_keep(spark, keep, shares):
    df = hours(spark, {c: [1.0] * 4 for c in "ABC"}).unionByName(spark.createDataFrame([(None, "A", 1.0)], "datetime timestamp, country string, quantity_MW double"))
    cuts = fit_split(df, *shares)
    assert as_set(split_rows(df, cuts, keep)) == as_set(split_keep(split_fraction(df, cuts), keep))


def test_split_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "base")
    hours(spark, {c: [1.0] * 40 for c in "ABC"}).write.parquet(path)
    df = spark.read.parquet(path)
    cuts = fit_split(df, 0.8, 0.15, 0.05)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = split_rows(df, cuts, ["val"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(datetime" in pushed and "LessThanOrEqual(datetime" in pushed


@pytest.mark.parametrize("rank_rows", [1, 3, 1_000_000])
@pytest.mark.parametrize("rank", [1, 2, 30, 71, 72, 73, 100, 144])
def test_boundary_rows(spark, rank, rank_rows):
    df = hours(spark, {"A": [1.0] * 72, "B": [1.0] * 72})
    ordered = sorted((r.datetime, r.country) for r in df.collect())
    found = row_boundaries(df, [F.lit(rank), F.lit(0)], ["country"], rank_rows=rank_rows)
    assert found[1] is None
    expected = ordered[rank - 1]
    assert found[0]["us"] == int(expected[0].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    head = max_samples(df, rank, order=["country"]).collect()
    assert sorted((r.datetime, r.country) for r in head) == ordered[:rank]


def test_split_edge_shares(spark):
    df = hours(spark, {"A": [1.0] * 3})
    assert {r.split for r in split_fraction(df, fit_split(df, 0.0, 0.0, 1.0)).collect()} == {"test"}
    assert {r.split for r in split_fraction(df, fit_split(df, 1.0, 0.0, 0.0)).collect()} == {"train"}
    empty = df.limit(0)
    assert split_fraction(empty, fit_split(empty)).count() == 0
    with pytest.raises(ValueError):
        fit_split(df, 0.5, 0.1, 0.1)


def test_split_calendar(spark):
    df = hours(spark, {"A": [1.0] * 72})
    out = split_calendar(df, "2024-01-02", "2024-01-03")
    assert {(r.split, r["count"]) for r in out.groupBy("split").count().collect()} == {("train", 24), ("val", 24), ("test", 24)}


def test_head_and_max(spark):
    df = hours(spark, {"A": [1.0] * 9, "B": [1.0] * 2})
    assert head_fraction(df, 0.5, order=["country"]).count() == 5
    assert max_samples(df, None).count() == 11 and max_samples(df, 50, order=["country"]).count() == 11


def test_sample_size_rounds_half_to_even_and_is_stable(spark):
    df = hours(spark, {"A": [1.0] * 5, "B": [1.0] * 7, "C": [1.0] * 200})
    pick = lambda d: as_set(sample_per_group(d, 0.5, ["country", "datetime"]).select("country", "datetime"))
    first = pick(df)
    assert {c: sum(1 for g, _ in first if g == c) for c in "ABC"} == {"A": 2, "B": 4, "C": 100}
    assert first == pick(df.repartition(7)) == pick(df.repartition(1))


def test_shuffle_is_a_permutation(spark):
    df = hours(spark, {"A": [1.0] * 100})
    out = shuffle_batches(df, 32, ["country", "datetime"]).collect()
    assert sorted(r.shuffle_rank for r in out) == list(range(100))
    assert sorted({r.batch_id for r in out}) == [0, 1, 2, 3]
    by_time = [r.shuffle_rank for r in sorted(out, key=lambda r: r.datetime)]
    assert by_time != sorted(by_time)


def test_noise_is_normal_and_repeatable(spark):
    df = spark.range(20_000)
    noise = lambda d: d.select("id", add_noise(F.lit(0.0), F.col("id"), 2.0, 42).alias("z"))
    stats = noise(df).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(stats[0]) < 0.05 and abs(stats[1] - 2) < 0.05
    assert as_set(noise(df)) == as_set(noise(df.repartition(7)))
    other = df.select("id", add_noise(F.lit(0.0), F.col("id"), 2.0, 43).alias("z"))
    assert as_set(noise(df)) != as_set(other)


def test_noise_spares_the_sentinel(spark):
    df = spark.createDataFrame([("k", [1.0, -999.0, 1.0])], "k string, x array<double>")
    x = df.select(noise_array(F.col("x"), F.col("k"), 0.1, 1, -999.0).alias("x")).first().x
    assert x[1] == -999.0 and x[0] != 1.0 and x[0] != x[2]
    assert df.select(noise_array(F.col("x"), F.col("k"), 0.0, 1).alias("x")).first().x == [1.0, -999.0, 1.0]

"""Keys that cannot collide, rows that do not vanish, and digits that stay."""

import numpy as np
import pytest
from helpers import T0, as_set, hours, noise_series
from pyspark.sql import functions as F

from loadcast.operators import windows
from loadcast.operators.autocorr import acf
from loadcast.operators.clean import ffill, hourly_first, hourly_grid
from loadcast.operators.linear import linear_fit
from loadcast.operators.metrics import attach_forecast, mape, metrics_by, metrics_global, pinball_loss
from loadcast.operators.positions import time_idx
from loadcast.operators.sample import sample_per_group
from loadcast.operators.scale import fit_scaler, scale_inverse, scale_transform
from loadcast.operators.score import score_external
from loadcast.operators.split import fit_split, head_fraction, max_samples, split_fraction
from loadcast.functions.clock import time_parts
from loadcast.operators.windows import lag_lead, min_length_groups, panel_frame, time_lag_lead
from loadcast.sources.datasets import group_profile, read_panel_split, write_panel_split
from loadcast.sources.documents import parse_load_xml, unread_points

V = "quantity_MW"
PAIRS = [("a_b", "c"), ("a", "b_c"), (None, "c"), ("__nan__", "c"), ("a\\", "c"), ("a", None)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(T0, i * 10 + j, p, q, float(100 * i + j)) for i, (p, q) in enumerate(PAIRS) for j in range(4)]
    df = spark.createDataFrame(rows, f"datetime timestamp, h int, p string, q string, {V} double")
    return df.withColumn("datetime", F.col("datetime") + F.make_dt_interval(hours=F.col("h") % 10)).drop("h")


def test_series_with_like_names_stay_apart(spark, pairs):
    two = ["p", "q"]
    assert [r.time_idx for r in time_idx(pairs, two).orderBy("p", "q", "datetime").collect()] == [0, 1, 2, 3] * 6
    for r in lag_lead(pairs, [V], [V], [1], [1], groups=two).collect():
        step = r[V] % 100
        assert r[f"{V}_lag1"] == (r[V] - 1 if step else None)
        assert r[f"{V}_lead1"] == (r[V] + 1 if step < 3 else None)
    assert min_length_groups(pairs, 5, two).count() == 0 and min_length_groups(pairs, 4, two).count() == 24
    assert group_profile(pairs, two).first().groups == 6
    gaps = pairs.withColumn(V, F.when(F.col(V) % 100 == 1, F.col(V)))
    filled = ffill(gaps, groups=two).where(F.col(V).isNotNull())
    assert filled.count() == 18 and filled.select(V).distinct().count() == 6
    assert sample_per_group(pairs, 0.5, ["p", "q", "datetime"], two).groupBy(*two).count().select("count").distinct().collect() == [(2,)]


def test_scalers_per_series_with_like_names(spark, pairs):
    state = fit_scaler(pairs, [V], ["p", "q"])
    assert state.count() == 6 and state.select("group").distinct().count() == 6
    scaled = scale_transform(pairs, state, [V], "minmax", ["p", "q"])
    assert scaled.agg(F.min(V), F.max(V)).first() == (0.0, 1.0)
    assert as_set(scale_inverse(scaled, state, [V], "minmax", ["p", "q"])) == as_set(pairs)
    single = fit_scaler(pairs.where("q = 'c'"), [V], ["p"])
    assert single.select("group").distinct().count() == 4


@pytest.fixture(scope="module")
def uneven(spark):
    texts = ["2024-01-01 00:30", "2024-01-01 01:00", "2024-01-01 03:00", "2024-01-01 03:30", None]
    rows = [(t, s, float(i)) for s in ("A", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"t string, country string, {V} double").select(F.to_timestamp("t").alias("datetime"), "country", V)


def test_no_reading_vanishes(spark, uneven):
    whole = as_set(uneven)
    grid = hourly_grid(uneven)
    assert whole <= as_set(grid.select("datetime", "country", V))
    lagged = time_lag_lead(uneven, [V], [V], [1, 3], [2])
    assert as_set(lagged.select("datetime", "country", V)) == whole and lagged.count() == 10
    by = {(r.country, r[V]): (r[f"{V}_lag1"], r[f"{V}_lag3"], r[f"{V}_lead2"]) for r in lagged.collect()}
    for s in ("A", None):
        assert by[s, 0.0] == (None, None, None) and by[s, 3.0] == (None, 0.0, None)
        assert by[s, 1.0] == (None, None, 2.0) and by[s, 2.0] == (None, None, None)
    assert {r.country for r in acf(uneven.where("datetime is not null"), 2).collect()} == {"A", None}
    left = uneven.where("datetime is not null").withColumn("time_idx", F.col(V).cast("int"))
    assert attach_forecast(left, left.select("country", "time_idx", F.lit(1.0).alias("y_pred"))).count() == 8
    assert hourly_first(uneven).where("datetime is null").count() == 0


def long_frame(spark, truth, pred):
    rows = [(int(i), float(t), float(p)) for i, (t, p) in enumerate(zip(truth, pred))]
    return spark.createDataFrame(rows, "i int, y_true double, y_pred double").withColumn("lead", F.col("i") % 3)


@pytest.mark.parametrize(("base", "step"), [(50.0, 1e-6), (1e6, 1e-3), (1e9, 1.0)])
def test_metrics_agree_with_numpy(spark, base, step):
    rng = np.random.default_rng(1)
    truth = base + step * rng.integers(0, 240, 200)
    pred = truth + step * rng.normal(0, 30, 200)
    got = {r.lead: r for r in metrics_by(long_frame(spark, truth, pred), [[], ["lead"]]).collect()}
    for lead in (None, 0, 1, 2):
        t, p = (x if lead is None else x[lead::3] for x in (truth, pred))
        r, e = got[lead], p - t
        assert r.n == len(t) and r.mae == pytest.approx(np.abs(e).mean(), rel=1e-9)
        assert r.rmse == pytest.approx(np.sqrt((e**2).mean()), rel=1e-9)
        centred = t - t.mean()
        assert r.correlacao_pearson == pytest.approx(np.corrcoef(centred, p - p.mean())[0, 1], rel=1e-7)
        assert r.r2 == pytest.approx(1 - (e**2).sum() / (centred**2).sum(), rel=1e-7)


def test_nan_is_no_forecast(spark):
    df = long_frame(spark, [1.0, 2.0, 4.0], [1.0, float("nan"), 5.0])
    r = metrics_global(df).first()
    assert (r.n, r.mae, r.mse) == (2, 0.5, 0.5)
    assert mape(df).first().mape == pytest.approx(0.125)
    assert pinball_loss(df.withColumn("quantile", F.lit(0.5))).first().pinball == pytest.approx(0.25)


def test_scores_stay_with_their_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0]), (4, None), (5, [1.0, None])]
    df = spark.createDataFrame(rows, "k int, X array<double>").coalesce(1)
    got = {r.k: r.y_pred for r in score_external(df, lambda x: x.sum(axis=1), y=None).collect()}
    assert got == {1: [3.0], 2: None, 3: [7.0], 4: None, 5: [None]}
    assert [r.y_pred for r in score_external(df.where("k = 2"), lambda x: x.sum(axis=1), y=None).collect()] == [None]
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k int, X array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        score_external(mixed, lambda x: x.sum(axis=1), y=None).collect()


def test_heads_have_exactly_so_many_rows(spark):
    rows = [(T0, s, float(i)) for s in "ABC" for i in range(7)]
    df = spark.createDataFrame(rows, f"datetime timestamp, country string, {V} double")
    df = df.withColumn("datetime", F.when(F.col(V) != 6, F.col("datetime") + F.make_dt_interval(hours=F.col(V).cast("int"))))
    for n in (1, 2, 10, 17, 18, 40):
        got = max_samples(df, n)
        assert got.count() == min(n, 18) == max_samples(df, n, order=("country",)).count()
        assert as_set(got) == as_set(max_samples(df.repartition(5), n))
    assert head_fraction(df, 0.5).count() == 9
    same = spark.createDataFrame([(T0, "A", 1.0)] * 9, df.schema)
    assert max_samples(same, 4).count() == 4
    assert max_samples(same.limit(0), 4).count() == 0


def test_rows_without_a_time_have_no_split(spark, uneven):
    labelled = split_fraction(uneven, fit_split(uneven))
    assert {r.split for r in labelled.where("datetime is null").collect()} == {None}
    assert labelled.where("datetime is not null and split is null").count() == 0


def test_small_spreads_get_their_weight(spark):
    rng = np.random.default_rng(0)
    x = np.c_[1.7e9 + rng.integers(-50, 50, 400), rng.normal(size=400), np.full(400, 0.1)]
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5
    rows = [(r.tolist(), [float(v)]) for r, v in zip(x, y)]
    model = linear_fit(spark.createDataFrame(rows, "X array<double>, Y array<double>").repartition(5))
    assert model.weights[:2, 0] == pytest.approx([3.0, -2.0], rel=1e-6)
    assert model.weights[2, 0] == 0.0 and list(model.dropped) == [2]


def test_measurements_stay_in_the_past(spark, tmp_path):
    rows = [(T0, "A", float(i), 0.5 + i) for i in range(12)]
    df = spark.createDataFrame(rows, f"datetime timestamp, country string, {V} double, {V}_noise double")
    df = time_parts(df.withColumn("datetime", F.col("datetime") + F.make_dt_interval(hours=F.col(V).cast("int"))))
    panel = panel_frame(df).withColumn("split", F.lit("train"))
    path = str(tmp_path / "panel")
    write_panel_split(panel, path, [f"{V}_noise", "hour"], [V], 3, 2)
    cut = read_panel_split(spark, path, "train", windows=True).orderBy("time_idx").collect()
    assert len(cut) == 8
    for r in cut:
        assert r.encoder_observed == [x + 0.5 for x in r.encoder_target]
        assert not {x + 0.5 for x in r.decoder_target} & set(r.decoder_known)
        assert r.decoder_known == [float(x) for t in (1, 2) for x in (r.time_idx + t, 2024, 1, 1, r.time_idx + t, 0)]
    named = read_panel_split(spark, path, "train", windows=True, known=["time_idx", f"{V}_noise"]).first()
    assert "encoder_observed" not in named.asDict() and len(named.decoder_known) == 4


def test_unread_points_are_counted(spark):
    point = "<Point><position>1</position><quantity>5</quantity></Point>"
    doc = "<D><Period><timeInterval><start>{}</start></timeInterval><resolution>{}</resolution>" + point + "</Period></D>"
    texts = [("A", doc.format("2024-01-01T00:00Z", d)) for d in ("PT30S", "P1M", "P1M")] + [("A", doc.format("soon", "PT1H"))]
    points = parse_load_xml(spark.createDataFrame(texts, "country string, xml string"))
    assert points.where("datetime is not null").count() == 1
    found = {(r.resolution, r.start_read, r.points) for r in unread_points(points).collect()}
    assert found == {("P1M", True, 2), ("PT1H", False, 1)}


def test_wide_windows_are_cut_in_compiled_code(spark, monkeypatch):
    series = {"A": noise_series(700), "B": [None if i % 97 == 5 else v for i, v in enumerate(noise_series(40, 2))]}
    df = hours(spark, series)
    for complete in (False, True):
        wide = lag_lead(df, [V], [V], range(1, 241), range(1, 73), complete=complete)
        monkeypatch.setattr(windows, "COMPILED_COLUMNS", 10_000)
        plain = lag_lead(df, [V], [V], range(1, 241), range(1, 73), complete=complete)
        monkeypatch.undo()
        assert as_set(wide) == as_set(plain) and wide.columns == plain.columns
        assert wide.count() == (700 - 240 - 72 if complete else 740)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(array" in plan

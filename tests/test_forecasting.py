import numpy as np
import pytest
from helpers import as_set, hours, noise_series
from pyspark.sql import functions as F

from loadcast.operators.autocorr import acf, pacf
from loadcast.operators.linear import (
    LinearModel,
    cross_products,
    linear_fit,
    linear_predict,
    ridge_grid,
    squared_error,
)
from loadcast.operators.metrics import (
    attach_forecast,
    forecast_long,
    forecast_wide,
    mape,
    metrics_by_country,
    metrics_global,
    metrics_per_lead,
    pinball_loss,
    rank_models,
)
from loadcast.operators.score import score_external
from loadcast.operators.windows import sequence_windows
from loadcast.plans import scenario as S
from loadcast.plans.evaluate import evaluate, noise_degradation

V = "quantity_MW"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "country string, lead int, y_true double, y_pred double")


def numpy_metrics(t, p):
    d = p - t
    return [np.abs(d).mean(), (d**2).mean(), np.sqrt((d**2).mean()), np.corrcoef(t, p)[0, 1], 1 - (d**2).sum() / ((t - t.mean()) ** 2).sum()]


def test_metrics_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(c, k, float(t), float(t + rng.normal())) for c in "AB" for k in (1, 2, 3) for t in rng.normal(30_000, 5, 40)]
    long = pairs(spark, rows)
    out = {(r.country, r.lead): r for r in metrics_by_country(long).collect()}
    assert len(out) == 1 + 3 + 2 + 6
    for (country, lead), r in out.items():
        chosen = [x for x in rows if country in (None, x[0]) and lead in (None, x[1])]
        t, p = np.array([x[2] for x in chosen]), np.array([x[3] for x in chosen])
        assert r.n == len(chosen)
        assert [r.mae, r.mse, r.rmse, r.correlacao_pearson, r.r2] == pytest.approx(numpy_metrics(t, p), rel=1e-6)
    assert metrics_global(long).first().mae == pytest.approx(out[None, None].mae)
    assert metrics_per_lead(long).count() == 3


@pytest.mark.parametrize("truth, forecast", [([0.1] * 3, [1.0, 2.0, 3.0]), ([1.0, 2.0, 3.0], [0.1] * 3)])
def test_constant_input_gives_null(spark, truth, forecast):
    rows = [("A", 1, t, p) for t, p in zip(truth, forecast)] + [("B", 1, t, p) for t, p in zip(truth, forecast)]
    r = metrics_global(pairs(spark, rows)).first()
    assert r.correlacao_pearson is None and r.mae > 0
    assert (r.r2 is None) == (len(set(truth)) == 1)


def test_empty_metrics(spark):
    assert metrics_global(pairs(spark, [])).first().mae is None


def test_rank_mape_pinball(spark):
    long = pairs(spark, [("A", 1, 10.0, 11.0), ("B", 1, 0.0, 5.0), ("B", 2, 4.0, 2.0)])
    assert [r.model for r in rank_models(long.withColumnRenamed("country", "model"), 1).collect()] == ["A"]
    assert mape(long).first().mape == pytest.approx((0.1 + 0.5) / 2)
    loss = pinball_loss(long.withColumn("quantile", F.lit(0.9))).first()
    assert loss.pinball == pytest.approx((0.1 * 1 + 0.1 * 5 + 0.9 * 2) / 3)


def test_forecast_table_shapes(spark):
    df = spark.createDataFrame([("A", 3, [1.0, 2.0], [1.5, None])], "country string, time_idx int, y_true array<double>, y_pred array<double>")
    assert as_set(forecast_long(df, ["country"])) == {("A", 1, 1.0, 1.5), ("A", 2, 2.0, None)}
    wide = forecast_wide(df, ["country"], "q", 2)
    assert wide.columns == ["country", "q_lead1_real", "q_lead2_real", "q_lead1_pred", "q_lead2_pred"]
    features = spark.createDataFrame([("A", 3, 9.0), ("A", 4, 8.0)], "country string, time_idx int, x double")
    assert attach_forecast(features, df).select("x").first().x == 9.0


def by_hand_acf(x, lags):
    x = np.array(x) - np.mean(x)
    return [float((x[k:] * x[: len(x) - k]).sum() / (x * x).sum()) for k in range(lags + 1)]


def test_acf_and_pacf(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for _ in range(399):
        x.append(0.7 * x[-1] + rng.normal())
    df = hours(spark, {"A": x, "B": [3.0] * 10, "C": [1.0, None, 2.0, 4.0]})
    out = {(r.country, r.lag): r for r in acf(df, 20).collect()}
    assert [out["A", k].acf for k in range(21)] == pytest.approx(by_hand_acf(x, 20))
    assert out["B", 1].acf is None
    assert [out["C", k].acf for k in range(3)] == pytest.approx(by_hand_acf([1, 2, 4], 2)) and ("C", 3) not in out
    r = by_hand_acf(x, 20)
    assert out["A", 3].band == pytest.approx(1.959963984540054 * np.sqrt((1 + 2 * (r[1] ** 2 + r[2] ** 2)) / 400))
    part = {(p.country, p.lag): p.pacf for p in pacf(df, 20).collect()}
    for k in (1, 2, 5, 20):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert part["A", k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])
    assert part["A", 0] == 1.0 and part["B", 1] is None


def xy(spark, n=300, d=4, m=2, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 10, 100, 1] + [0, 5, 1000, 0]
    x[:, 3] = 7.0
    y = x[:, :3] @ rng.normal(size=(3, m)) + 2 + 0.1 * rng.normal(size=(n, m))
    rows = [("train" if i % 3 else "val", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "split string, X array<double>, Y array<double>").repartition(parts), x, y


def test_linear_fit_is_least_squares(spark):
    df, x, y = xy(spark)
    model = linear_fit(df)
    design = np.hstack([np.ones((len(x), 1)), x[:, :3]])
    best = np.linalg.lstsq(design, y, rcond=None)[0]
    assert model.predict(x) == pytest.approx(design @ best, abs=1e-6)
    assert model.weights[3] == pytest.approx([0, 0])
    scored = linear_predict(df, model).collect()
    assert all(r.y_pred == pytest.approx(r.y_true, abs=1) for r in scored) and len(scored) == len(x)
    error = np.mean((design @ best - y) ** 2)
    assert squared_error(model, cross_products(df)[None]) == pytest.approx(error, rel=1e-4)
    back = LinearModel.from_table(model.table(spark))
    assert back.predict(x) == pytest.approx(model.predict(x))


def test_linear_fit_does_not_depend_on_partitions_and_skips_nulls(spark):
    df, _, _ = xy(spark, parts=1)
    other = df.repartition(13).unionByName(spark.createDataFrame([("train", [None, 1.0, 1.0, 1.0], [1.0, 1.0])], df.schema))
    assert linear_fit(df).weights == pytest.approx(linear_fit(other).weights, rel=1e-6)
    with pytest.raises(ValueError):
        linear_fit(df.limit(0))


def test_ridge_matches_closed_form_and_picks_best(spark):
    df, x, y = xy(spark)
    model, penalty, table = ridge_grid(df, [0.0, 0.5, 1e6])
    rows = {r.penalty: r for r in table.collect()}
    assert penalty == min(rows.values(), key=lambda r: r.val_mse).penalty and len(rows) == 3
    train = np.arange(len(x)) % 3 != 0
    a, b = x[train][:, :3], y[train]
    ac, bc = a - a.mean(0), b - b.mean(0)
    w = np.linalg.solve(ac.T @ ac / len(a) + 0.5 * np.eye(3), ac.T @ bc / len(a))
    pred = (x[~train][:, :3] - a.mean(0)) @ w + b.mean(0)
    assert rows[0.5].val_mse == pytest.approx(np.mean((pred - y[~train]) ** 2), rel=1e-5)


def test_score_external_keeps_rows_and_keys(spark):
    df, x, _ = xy(spark)
    out = score_external(df, lambda v: v[:, :2] * 2).collect()
    assert sorted(r.y_pred[0] for r in out) == pytest.approx(sorted((x[:, 0] * 2).tolist()))
    assert out[0].asDict().keys() == {"split", "y_true", "y_pred"}
    assert score_external(df.limit(0), lambda v: v).count() == 0


def test_noise_degradation_grows_with_sigma(spark):
    df = hours(spark, {"A": noise_series(200)})
    windows = sequence_windows(df, [V], [V], 1, 1)
    truth = windows.withColumn("Y", F.col("X"))
    out = {r.sigma: r.mae for r in noise_degradation(truth, lambda v: v, [0.0, 1.0, 3.0], F.col("datetime")).collect()}
    assert out[0.0] == 0 and 0 < out[1.0] < out[3.0]
    assert out[3.0] == pytest.approx(3 * out[1.0], rel=1e-6)


def small_panel(spark):
    return hours(spark, {c: noise_series(240, i) for i, c in enumerate(("FR", "ES", "PT"))})


def test_nine_scenarios():
    cases = {c.name: c for c in S.scenarios()}
    assert sorted(cases) == [f"N{i}{x}" for i in (1, 2, 3) for x in "ABC"]
    assert [cases[f"N1{x}"].seq_len for x in "ABC"] == [72, 168, 240]
    assert cases["N1A"].countries == ("ES",) and cases["N2A"].countries == ("FR", "ES", "PT")
    assert cases["N3A"].noise == 0.01 and cases["N2A"].noise == 0 and all(c.lag == 240 and c.lead == 72 and c.keep == ("test",) for c in cases.values())
    assert S.training_scenario().keep == ("train", "val") and S.tuning_scenario().size == 0.2
    assert len(S.flat_features(240)) == 251


def test_scenario_run_and_feature_order_under_noise(spark):
    base = small_panel(spark)
    cuts = S.fit_cuts(base)
    state = S.fit_training_state(base, cuts)
    training = S.training_scenario(lag=6, lead=2)
    flat = S.flat_dataset(base, training, cuts, state)
    assert {r.split for r in flat.select("split").distinct().collect()} == {"train", "val"}
    model, _, _ = ridge_grid(S.flat_xy(flat, training), [0.0, 0.1])
    assert model.weights.shape == (len(S.flat_features(6)), 2)
    cases = S.scenarios(histories=(2, 4, 6), lead=2)
    weights, intercept = model.weights, model.intercept
    out = S.run_scenarios(base, [cases[2], cases[5], cases[8]], state, lambda x: x @ weights + intercept)
    overall = {r.scenario: r for r in out.where("lead is null and country is null").collect()}
    assert set(overall) == {"N1C", "N2C", "N3C"}
    assert overall["N3C"].mae != overall["N2C"].mae and overall["N3C"].n == overall["N2C"].n
    assert {r.country for r in out.where("country is not null").collect()} == {"FR", "ES", "PT"}
    noisy = S.flat_xy(S.flat_dataset(base, cases[8], cuts, state), cases[8])
    clean = S.flat_xy(S.flat_dataset(base, cases[5], cuts, state), cases[5])
    joined = noisy.alias("n").join(clean.alias("c"), ["country", "time_idx"]).select("n.X", "n.Y", "c.X", "c.Y").collect()
    value = S.BASE_FEATURES.index(V)
    for nx, ny, cx, cy in joined:
        assert ny == cy and nx[0] == cx[0] and nx[value] == pytest.approx(cx[value], abs=0.2) and nx[value] != cx[value]


def test_scenario_datasets(spark):
    base = small_panel(spark)
    cuts = S.fit_cuts(base)
    state = S.fit_training_state(base, cuts)
    case = S.training_scenario(lag=6, lead=2)
    seq = S.sequence_dataset(base, case, cuts, state)
    sizes = seq.select(F.size("X").alias("x"), F.size("Y").alias("y")).distinct().collect()
    assert [(r.x, r.y) for r in sizes] == [(6 * len(S.BASE_FEATURES), 2)]
    assert {r.country_id for r in seq.select("country_id").distinct().collect()} == {0, 1, 2}
    assert S.panel_dataset(base, case, cuts).count() == 576 + 108
    sample = S.select_rows(base, S.tuning_scenario(lag=6, lead=2))
    assert sample.count() == 144


def test_evaluate_is_invariant_to_scaling(spark):
    from loadcast.operators.scale import fit_scaler, scale_transform

    base = small_panel(spark)
    state = fit_scaler(base, [V])
    mean = lambda x: x.mean(axis=1, keepdims=True).repeat(2, axis=1)
    scaled = sequence_windows(scale_transform(base, state, [V]), [V], [V], 4, 2)
    a = evaluate(scaled, mean, state=state).where("lead is null and country is null").first()
    b = evaluate(sequence_windows(base, [V], [V], 4, 2), mean).where("lead is null and country is null").first()
    assert a.mae == pytest.approx(b.mae) and a.r2 == pytest.approx(b.r2)

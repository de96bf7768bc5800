"""Models with several inputs and with quantiles, and the scenarios they are scored in."""

import datetime as dt
import random

import numpy as np
import pytest
from helpers import T0, hours, noise_series
from pyspark.sql import functions as F

from loadcast.catalog import all_queries
from loadcast.catalog.forecasting import HISTORIES, LEAD, SERIES, base_table
from loadcast.functions.columns import expand_steps
from loadcast.operators.metrics import metrics_by, quantile_long
from loadcast.operators.scale import fit_scaler, scale_transform
from loadcast.operators.score import score_inputs
from loadcast.operators.windows import panel_frame, panel_windows, sequence_windows
from loadcast.plans import scenario as S
from loadcast.plans.evaluate import evaluate_quantiles, quantile_forecasts

V = "quantity_MW"


def test_several_inputs_of_several_lengths(spark):
    rows = [
        (1, [1.0, 2.0, 3.0, 4.0], [10.0, 20.0], 5, [0.0, 0.0]),
        (2, [1.0, 2.0], [30.0], 6, [0.0, 0.0]),
        (3, None, [30.0], 6, [0.0, 0.0]),
        (4, [1.0, 2.0, 3.0, None], [10.0, 20.0], None, [0.0, None]),
        (5, [5.0, 6.0, 7.0, 8.0], [1.0, 2.0], 7, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "id int, enc array<double>, known array<double>, code int, Y array<double>").coalesce(1)
    seen = {}

    def predict(given):
        assert given["enc"].shape[2] == 2 and given["known"].ndim == 2 and given["code"].ndim == 1
        total = np.nansum(given["enc"], axis=(1, 2)) + given["known"].sum(axis=1) * 100 + given["code"] * 10_000
        return np.stack([total, np.where(given["code"] == 6, np.nan, total + 1)], axis=1)

    out = {r.id: r for r in score_inputs(df, predict, {"enc": 2, "known": None, "code": 0}).collect()}
    seen = {i: r.y_pred for i, r in out.items()}
    assert seen == {1: [53010.0, 53011.0], 2: [63003.0, None], 3: None, 4: None, 5: [70326.0, 70327.0]}
    assert out[4].y_true == [0.0, None] and set(out[1].asDict()) == {"id", "y_true", "y_pred"}
    bad = score_inputs(df.where("id <> 3"), lambda g: np.zeros((len(g["enc"]), g["enc"].shape[1])), {"enc": 2, "known": None})
    with pytest.raises(Exception, match="different lengths"):
        bad.collect()


def test_quantiles_keep_their_axis(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], [rng.gauss(0, 1) for _ in range(4)], [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    rows.append((99, "a", None, [1.0, 2.0, 3.0]))
    df = spark.createDataFrame(rows, "id int, country string, X array<double>, Y array<double>").repartition(3)
    levels = (0.1, 0.5, 0.9)

    def predict(given):
        x = given["X"]
        return x.mean(axis=1)[:, None, None] + np.arange(3)[None, :, None] + (np.array(levels) - 0.5)

    scored = {r.id: r for r in quantile_forecasts(df, predict, levels, {"X": None}).collect()}
    for i, _, x, y in rows[:-1]:
        assert np.allclose(scored[i].y_pred, [[np.mean(x) + lead + q - 0.5 for q in levels] for lead in range(3)])
        assert scored[i].y_true == y
    assert scored[99].y_pred is None
    out = {(r.country, r.lead, r["quantile"]): r for r in evaluate_quantiles(df, predict, levels).collect()}
    assert len(out) == 3 * (1 + 3 + 2 + 6)
    for country in (None, "a"):
        for lead in (None, 2):
            for q in levels:
                pairs = [
                    (y[k], np.mean(x) + k + q - 0.5)
                    for _, c, x, y in rows[:-1]
                    for k in range(3)
                    if (country is None or c == country) and (lead is None or k + 1 == lead)
                ]
                t, p = np.array(pairs).T
                got = out[country, lead, q]
                assert got.n == len(pairs)
                assert got.mae == pytest.approx(np.abs(t - p).mean()) and got.rmse == pytest.approx(np.sqrt(((t - p) ** 2).mean()))
                assert got.pinball == pytest.approx(np.maximum(q * (t - p), (q - 1) * (t - p)).mean())
                assert got.covered == pytest.approx((t <= p).mean())


def test_quantiles_are_unscaled(spark):
    panel = hours(spark, {"A": noise_series(60), "B": noise_series(50, 2)})
    state = fit_scaler(panel, [V])
    predict = lambda g: g["X"].mean(axis=1)[:, None, None] + np.zeros((1, 2, 3)) + np.array([-1.0, 0.0, 1.0])
    scaled = sequence_windows(scale_transform(panel, state, [V]), [V], [V], 5, 2)
    plain = sequence_windows(panel, [V], [V], 5, 2)
    sd = panel.agg(F.stddev_pop(V)).first()[0]
    want = {(r.country, r.time_idx): np.mean(r.X) for r in plain.collect()}
    for r in quantile_forecasts(scaled, predict, (0.1, 0.5, 0.9), {"X": None}, state).collect():
        m = want[r.country, r.time_idx]
        assert np.allclose(r.y_pred, [[m - sd, m, m + sd]] * 2)


def test_quantile_long_of_missing_values(spark):
    df = spark.createDataFrame([(1, [1.0, None], [[1.0, 2.0], [float("nan"), None]])], "id int, y_true array<double>, y_pred array<array<double>>")
    long = quantile_long(df, ["id"], (0.1, 0.9))
    got = {(r.lead, r["quantile"]): (r.y_true, r.y_pred) for r in long.collect()}
    assert got == {(1, 0.1): (1.0, 1.0), (1, 0.9): (1.0, 2.0), (2, 0.1): (None, None), (2, 0.9): (None, None)}
    assert {r.n for r in metrics_by(long, [["lead"]], quantile="quantile").where("lead = 2").collect()} == {0}


@pytest.fixture(scope="module")
def base(spark):
    n = 1000
    start = dt.datetime(2024, 1, 1)
    return hours(spark, {"ES": noise_series(n), "FR": noise_series(n, 2), "PT": noise_series(n, 3)}, start).cache()


def levels(base, noise):
    cases = [S.Scenario("a", ("ES", "FR"), 24, 3, 8, noise), S.Scenario("b", ("ES", "FR"), 24, 3, 24, noise)]
    cuts = S.fit_cuts(S.select_rows(base, cases[0]))
    return S.select_rows(base, cases[0]), cases, cuts, S.fit_training_state(base, S.fit_cuts(base))


def test_sequences_of_two_histories_are_those_cut_apart(spark, base):
    rows, cases, cuts, state = levels(base, 0.0)
    got = S.sequence_level(rows, cases, cuts, state)
    for case in cases:
        want = S.sequence_dataset(rows, case, cuts, state)
        mine = got.where(F.col("scenario") == case.name)
        columns = ["split", "country", "datetime", "time_idx", "X", "Y", "country_id"]
        assert mine.count() == want.count() > 0
        assert mine.select(columns).exceptAll(want.select(columns)).count() == 0


def test_noise_reaches_the_encoder_only(spark, base):
    for build, seen, hidden in ((S.sequence_level, ["X"], ["Y"]), (S.panel_level, ["encoder_target"], ["Y", "encoder_known", "decoder_known", "static"])):
        clean, noisy = build(*levels(base, 0.0)), build(*levels(base, 0.5))
        keys = ["scenario", "country", "datetime"]
        both = clean.select(*keys, *[F.col(c).alias(f"{c}_clean") for c in [*seen, *hidden]]).join(noisy, keys)
        assert both.count() == clean.count() == noisy.count() > 0
        for c in seen:
            assert both.where(F.col(c) == F.col(f"{c}_clean")).count() == 0
        for c in hidden:
            assert both.where(~F.col(c).eqNullSafe(F.col(f"{c}_clean"))).count() == 0


def test_panel_inputs_of_two_histories(spark, base):
    rows, cases, cuts, state = levels(base, 0.0)
    got = S.panel_level(rows, cases, cuts, state)
    codes = {r.label: r.code for r in state.dictionary.where("col = 'country'").collect()}
    for case in cases:
        framed = panel_frame(S.time_parts(S.split_rows(rows, cuts, case.keep)), S.GROUPS)
        want = {(r.country, r.datetime): r for r in panel_windows(framed, V, case.seq_len, case.lead, groups=S.GROUPS).collect()}
        mine = got.where(F.col("scenario") == case.name).collect()
        assert len(mine) == len(want) > 0
        for r in mine:
            w = want[r.country, r.datetime]
            assert (r.encoder_target, r.Y, r.encoder_known, r.decoder_known) == (w.encoder_target, w.decoder_target, w.encoder_known, w.decoder_known)
            assert r.static == [codes[r.country]]


def test_noise_of_readings_within_a_second_and_of_no_series(spark):
    rows = [(T0 + dt.timedelta(microseconds=250_000 * i), c, 1.0 * i) for i in range(8) for c in ("A", None)]
    noisy = S.with_noise(spark.createDataFrame(rows, "datetime timestamp, country string, quantity_MW double"), 1.0)
    draws = {round(r.quantity_MW_noise - r.quantity_MW, 9) for r in noisy.collect()}
    assert len(draws) == 16


def test_steps():
    assert expand_steps(3) == [1, 2, 3] and expand_steps(None, 2) == [1, 2] and expand_steps((2, 5)) == [2, 5]
    assert expand_steps(0) == expand_steps(-4) == expand_steps(None) == [1] and expand_steps([]) == []


def test_scenario_linear_is_that_of_numpy(spark, sf_dir):
    """The same fit, choice of penalty, scaling back and errors, from the flat matrix in numpy."""

    base = base_table(spark, sf_dir)
    cuts = S.fit_cuts(base)
    state = S.fit_training_state(base, cuts)
    case = S.training_scenario(SERIES, 24, LEAD)
    rows = S.flat_xy(S.flat_dataset(base, case, cuts, state), case).select("split", "X", "Y").toPandas()

    def arrays(split):
        part = rows[rows.split == split]
        return np.array(part.X.tolist()), np.array(part.Y.tolist())

    (x, y), (xv, yv) = arrays("train"), arrays("val")
    mx, my = x.mean(axis=0), y.mean(axis=0)
    fits = []
    for penalty in (0.0, 0.01, 0.1, 1.0):
        c, d = x - mx, y - my
        gram = c.T @ c / len(x)
        live = np.diag(gram) > 1e-12
        w = np.zeros((x.shape[1], y.shape[1]))
        w[live] = np.linalg.lstsq(gram[np.ix_(live, live)] + penalty * np.eye(live.sum()), (c.T @ d / len(x))[live], rcond=None)[0]
        fits.append((((yv - (my + (xv - mx) @ w)) ** 2).mean(), w))
    _, w = min(fits, key=lambda f: f[0])
    scale = state.scaler.first()
    got = {(r.scenario, r.lead, r.country): r for r in all_queries()["scenario_linear"](spark, sf_dir).collect()}
    for level in (S.scenarios(("error",), SERIES, HISTORIES, LEAD)[i] for i in (0, 5, 8)):
        picked = S.select_rows(base, level)
        flat = S.level_windows(picked, [level], S.fit_cuts(picked), state).toPandas()
        forecast = my + (np.array(flat.X.tolist()) - mx) @ w
        error = (forecast - np.array(flat.Y.tolist())) * scale["std"]
        assert got[level.name, 0, "all"].mae == pytest.approx(np.abs(error).mean(), rel=1e-4)
        assert got[level.name, 3, "all"].mse == pytest.approx((error[:, 2] ** 2).mean(), rel=1e-4)
        assert got[level.name, 0, "all"].n == error.size

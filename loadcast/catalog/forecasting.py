"""Linear forecasts, external scoring, evaluation and scenarios."""

from __future__ import annotations

import numpy as np

from loadcast.catalog.storage import split_panel
from loadcast.catalog.tables import (
    IDX,
    LAG,
    LEAD,
    LEVEL,
    METRICS,
    OVERALL,
    SCALER,
    SEQ,
    SPLIT,
    VALUE,
    Registry,
    frame_sql,
    gauss_sql,
    hourly,
    r,
    windows_sql,
)
from loadcast.operators.linear import linear_fit, linear_predict, ridge_grid
from loadcast.operators.metrics import forecast_long
from loadcast.operators.scale import fit_scaler, scale_transform
from loadcast.operators.score import score_external
from loadcast.operators.windows import sequence_windows
from loadcast.plans.evaluate import evaluate, evaluate_quantiles
from loadcast.plans.scenario import (
    BASE_FEATURES,
    fit_cuts,
    fit_training_state,
    flat_dataset,
    flat_xy,
    run_panel_scenarios,
    run_scenarios,
    run_sequence_scenarios,
    scenarios,
    training_scenario,
)
from loadcast.session import scratch_path
from loadcast.sources.measurements import scan_measurements, write_base

REGISTRY = Registry()

PAIRS = (
    f"{IDX}, {windows_sql(1)}, pairs AS (SELECT country, datetime, time_idx, quantity_MW AS x, unnest(range(1, {LEAD + 1})) AS lead, unnest(ys) AS y FROM wins), "
    "fit AS (SELECT lead, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM pairs GROUP BY lead)"
)


def last_value_windows(spark, sf):
    return sequence_windows(hourly(spark, sf), [VALUE], [VALUE], 1, LEAD)


@REGISTRY.add("linear_fit", (
    f"WITH {PAIRS} SELECT lead::INTEGER AS lead, 0 AS feature, {r('b0', 'weight')} FROM fit UNION ALL SELECT lead::INTEGER, 1, {r('b1', 'weight')} FROM fit"
))
def _(spark, sf):
    return linear_fit(last_value_windows(spark, sf)).table(spark)


@REGISTRY.add("linear_predict", (
    f"WITH {PAIRS} SELECT country, datetime, time_idx, p.lead::INTEGER AS lead, {r('y', 'y_true')}, {r('b0 + b1 * x', 'y_pred')} FROM pairs p JOIN fit f ON f.lead = p.lead"
))
def _(spark, sf):
    windows = last_value_windows(spark, sf)
    scored = linear_predict(windows, linear_fit(windows))
    return forecast_long(scored, ["country", "datetime", "time_idx"])


TRAIN_MSE = r("avg(e) FILTER (split = 'train')", "train_mse")
VAL_MSE = r("avg(e) FILTER (split = 'val')", "val_mse")
PENALTIES = (0.0, 1.0, 100.0, 1000.0)


@REGISTRY.add("ridge_grid", (
    f"WITH {SPLIT}, {windows_sql(1, 'sidx', 'split, country')}, "
    f"pairs AS (SELECT split, quantity_MW AS x, unnest(range(1, {LEAD + 1})) AS lead, unnest(ys) AS y FROM wins), "
    f"pen AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in PENALTIES)}]) AS penalty), "
    "fit AS (SELECT penalty, lead, covar_pop(y, x) / (var_pop(x) + penalty) AS b1, avg(y) AS my, avg(x) AS mx FROM pairs CROSS JOIN pen WHERE split = 'train' GROUP BY penalty, lead), "
    "err AS (SELECT f.penalty, p.split, (p.y - (f.my + f.b1 * (p.x - f.mx))) ** 2 AS e FROM pairs p JOIN fit f ON f.lead = p.lead) "
    f"SELECT penalty, {TRAIN_MSE}, {VAL_MSE} FROM err GROUP BY penalty"
))
def _(spark, sf):
    windows = sequence_windows(split_panel(spark, sf), [VALUE], [VALUE], 1, LEAD, ["split", "country"])
    return ridge_grid(windows, PENALTIES)[2]


MEANS = (
    f"{IDX}, {windows_sql(SEQ)}, fc AS (SELECT country, datetime, time_idx, unnest(range(1, {LEAD + 1})) AS lead, "
    "unnest(ys) AS y_true, list_avg(xs) AS y_pred FROM wins)"
)


@REGISTRY.add("score_external", (
    f"WITH {MEANS} SELECT country, datetime, time_idx, lead::INTEGER AS lead, {r('y_true', 'y_true')}, {r('y_pred', 'y_pred')} FROM fc"
))
def _(spark, sf):
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], SEQ, LEAD)
    scored = score_external(windows, lambda x: x.mean(axis=1, keepdims=True).repeat(6, axis=1))
    return forecast_long(scored, ["country", "datetime", "time_idx"])


@REGISTRY.add("evaluate", f"WITH {MEANS} SELECT {LEVEL}, {METRICS} FROM fc GROUP BY GROUPING SETS ((), (lead), (country), (country, lead))")
def _(spark, sf):
    panel = hourly(spark, sf)
    state = fit_scaler(panel, [VALUE])
    windows = sequence_windows(scale_transform(panel, state, [VALUE]), [VALUE], [VALUE], SEQ, LEAD)
    return evaluate(windows, lambda x: x.mean(axis=1, keepdims=True).repeat(6, axis=1), state=state).fillna(OVERALL)


QUANTILES = (0.1, 0.5, 0.9)


def spread_forecast(given):
    """Mean of the window, and about it a band that widens with the lead."""
    x = given["X"]
    band = (x.max(axis=1) - x.min(axis=1))[:, None, None] * (1 + np.arange(1, 7) / 10)[None, :, None]
    return x.mean(axis=1)[:, None, None] + band * (np.array((0.1, 0.5, 0.9)) - 0.5)


@REGISTRY.add("evaluate_quantiles", (
    f"WITH {IDX}, {windows_sql(SEQ)}, steps AS (SELECT country, unnest(range(1, {LEAD + 1})) AS lead, unnest(ys) AS y_true, list_avg(xs) AS m, list_max(xs) - list_min(xs) AS band FROM wins), "
    f"fc AS (SELECT country, lead, y_true, quantile, m + band * (1 + lead / 10.0::DOUBLE) * (quantile - 0.5) AS y_pred FROM steps, (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in QUANTILES)}]) AS quantile)) "
    f"SELECT {LEVEL}, quantile, {METRICS}, {r('avg(greatest(quantile * (y_true - y_pred), (quantile - 1) * (y_true - y_pred)))', 'pinball')}, {r('avg((y_true <= y_pred)::INTEGER)', 'covered')} "
    "FROM fc GROUP BY GROUPING SETS ((quantile), (quantile, lead), (quantile, country), (quantile, country, lead))"
))
def _(spark, sf):
    panel = hourly(spark, sf)
    state = fit_scaler(panel, [VALUE])
    windows = sequence_windows(scale_transform(panel, state, [VALUE]), [VALUE], [VALUE], SEQ, LEAD)
    return evaluate_quantiles(windows, spread_forecast, QUANTILES, state=state).fillna(OVERALL)


HISTORIES = (8, 16, 24)
SERIES = ("click", "error", "purchase", "signup", "view")


def base_table(spark, sf):
    """The hourly panel as a written table, which every scenario then reads."""
    return scan_measurements(spark, write_base(hourly(spark, sf), scratch_path(spark, "base"), ["country"]))


def split_of(rows: str, name: str) -> str:
    return (
        f"{name}_n AS (SELECT *, row_number() OVER (ORDER BY datetime, country) AS rn, count(*) OVER () AS total FROM {rows}), "
        f"{name}_p AS (SELECT datetime, country, quantity_MW, noisy, rn > floor(total * 0.8::DOUBLE) + floor(total * 0.15::DOUBLE) AS is_test FROM {name}_n), "
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY datetime) - 1 AS time_idx, count(*) OVER (PARTITION BY country) AS n FROM {name}_p WHERE is_test)"
    )


ROW_KEY = "country || '|' || epoch(datetime)::BIGINT::VARCHAR || '|42'"


def scenario_sql() -> str:
    ctes = [
        SPLIT,
        SCALER,
        "spread AS (SELECT stddev_samp(quantity_MW) AS sd FROM hourly)",
        "clean1 AS (SELECT datetime, country, quantity_MW, quantity_MW AS noisy FROM hourly WHERE country = 'error')",
        "clean2 AS (SELECT datetime, country, quantity_MW, quantity_MW AS noisy FROM hourly)",
        f"noisy3 AS (SELECT datetime, country, quantity_MW, quantity_MW + 0.01::DOUBLE * sd * {gauss_sql(ROW_KEY)} AS noisy FROM hourly, spread)",
        split_of("clean1", "n1"),
        split_of("clean2", "n2"),
        split_of("noisy3", "n3"),
    ]
    parts = []
    for level in ("n1", "n2", "n3"):
        for letter, history in zip("ABC", HISTORIES):
            past = frame_sql("xs", f"{history} PRECEDING", "1 PRECEDING", value="noisy")
            ahead = frame_sql("ys", "1 FOLLOWING", f"{LEAD} FOLLOWING")
            parts.append(
                f"SELECT '{level.upper()}{letter}' AS scenario, country, unnest(range(1, {LEAD + 1})) AS lead, unnest(ys) AS y_true, "
                f"m + (list_sum(xs) - {history} * m) / {LAG} AS y_pred "
                f"FROM (SELECT *, {past}, {ahead} FROM {level}), scaler WHERE len(xs) = {history} AND len(ys) = {LEAD}"
            )
    return (
        f"WITH {', '.join(ctes)}, fc AS ({' UNION ALL '.join(parts)}) "
        f"SELECT scenario, {LEVEL}, {METRICS} FROM fc GROUP BY GROUPING SETS ((scenario), (scenario, lead), (scenario, country), (scenario, country, lead))"
    )


@REGISTRY.add("scenario", scenario_sql())
def _(spark, sf):
    base = base_table(spark, sf)
    state = fit_training_state(base, fit_cuts(base))
    first = len(BASE_FEATURES)
    cases = scenarios(("error",), SERIES, HISTORIES, LEAD)
    # Sum of the lags the scenario may see over the full width; hidden lags are 0 after scaling.
    return run_scenarios(base, cases, state, lambda x: (x[:, first:].sum(axis=1, keepdims=True) / 24).repeat(6, axis=1)).fillna(OVERALL)


CODES = (
    "codes AS (SELECT country, row_number() OVER (ORDER BY country) - 1 AS code FROM (SELECT DISTINCT country FROM parts WHERE split = 'train'))"
)


def input_scenario_sql(prediction: str) -> str:
    """As ``scenario_sql``, with windows up to the current row and a forecast made of ``xs``, ``hours``, ``time_idx`` and ``code``."""
    ctes = [
        SPLIT,
        SCALER,
        CODES,
        "spread AS (SELECT stddev_samp(quantity_MW) AS sd FROM hourly)",
        "clean1 AS (SELECT datetime, country, quantity_MW, quantity_MW AS noisy FROM hourly WHERE country = 'error')",
        "clean2 AS (SELECT datetime, country, quantity_MW, quantity_MW AS noisy FROM hourly)",
        f"noisy3 AS (SELECT datetime, country, quantity_MW, quantity_MW + 0.01::DOUBLE * sd * {gauss_sql(ROW_KEY)} AS noisy FROM hourly, spread)",
        split_of("clean1", "n1"),
        split_of("clean2", "n2"),
        split_of("noisy3", "n3"),
    ]
    parts = []
    for level in ("n1", "n2", "n3"):
        for letter, history in zip("ABC", HISTORIES):
            past = frame_sql("xs", f"{history - 1} PRECEDING", "CURRENT ROW", value="noisy")
            ahead = frame_sql("ys", "1 FOLLOWING", f"{LEAD} FOLLOWING")
            clock = frame_sql("hours", "1 FOLLOWING", f"{LEAD} FOLLOWING", value="hour(datetime)")
            parts.append(
                f"SELECT '{level.upper()}{letter}' AS scenario, country, code, s, time_idx, list_avg(xs) AS m, unnest(range(1, {LEAD + 1})) AS lead, "
                f"unnest(ys) AS y_true, unnest(hours) AS hour FROM (SELECT *, {past}, {ahead}, {clock} FROM {level}) JOIN codes USING (country), scaler "
                f"WHERE len(xs) = {history} AND len(ys) = {LEAD}"
            )
    return (
        f"WITH {', '.join(ctes)}, steps AS ({' UNION ALL '.join(parts)}), fc AS (SELECT scenario, country, lead, y_true, {prediction} AS y_pred FROM steps) "
        f"SELECT scenario, {LEVEL}, {METRICS} FROM fc GROUP BY GROUPING SETS ((scenario), (scenario, lead), (scenario, country), (scenario, country, lead))"
    )


def sequence_forecast(given):
    """Mean of the value, the second feature, over the steps shown, and a little for the code of the series."""
    return (given["X"][:, :, 1].mean(axis=1) + 0.01 * given["country_id"])[:, None].repeat(6, axis=1)


@REGISTRY.add("scenario_sequence", input_scenario_sql("m + 0.01 * code * s"))
def _(spark, sf):
    base = base_table(spark, sf)
    state = fit_training_state(base, fit_cuts(base))
    cases = scenarios(("error",), SERIES, HISTORIES, LEAD)
    return run_sequence_scenarios(base, cases, state, sequence_forecast).fillna(OVERALL)


def panel_forecast(given):
    """Something of each input: the encoder's mean, its last position, the hours to come and the code of the series."""
    known = given["encoder_target"].mean(axis=1) + 0.001 * given["encoder_known"][:, -1, 0] + 0.1 * given["static"][:, 0]
    return known[:, None] + 0.01 * given["decoder_known"][:, :, 4]


@REGISTRY.add("scenario_panel", input_scenario_sql("m + 0.001 * time_idx + 0.1 * code + 0.01 * hour"))
def _(spark, sf):
    base = base_table(spark, sf)
    state = fit_training_state(base, fit_cuts(base))
    cases = scenarios(("error",), SERIES, HISTORIES, LEAD)
    return run_panel_scenarios(base, cases, state, panel_forecast).fillna(OVERALL)


@REGISTRY.add("scenario_linear")
def _(spark, sf):
    base = base_table(spark, sf)
    cuts = fit_cuts(base)
    state = fit_training_state(base, cuts)
    training = training_scenario(SERIES, LAG, LEAD)
    model, _, _ = ridge_grid(flat_xy(flat_dataset(base, training, cuts, state), training), (0.0, 0.01, 0.1, 1.0))
    weights, intercept = model.weights, model.intercept
    cases = scenarios(("error",), SERIES, HISTORIES, LEAD)
    return run_scenarios(base, cases, state, lambda x: x @ weights + intercept).fillna(OVERALL)

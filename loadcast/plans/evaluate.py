"""From windows and a model to error tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import CYCLE_COLUMNS, time_cycle_decode
from loadcast.functions.noise import noise_array
from loadcast.operators.encode import label_decode
from loadcast.operators.metrics import forecast_long, forecast_wide, metrics_by, metrics_by_country, quantile_long
from loadcast.operators.scale import inverse_arrays, scale_inverse
from loadcast.operators.score import score_external, score_inputs
from loadcast.operators.windows import flat_arrays

Predict = Callable[[np.ndarray], np.ndarray]
PredictInputs = Callable[[dict[str, np.ndarray]], np.ndarray]


def naive_forecast(df: DataFrame, season: int, lead: int, x: str = "X") -> DataFrame:
    """``y_true`` and the seasonal repeat of a single-feature ``X`` as ``y_pred``."""
    repeat = F.array(*[F.get(x, F.size(x) - F.lit(season - (k % season))) for k in range(lead)])
    return df.withColumns({"y_true": F.col("Y"), "y_pred": repeat}).drop("X", "Y")


def forecasts(
    windows: DataFrame,
    predict: Predict | PredictInputs,
    state: DataFrame | None = None,
    base: str = "quantity_MW",
    dictionary: DataFrame | None = None,
    method: str = "standard",
    inputs: Mapping[str, int | None] | None = None,
) -> DataFrame:
    """Window keys with ``y_true`` and ``y_pred`` in original units and original labels. A model with several
    ``inputs`` gets them together (``score_inputs``)."""
    scored = score_inputs(windows, predict, inputs) if inputs else score_external(windows, predict)
    if state is not None:
        scored = inverse_arrays(scored, state, base, ["y_true", "y_pred"], method)
    if dictionary is not None:
        scored = label_decode(scored, dictionary, ["country"])
    return scored


def result_table(
    flat: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    predict: Predict,
    scaler: DataFrame,
    base: str = "quantity_MW",
    dictionary: DataFrame | None = None,
    method: str = "standard",
    time_col: str = "datetime",
    country: str = "country",
) -> DataFrame:
    """Rows of a flat split, as read back, with truth and prediction of every step, in original units.

    Scaled features are un-scaled, the time is decoded from the cycle columns and the year, the series from its
    code if a ``dictionary`` is given, and ``{base}_lead{k}_real`` and ``_pred`` are attached. Sorted by series and time.
    """
    kept = [c for c in flat.columns if c not in targets]
    packed = flat_arrays(flat.select(*[F.col(c).alias(f"_k_{c}") for c in kept], *flat.columns), features, targets)
    scored = score_external(packed.select(*[f"_k_{c}" for c in kept], "X", "Y"), predict)
    named = scored.withColumnsRenamed({f"_k_{c}": c for c in kept})
    plain = inverse_arrays(scale_inverse(named, scaler, [base], method), scaler, base, ["y_true", "y_pred"], method)
    decoded = time_cycle_decode(plain, time_col) if set(CYCLE_COLUMNS) <= set(kept) else plain
    if dictionary is not None:
        decoded = label_decode(decoded, dictionary, [country])
    shown = [c for c in decoded.columns if c not in {*CYCLE_COLUMNS, "year", "y_true", "y_pred"}]
    return forecast_wide(decoded, shown, base, len(targets)).orderBy(country, time_col)


def evaluate(windows: DataFrame, predict: Predict | PredictInputs, by: Sequence[str] = (), **options) -> DataFrame:
    """The five metrics overall, per step, per series, and per series and step, each per ``by``."""
    scored = forecasts(windows, predict, **options)
    return metrics_by_country(forecast_long(scored, [*by, "country"]), by=by)


def quantile_forecasts(
    windows: DataFrame,
    predict: PredictInputs,
    quantiles: Sequence[float],
    inputs: Mapping[str, int | None],
    state: DataFrame | None = None,
    base: str = "quantity_MW",
    dictionary: DataFrame | None = None,
    method: str = "standard",
) -> DataFrame:
    """Window keys with ``y_true``, an array per window, and ``y_pred``, an array of quantiles per lead, in original units and labels."""
    n = len(quantiles)
    scored = score_inputs(windows, predict, inputs, quantiles=n)
    if state is not None:
        flat = scored.withColumn("y_pred", F.flatten("y_pred"))
        plain = inverse_arrays(flat, state, base, ["y_true", "y_pred"], method)
        leads = (F.size("y_pred") / n).cast("int")
        steps = F.transform(F.sequence(F.lit(0), leads - 1), lambda i: F.slice("y_pred", i * n + 1, F.lit(n)))
        scored = plain.withColumn("y_pred", F.when(leads > 0, steps))
    if dictionary is not None:
        scored = label_decode(scored, dictionary, ["country"])
    return scored


def evaluate_quantiles(
    windows: DataFrame, predict: PredictInputs, quantiles: Sequence[float], inputs: Mapping[str, int | None] | None = None, by: Sequence[str] = (), **options
) -> DataFrame:
    """The five metrics, the quantile loss and the share of truths covered, per quantile: overall, per step, per series, and per
    series and step, each per ``by``. ``predict`` returns (rows, leads, quantiles)."""
    scored = quantile_forecasts(windows, predict, quantiles, inputs or {"X": None}, **options)
    long = quantile_long(scored, [*by, "country"], quantiles)
    return metrics_by(long, [[], ["lead"], ["country"], ["country", "lead"]], by, quantile="quantile")


def noise_degradation(
    windows: DataFrame,
    predict: Predict,
    sigmas: Sequence[float],
    key: Column,
    seed: int = 42,
    sentinel: float | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The five metrics per noise level; noise goes on ``X`` only, the truth stays as it is.

    The noise of an element is drawn once and scaled for every level. Every row is scored once per level inside
    its task; only partial sums are shuffled.
    """
    draws = noise_array(F.transform("X", lambda _: F.lit(0.0)), key, 1.0, seed)
    levels = windows.withColumn("_z", draws).select(
        *keep, "X", "Y", "_z", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])).alias("sigma")
    )

    def moved(x: Column, z: Column) -> Column:
        noisy = x + F.col("sigma") * z
        return noisy if sentinel is None else F.when(x == F.lit(sentinel), x).otherwise(noisy)

    noisy = levels.withColumn("X", F.zip_with("X", "_z", moved))
    scored = score_external(noisy.select(*keep, "sigma", "X", "Y"), predict)
    return metrics_by(forecast_long(scored, [*keep, "sigma"]), [[]], [*keep, "sigma"])

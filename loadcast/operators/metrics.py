"""Forecast tables and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.columns import null_safe, quoted


def attach_forecast(
    features: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("country", "time_idx")
) -> DataFrame:
    """Feature rows with their truth and prediction, matched by series (NULL too) and position."""
    extra = [c for c in forecast.columns if c not in features.columns or c in keys]
    return null_safe(features, forecast.select(*extra), list(keys))


def forecast_long(
    df: DataFrame, keep: Sequence[str], truth: str = "y_true", prediction: str = "y_pred"
) -> DataFrame:
    """One row per forecast step: ``keep``, ``lead`` from 1, ``y_true``, ``y_pred``."""
    steps = F.arrays_zip(F.col(truth).alias("t"), F.col(prediction).alias("p"))
    exploded = df.select(*keep, F.posexplode(steps).alias("_i", "_s"))
    return exploded.select(
        *keep,
        (F.col("_i") + 1).alias("lead"),
        number(F.col("_s.t").cast("double")).alias("y_true"),
        number(F.col("_s.p").cast("double")).alias("y_pred"),
    )


def number(value: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(value), value)


def forecast_wide(
    df: DataFrame, keep: Sequence[str], target: str, leads: int, truth: str = "real"
) -> DataFrame:
    """Arrays as columns ``{target}_lead{k}_real`` and ``{target}_lead{k}_pred``."""
    steps = range(1, leads + 1)
    return df.selectExpr(
        *map(quoted, keep),
        *[f"get(y_true, {k - 1}) AS {quoted(f'{target}_lead{k}_{truth}')}" for k in steps],
        *[f"get(y_pred, {k - 1}) AS {quoted(f'{target}_lead{k}_pred')}" for k in steps],
    )


def quantile_long(
    df: DataFrame, keep: Sequence[str], quantiles: Sequence[float], truth: str = "y_true", prediction: str = "y_pred"
) -> DataFrame:
    """One row per forecast step and quantile: ``keep``, ``lead`` from 1, ``quantile``, ``y_true``, ``y_pred``. The prediction is an
    array per lead with a value per quantile."""
    levels = F.array(*[F.lit(float(q)) for q in quantiles])
    steps = F.arrays_zip(F.col(truth).alias("t"), F.col(prediction).alias("p"))
    by_lead = df.select(*keep, F.posexplode(steps).alias("_i", "_s"))
    pairs = F.arrays_zip(levels.alias("q"), F.col("_s.p").alias("p"))
    spread = by_lead.select(*keep, "_i", F.col("_s.t").alias("_t"), F.explode(pairs).alias("_q"))
    return spread.select(
        *keep,
        (F.col("_i") + 1).alias("lead"),
        F.col("_q.q").alias("quantile"),
        number(F.col("_t").cast("double")).alias("y_true"),
        number(F.col("_q.p").cast("double")).alias("y_pred"),
    )


def _quantile_metrics(quantile: str) -> dict[str, Column]:
    """Mean quantile loss, and the share of truths at or below the forecast, which a calibrated model has near the quantile."""
    t, p, q = number(F.col("y_true")), number(F.col("y_pred")), F.col(quantile)
    return {"pinball": F.avg(F.greatest(q * (t - p), (q - 1) * (t - p))), "covered": F.avg((t <= p).cast("double"))}


def _metrics() -> dict[str, Column]:
    """The metrics of a group as aggregates. Variances are those of Spark, which merges centred moments of tasks."""
    t, p = number(F.col("y_true")), number(F.col("y_pred"))
    both = t.isNotNull() & p.isNotNull()
    t, p = F.when(both, t), F.when(both, p)
    vt = F.when(F.min(t) < F.max(t), F.var_pop(t))
    vp = F.when(F.min(p) < F.max(p), F.var_pop(p))
    mse = F.avg((p - t) * (p - t))
    return {
        "n": F.count(t),
        "mae": F.avg(F.abs(p - t)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "correlacao_pearson": F.covar_pop(t, p) / (F.sqrt(vt) * F.sqrt(vp)),
        "r2": 1 - mse / vt,
    }


def metrics_by(
    long: DataFrame, sets: Sequence[Sequence[str]], fixed: Sequence[str] = (), quantile: str | None = None
) -> DataFrame:
    """The five metrics for several grouping sets from one pass over the forecast rows and one shuffle.

    Tasks reduce their rows to one row of centred moments per group of each set, which are merged after the
    shuffle, so no digits are lost to the size of the values. Columns that a set does not use are NULL. Steps with a
    NULL or NaN do not count; constant truth or prediction gives NULL for correlation and R². ``quantile`` names a column
    of quantiles, which is a key of every set and adds ``pinball`` and ``covered``.
    """
    fixed = [*fixed, quantile] if quantile else fixed
    finest = list(dict.fromkeys([*fixed, *[c for s in sets for c in s]]))
    wanted = [[c for c in finest if c in {*fixed, *s}] for s in sets]
    metrics = [v.alias(k) for k, v in (_metrics() | (_quantile_metrics(quantile) if quantile else {})).items()]
    if len(wanted) == 1:
        return long.groupBy(*finest).agg(*metrics)
    return long.groupingSets([[F.col(c) for c in s] for s in wanted], *[F.col(c) for c in finest]).agg(*metrics)


def metrics_global(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, Pearson correlation and R² over all steps."""
    return metrics_by(long, [[]], by) if by else metrics_by(long, [[]])


def metrics_per_lead(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The five metrics for every forecast step."""
    return metrics_by(long, [["lead"]], by)


def metrics_by_country(long: DataFrame, country: str = "country", by: Sequence[str] = ()) -> DataFrame:
    """Overall, per step, per series, and per series and step."""
    return metrics_by(long, [[], ["lead"], [country], [country, "lead"]], by)


def rank_models(long: DataFrame, top: int | None = None, model: str = "model") -> DataFrame:
    """Models by rising MAE; the first ``top`` of them."""
    ranked = metrics_by(long, [[model]]).orderBy("mae", model)
    return ranked.limit(top) if top else ranked


def mape(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error relative to the truth; steps with truth 0 do not count."""
    ratio = number(F.abs(F.col("y_pred") - F.col("y_true")) / F.nullif(F.abs("y_true"), F.lit(0.0)))
    return long.groupBy(*by).agg(F.avg(ratio).alias("mape"))


def pinball_loss(
    long: DataFrame, quantile: str = "quantile", by: Sequence[str] = ()
) -> DataFrame:
    """Mean quantile loss per quantile; ``y_pred`` is the forecast of that quantile."""
    q, e = F.col(quantile), F.col("y_true") - F.col("y_pred")
    loss = number(F.greatest(q * e, (q - 1) * e))
    return long.groupBy(*by, quantile).agg(F.avg(loss).alias("pinball"))

"""Fitted statistics, error metrics and autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast.catalog.storage import split_panel
from loadcast.catalog.tables import (
    BOTH,
    IDX,
    LEAD,
    LEVEL,
    METRICS,
    NAIVE,
    OVERALL,
    SEQ,
    SPLIT,
    VALUE,
    Registry,
    both,
    frame_sql,
    gauss_sql,
    hourly,
    naive,
    r,
    table,
    windows_sql,
)
from loadcast.operators.autocorr import acf, pacf
from loadcast.operators.encode import label_fit
from loadcast.operators.metrics import (
    forecast_long,
    mape,
    metrics_by_country,
    metrics_global,
    metrics_per_lead,
    pinball_loss,
    rank_models,
)
from loadcast.operators.scale import column_std, fit_scaler
from loadcast.operators.split import split_keep
from loadcast.operators.windows import sequence_windows
from loadcast.plans.evaluate import noise_degradation
from loadcast.sources.datasets import group_profile

REGISTRY = Registry()
LAGS = 60


@REGISTRY.add("scaler_fit_standard", (
    f"WITH {SPLIT} SELECT 'quantity_MW' AS col, {r('avg(quantity_MW)', 'mean')}, {r('stddev_pop(quantity_MW)', 'std')} FROM parts WHERE split = 'train'"
))
def _(spark, sf):
    return fit_scaler(split_keep(split_panel(spark, sf), ["train"]), [VALUE]).select("col", "mean", "std")


@REGISTRY.add("scaler_fit_minmax", (
    "SELECT 'l_quantity' AS col, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem "
    "UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem "
    "UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem"
))
def _(spark, sf):
    items = table(spark, sf, "lineitem")
    return fit_scaler(items, ["l_quantity", "l_extendedprice", "l_discount"]).select("col", "min", "max")


@REGISTRY.add("scaler_fit_group", (
    f"WITH {BOTH} SELECT 'quantity_MW' AS col, country AS group, {r('avg(quantity_MW)', 'mean')}, {r('stddev_pop(quantity_MW)', 'std')}, "
    f"{r('min(quantity_MW)', 'min')}, {r('max(quantity_MW)', 'max')} FROM both_raw GROUP BY country"
).replace("AS group", 'AS "group"'))
def _(spark, sf):
    return fit_scaler(both(spark, sf), [VALUE], ["country"])


@REGISTRY.add("label_fit", (
    f"WITH {BOTH}, pairs AS (SELECT DISTINCT 'country' AS col, country AS label FROM both_raw UNION SELECT DISTINCT 'year', year(datetime)::VARCHAR FROM both_raw), "
    "coded AS (SELECT col, label, (row_number() OVER (PARTITION BY col ORDER BY label) - 1)::INTEGER AS code FROM pairs) "
    "SELECT * FROM coded UNION ALL SELECT col, '__unknown__', (max(code) + 1)::INTEGER FROM coded GROUP BY col"
))
def _(spark, sf):
    return label_fit(both(spark, sf).withColumn("year", F.year("datetime")), ["country", "year"])


@REGISTRY.add("column_std", f"SELECT {r('stddev_samp(o_totalprice)', 'o_totalprice')}, {r('stddev_samp(o_custkey)', 'o_custkey')} FROM orders")
def _(spark, sf):
    return column_std(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@REGISTRY.add("group_profile", (
    f"WITH {BOTH} SELECT year(datetime)::INTEGER AS year, count(*)::BIGINT AS rows, count(DISTINCT country) AS groups, min(datetime) AS min_time, max(datetime) AS max_time "
    "FROM both_raw GROUP BY 1"
))
def _(spark, sf):
    return group_profile(both(spark, sf).withColumn("year", F.year("datetime")), ["country"], by=["year"])


@REGISTRY.add("distinct_countries", f"WITH {BOTH} SELECT DISTINCT country FROM both_raw WHERE country IS NOT NULL ORDER BY country")
def _(spark, sf):
    return both(spark, sf).select("country").where(F.col("country").isNotNull()).distinct().orderBy("country")


@REGISTRY.add("metrics_global", f"WITH {NAIVE} SELECT {METRICS} FROM fc")
def _(spark, sf):
    return metrics_global(forecast_long(naive(spark, sf), ["country"]))


@REGISTRY.add("metrics_per_lead", f"WITH {NAIVE} SELECT lead::INTEGER AS lead, {METRICS} FROM fc GROUP BY lead")
def _(spark, sf):
    return metrics_per_lead(forecast_long(naive(spark, sf), ["country"]))


@REGISTRY.add("metrics_by_country", (
    f"WITH {NAIVE} SELECT {LEVEL}, {METRICS} FROM fc GROUP BY GROUPING SETS ((), (lead), (country), (country, lead))"
))
def _(spark, sf):
    return metrics_by_country(forecast_long(naive(spark, sf), ["country"])).fillna(OVERALL)


SIGMAS = (0.0, 0.01, 0.03, 0.05, 0.1)
NOISY_KEY = "country || '|' || epoch(datetime)::BIGINT::VARCHAR || '#' || i::VARCHAR || '|42'"


@REGISTRY.add("noise_degradation", (
    f"WITH {IDX}, {windows_sql(SEQ)}, "
    f"steps AS (SELECT country, datetime, time_idx, ys, unnest(range(0, {SEQ})) AS i, unnest(xs) AS x FROM wins), "
    f"drawn AS (SELECT country, time_idx, ys, avg(x) AS x, avg({gauss_sql(NOISY_KEY)}) AS z FROM steps GROUP BY ALL), "
    f"levels AS (SELECT *, unnest([{', '.join(f'{s}::DOUBLE' for s in SIGMAS)}]) AS sigma FROM drawn), "
    "pairs AS (SELECT sigma, unnest(ys) AS y_true, x + sigma * z AS y_pred FROM levels) "
    f"SELECT {r('pairs.sigma', 'sigma')}, {METRICS} FROM pairs GROUP BY pairs.sigma"
))
def _(spark, sf):
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], SEQ, LEAD)
    key = F.concat_ws("|", "country", F.unix_seconds("datetime").cast("string"))

    def mean_of_history(x):
        return x.mean(axis=1, keepdims=True).repeat(6, axis=1)

    return noise_degradation(windows, mean_of_history, SIGMAS, key)


@REGISTRY.add("mape", f"WITH {NAIVE} SELECT lead::INTEGER AS lead, {r('avg(abs(y_pred - y_true) / nullif(abs(y_true), 0))', 'mape')} FROM fc GROUP BY lead")
def _(spark, sf):
    return mape(forecast_long(naive(spark, sf), ["country"]), ["lead"])


@REGISTRY.add("pinball_loss", (
    f"WITH {NAIVE}, q AS (SELECT * FROM (VALUES (0.1::DOUBLE, 0.5::DOUBLE), (0.5::DOUBLE, 1::DOUBLE), (0.9::DOUBLE, 1.5::DOUBLE)) v(quantile, factor)), "
    "e AS (SELECT country, quantile, y_true - y_pred * factor AS e FROM fc CROSS JOIN q) "
    f"SELECT country, quantile, {r('avg(greatest(quantile * e, (quantile - 1) * e))', 'pinball')} FROM e GROUP BY country, quantile"
))
def _(spark, sf):
    long = forecast_long(naive(spark, sf), ["country"])
    levels = F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(f).alias("factor")) for q, f in ((0.1, 0.5), (0.5, 1.0), (0.9, 1.5))])
    quantiles = long.select("*", F.inline(levels)).withColumn("y_pred", F.col("y_pred") * F.col("factor"))
    return pinball_loss(quantiles, by=["country"])


ACF = (
    f"{IDX}, c AS (SELECT country, datetime, n, quantity_MW - avg(quantity_MW) OVER (PARTITION BY country) AS x FROM idx), "
    f"h AS (SELECT country, n, x, {frame_sql('xs', f'{LAGS} PRECEDING', 'CURRENT ROW', value='x')} FROM c), "
    "e AS (SELECT country, n, x, unnest(list_reverse(xs)) AS y, unnest(range(0, len(xs))) AS lag FROM h), "
    "p AS (SELECT country, lag, n, sum(x * y) AS s FROM e GROUP BY ALL), "
    "q AS (SELECT country, lag, n, s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY country) AS v FROM p)"
)


@REGISTRY.add("acf", (
    f"WITH {ACF}, b AS (SELECT *, coalesce(sum(CASE WHEN lag > 0 THEN v * v END) OVER (PARTITION BY country ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sq FROM q) "
    f"SELECT country, lag::INTEGER AS lag, {r('v', 'acf')}, {r('CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054::DOUBLE * sqrt((1 + 2 * sq) / n) END', 'band')}, n FROM b"
))
def _(spark, sf):
    return acf(hourly(spark, sf), LAGS)


@REGISTRY.add("pacf", (
    f"WITH RECURSIVE {ACF}, rs AS (SELECT country, n, list(v ORDER BY lag) AS rr FROM q GROUP BY country, n), "
    "d AS (SELECT country, n, rr, 1 AS k, [rr[2]] AS phi, rr[2] AS last FROM rs UNION ALL "
    "SELECT country, n, rr, k + 1, list_concat(list_transform(range(1, k + 1), lambda i: phi[i] - nw * phi[k + 1 - i]), [nw]), nw FROM "
    "(SELECT *, (rr[k + 2] - list_inner_product(phi, list_reverse(rr[2:k + 1]))) / (1 - list_inner_product(phi, rr[2:k + 1])) AS nw FROM d "
    f"WHERE k < {LAGS} AND k + 2 <= len(rr))) "
    f"SELECT country, k::INTEGER AS lag, {r('last', 'pacf')}, {r('1.959963984540054::DOUBLE / sqrt(n)', 'band')} FROM d "
    "UNION ALL SELECT country, 0, 1::DOUBLE, 0::DOUBLE FROM rs"
))
def _(spark, sf):
    return pacf(hourly(spark, sf), LAGS)


@REGISTRY.add("rank_models", (
    f"WITH {NAIVE}, models AS (SELECT 'day_before' AS model, y_true, y_pred FROM fc UNION ALL SELECT 'last_value', y_true, last_value FROM fc "
    "UNION ALL SELECT 'half', y_true, y_pred / 2 FROM fc) "
    f"SELECT model, {METRICS} FROM models GROUP BY model ORDER BY avg(abs(y_pred - y_true)) LIMIT 2"
))
def _(spark, sf):
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], 24, LEAD)
    day_before = F.transform(F.sequence(F.lit(0), F.lit(LEAD - 1)), lambda k: F.get("X", k))
    forecasts = {
        "day_before": day_before,
        "last_value": F.array_repeat(F.get("X", F.lit(23)), LEAD),
        "half": F.transform(day_before, lambda v: v / 2),
    }
    models = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("y_pred")) for m, p in forecasts.items()])
    scored = windows.select(F.col("Y").alias("y_true"), F.inline(models))
    return rank_models(forecast_long(scored, ["model"]), 2)

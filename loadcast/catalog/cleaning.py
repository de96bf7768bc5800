"""Filters, projections, joins and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast.catalog.storage import HOURLY_ROWS, split_panel
from loadcast.catalog.tables import (
    BOTH,
    HOURLY,
    LEAD,
    NAIVE,
    EVENT_KEY,
    RAW,
    SCALER,
    SEQ,
    SPLIT,
    VALUE,
    Registry,
    both,
    gauss_sql,
    hourly,
    naive,
    r,
    raw,
    table,
)
from loadcast.functions.columns import (
    feature_target_lists,
    noise_rename,
    numeric_only,
    select_columns,
)
from loadcast.functions.noise import add_noise
from loadcast.operators.clean import dedup_first, drop_bad_time, ffill, hourly_first, hourly_grid
from loadcast.operators.encode import label_encode, label_fit
from loadcast.operators.metrics import attach_forecast, forecast_long
from loadcast.operators.scale import fit_scaler, scale_transform
from loadcast.operators.split import split_keep
from loadcast.operators.windows import (
    drop_incomplete,
    last_step_features,
    lag_lead,
    min_length_groups,
    sequence_windows,
)
from loadcast.sources.measurements import filter_countries

REGISTRY = Registry()


@REGISTRY.add("filter_countries", f"WITH {BOTH} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, key FROM both_raw WHERE country IN ('error', '1-URGENT')")
def _(spark, sf):
    return filter_countries(both(spark, sf), ["error", "1-URGENT"])


@REGISTRY.add("select_columns", f"SELECT event_type, ts, {r('value', 'value')} FROM events")
def _(spark, sf):
    return select_columns(table(spark, sf, "events"), ["event_type", "ts", "absent", "event_type"], ["value"])


@REGISTRY.add("numeric_only", f"SELECT o_orderkey, {r('o_totalprice', 'o_totalprice')} FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(numeric_only(orders, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]))


@REGISTRY.add("feature_target_lists", f"SELECT o_orderkey, o_custkey, {r('o_totalprice', 'o_totalprice')} FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    features, targets = feature_target_lists(
        orders, ["o_orderkey", "o_totalprice", "o_custkey", "o_orderkey", "o_orderstatus"], ["o_totalprice"]
    )
    return orders.select(*features, *targets)


@REGISTRY.add("drop_bad_time", f"SELECT event_id, date_trunc('second', ts) AS datetime, {r('value', 'value')} FROM events WHERE value >= 10")
def _(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("value") < 10, F.col("props")).otherwise(stamp)
    events = table(spark, sf, "events").select("event_id", text.alias("datetime"), "value")
    return drop_bad_time(events)


@REGISTRY.add("drop_incomplete", (
    f"WITH {HOURLY}, spans AS (SELECT country, min(datetime) AS lo, max(datetime) AS hi FROM hourly GROUP BY country), "
    "grid AS (SELECT country, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime FROM spans), "
    "filled AS (SELECT g.datetime, g.country, h.quantity_MW FROM grid g LEFT JOIN hourly h USING (country, datetime)), "
    "wide AS (SELECT *, lag(quantity_MW, 1) OVER w AS l1, lag(quantity_MW, 2) OVER w AS l2, lead(quantity_MW, 1) OVER w AS d1 "
    "FROM filled WINDOW w AS (PARTITION BY country ORDER BY datetime)) "
    f"SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, {r('l1', 'quantity_MW_lag1')}, {r('l2', 'quantity_MW_lag2')}, {r('d1', 'quantity_MW_lead1')} "
    "FROM wide WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND d1 IS NOT NULL"
))
def _(spark, sf):
    grid = hourly_grid(hourly(spark, sf))
    wide = lag_lead(grid, [VALUE], [VALUE], [1, 2], [1]).drop("time_idx")
    return drop_incomplete(wide, ["quantity_MW_lag1", "quantity_MW_lag2", "quantity_MW_lead1"])


@REGISTRY.add("min_length_groups", (
    f"WITH {HOURLY}, counted AS (SELECT *, strftime(datetime, '%Y-%m-%d') AS day, count(*) OVER (PARTITION BY country, date_trunc('day', datetime)) AS n FROM hourly) "
    f"SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, day FROM counted WHERE n >= {SEQ + LEAD}"
))
def _(spark, sf):
    rows = hourly(spark, sf).withColumn("day", F.date_format("datetime", "yyyy-MM-dd"))
    return min_length_groups(rows, SEQ + LEAD, ["country", "day"])


@REGISTRY.add("noise_rename", (
    f"WITH {RAW}, spread AS (SELECT stddev_samp(quantity_MW) AS s FROM raw) "
    f"SELECT datetime, country, {r('quantity_MW + 0.01::DOUBLE * s * ' + gauss_sql(EVENT_KEY), 'quantity_MW')}, event_id FROM raw, spread"
))
def _(spark, sf):
    rows = raw(spark, sf)
    spread = rows.agg(F.stddev_samp(VALUE)).first()[0]
    return noise_rename(rows.withColumn("quantity_MW_noise", add_noise(F.col(VALUE), F.col("event_id"), 0.01 * spread, 42)))


@REGISTRY.add("union_days", f"WITH {BOTH} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, key FROM both_raw")
def _(spark, sf):
    return both(spark, sf)


@REGISTRY.add("attach_forecast", (
    f"WITH {NAIVE} SELECT country, time_idx, datetime, {r('last_value', 'last_value')}, lead::INTEGER AS lead, "
    f"{r('y_true', 'y_true')}, {r('y_pred', 'y_pred')} FROM fc"
))
def _(spark, sf):
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], SEQ, LEAD)
    features = windows.select(
        "country", "time_idx", "datetime", F.get(last_step_features("X", 1), F.lit(0)).alias("last_value")
    )
    joined = attach_forecast(features, naive(spark, sf).drop("datetime"))
    return forecast_long(joined, ["country", "time_idx", "datetime", "last_value"])


@REGISTRY.add("apply_state", (
    f"WITH {SPLIT}, {SCALER}, codes AS (SELECT country AS label, (row_number() OVER (ORDER BY country) - 1)::INTEGER AS code FROM (SELECT DISTINCT country FROM parts WHERE split = 'train')) "
    f"SELECT datetime, code AS country, {r('(quantity_MW - m) / s', 'quantity_MW')}, split FROM parts JOIN codes ON label = country, scaler"
))
def _(spark, sf):
    panel = split_panel(spark, sf)
    train = split_keep(panel, ["train"])
    coded = label_encode(panel, label_fit(train, ["country"]), ["country"])
    return scale_transform(coded, fit_scaler(train, [VALUE]), [VALUE])


@REGISTRY.add("dedup_first", f"WITH {BOTH} SELECT datetime, country, {r('first(quantity_MW ORDER BY key)', 'quantity_MW')} FROM both_raw WHERE quantity_MW IS NOT NULL GROUP BY datetime, country")
def _(spark, sf):
    return dedup_first(both(spark, sf), ["key"])


@REGISTRY.add("hourly_first", HOURLY_ROWS)
def _(spark, sf):
    return hourly_first(raw(spark, sf), ["event_id"])


GRID = (
    f"{HOURLY}, spans AS (SELECT country, min(datetime) AS lo, max(datetime) AS hi FROM hourly GROUP BY country), "
    "grid AS (SELECT g.datetime, g.country, h.quantity_MW FROM (SELECT country, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime FROM spans) g "
    "LEFT JOIN hourly h USING (country, datetime))"
)


@REGISTRY.add("hourly_grid", f"WITH {GRID} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')} FROM grid")
def _(spark, sf):
    return hourly_grid(hourly(spark, sf))


@REGISTRY.add("ffill", (
    f"WITH {GRID} SELECT datetime, country, {r('last_value(quantity_MW IGNORE NULLS) OVER (PARTITION BY country ORDER BY datetime ROWS UNBOUNDED PRECEDING)', 'quantity_MW')} FROM grid"
))
def _(spark, sf):
    return ffill(hourly_grid(hourly(spark, sf)))

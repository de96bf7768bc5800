"""Sorts, splits, samples and limits."""

from __future__ import annotations

from loadcast.catalog.storage import split_panel
from loadcast.catalog.tables import (
    EVENT_KEY,
    HOURLY,
    NAIVE,
    ORDERS,
    RAW,
    SPLIT,
    VALUE,
    Registry,
    hash_sql,
    hourly,
    naive,
    order_readings,
    r,
    raw,
)
from loadcast.operators.metrics import forecast_long
from loadcast.operators.sample import sample_per_group, shuffle_batches
from loadcast.operators.split import head_fraction, max_samples, split_calendar

REGISTRY = Registry()


@REGISTRY.add("sort_panel", f"WITH {HOURLY} SELECT country, datetime, {r('quantity_MW', 'quantity_MW')} FROM hourly ORDER BY country, datetime")
def _(spark, sf):
    return hourly(spark, sf).select("country", "datetime", VALUE).orderBy("country", "datetime")


@REGISTRY.add("sort_result", (
    f"WITH {NAIVE} SELECT datetime, country, lead::INTEGER AS lead, {r('y_true', 'y_true')}, {r('y_pred', 'y_pred')} FROM fc ORDER BY datetime, country, lead"
))
def _(spark, sf):
    return forecast_long(naive(spark, sf), ["datetime", "country"]).orderBy("datetime", "country", "lead")


@REGISTRY.add("split_fraction", f"WITH {SPLIT} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, split FROM parts")
def _(spark, sf):
    return split_panel(spark, sf)


@REGISTRY.add("split_calendar", (
    f"WITH {ORDERS} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, o_orderkey, CASE WHEN datetime < TIMESTAMP '2000-01-01' THEN 'train' "
    "WHEN datetime < TIMESTAMP '2001-01-01' THEN 'val' ELSE 'test' END AS split FROM orders_raw"
))
def _(spark, sf):
    return split_calendar(order_readings(spark, sf), "2000-01-01", "2001-01-01")


@REGISTRY.add("head_fraction", (
    f"WITH {ORDERS}, n AS (SELECT *, row_number() OVER (ORDER BY datetime, o_orderkey) AS rn, count(*) OVER () AS total FROM orders_raw) "
    f"SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, o_orderkey FROM n WHERE rn <= floor(total * 0.2::DOUBLE)"
))
def _(spark, sf):
    return head_fraction(order_readings(spark, sf), 0.2, order=["o_orderkey"])


@REGISTRY.add("sample_per_country", (
    f"WITH {RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {hash_sql(EVENT_KEY)}, event_id) AS rn, count(*) OVER (PARTITION BY country) AS total FROM raw) "
    f"SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, event_id FROM n WHERE rn <= round_even(total * 0.2::DOUBLE, 0)"
))
def _(spark, sf):
    return sample_per_group(raw(spark, sf), 0.2, ["event_id"])


@REGISTRY.add("max_samples", (
    f"WITH {NAIVE}, n AS (SELECT country, datetime, lead, y_true, y_pred, dense_rank() OVER (ORDER BY datetime, country) AS rn FROM fc) "
    f"SELECT country, datetime, lead::INTEGER AS lead, {r('y_true', 'y_true')}, {r('y_pred', 'y_pred')} FROM n WHERE rn <= 500"
))
def _(spark, sf):
    first = max_samples(naive(spark, sf), 500, order=["country"])
    return forecast_long(first, ["country", "datetime"])


@REGISTRY.add("shuffle_batches", (
    f"WITH {RAW}, n AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(EVENT_KEY)}, event_id) - 1 AS shuffle_rank FROM raw) "
    f"SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, event_id, shuffle_rank, shuffle_rank // 256 AS batch_id FROM n"
))
def _(spark, sf):
    return shuffle_batches(raw(spark, sf), 256, ["event_id"])

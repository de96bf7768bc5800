"""Scalar functions, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast.catalog.storage import split_panel
from loadcast.catalog.tables import (
    BOTH,
    EVENT_KEY,
    IDX,
    LAG,
    LEAD,
    RAW,
    SCALER,
    SEQ,
    SPLIT,
    VALUE,
    Registry,
    both,
    columns,
    gauss_sql,
    hourly,
    lag_sql,
    lead_sql,
    r,
    raw,
    table,
    windows_sql,
)
from loadcast.functions.clock import (
    CYCLE_COLUMNS,
    CYCLES,
    floor_hour,
    period_format,
    point_time,
    resolution_minutes,
    time_cycle,
    time_cycle_decode,
    time_parts,
)
from loadcast.functions.columns import group_id
from loadcast.functions.noise import add_noise, noise_array
from loadcast.operators.encode import label_decode, label_encode, label_fit
from loadcast.operators.scale import fit_scaler, scale_inverse, scale_transform
from loadcast.operators.split import split_keep
from loadcast.operators.windows import lag_lead, sequence_windows

REGISTRY = Registry()
KEYS = "datetime, country, key"
ALL = f"{KEYS}, {r('quantity_MW', 'quantity_MW')}"
SQL_PART = {"month": "month", "day": "day", "hour": "hour", "minute": "minute"}


@REGISTRY.add("time_cycle", (
    f"WITH {BOTH} SELECT {ALL}, "
    + columns([r(f"{fn}(2 * pi() * ({SQL_PART[p]}(datetime) - 1) / {n})", f"{p}_{fn}") for p, n in CYCLES.items() for fn in ("sin", "cos")])
    + ", year(datetime)::INTEGER AS year FROM both_raw"
))
def _(spark, sf):
    return time_cycle(both(spark, sf))


@REGISTRY.add("time_parts", (
    f"WITH {BOTH} SELECT {ALL}, year(datetime)::INTEGER AS year, "
    + columns([f"{p}(datetime)::SMALLINT AS {p}" for p in CYCLES])
    + " FROM both_raw"
))
def _(spark, sf):
    return time_parts(both(spark, sf))


@REGISTRY.add("time_cycle_decode", f"WITH {BOTH} SELECT country, key, date_trunc('minute', datetime) AS datetime FROM both_raw")
def _(spark, sf):
    encoded = time_cycle(both(spark, sf)).drop("datetime", VALUE)
    stored = encoded.withColumns({c: F.col(c).cast("float") for c in CYCLE_COLUMNS})
    return time_cycle_decode(stored).select("country", "key", "datetime")


CODES = (
    f"{BOTH}, labels AS (SELECT DISTINCT country AS label FROM both_raw WHERE year(datetime) < 2000), "
    "codes AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS code FROM labels)"
)


def fitted_before_2000(spark, sf):
    rows = both(spark, sf)
    return rows, label_fit(rows.where(F.year("datetime") < 2000), ["country"])


@REGISTRY.add("label_encode", (
    f"WITH {CODES} SELECT datetime, {r('quantity_MW', 'quantity_MW')}, key, "
    "coalesce(code, (SELECT count(*) FROM codes))::INTEGER AS country FROM both_raw LEFT JOIN codes ON label = country"
))
def _(spark, sf):
    rows, dictionary = fitted_before_2000(spark, sf)
    return label_encode(rows, dictionary, ["country"])


@REGISTRY.add("label_decode", (
    f"WITH {CODES} SELECT datetime, {r('quantity_MW', 'quantity_MW')}, key, "
    "coalesce(label, '__unknown__') AS country FROM both_raw LEFT JOIN codes ON label = country"
))
def _(spark, sf):
    rows, dictionary = fitted_before_2000(spark, sf)
    return label_decode(label_encode(rows, dictionary, ["country"]), dictionary, ["country"])


@REGISTRY.add("scale_transform", f"WITH {SPLIT}, {SCALER} SELECT datetime, country, {r('(quantity_MW - m) / s', 'quantity_MW')}, split FROM parts, scaler")
def _(spark, sf):
    panel = split_panel(spark, sf)
    return scale_transform(panel, fit_scaler(split_keep(panel, ["train"]), [VALUE]), [VALUE])


@REGISTRY.add("scale_transform_group", (
    f"WITH {BOTH}, g AS (SELECT *, min(quantity_MW) OVER (PARTITION BY country) AS lo, max(quantity_MW) OVER (PARTITION BY country) AS hi FROM both_raw) "
    f"SELECT {KEYS}, {r('(quantity_MW - lo) / (hi - lo)', 'quantity_MW')} FROM g"
))
def _(spark, sf):
    rows = both(spark, sf)
    return scale_transform(rows, fit_scaler(rows, [VALUE], ["country"]), [VALUE], "minmax", ["country"])


@REGISTRY.add("scale_inverse", (
    f"WITH {IDX}, wide AS (SELECT *, {columns(lag_sql('quantity_MW_lag', (1, LAG)) + lead_sql('quantity_MW_lead', (1, LEAD)))} "
    "FROM idx WINDOW w AS (PARTITION BY country ORDER BY datetime)) SELECT datetime, country, time_idx, "
    + columns([r(c, c) for c in ("quantity_MW", "quantity_MW_lag1", f"quantity_MW_lag{LAG}", "quantity_MW_lead1", f"quantity_MW_lead{LEAD}")])
    + " FROM wide"
))
def _(spark, sf):
    panel = hourly(spark, sf)
    state = fit_scaler(panel, [VALUE])
    scaled = scale_transform(panel, state, [VALUE])
    return scale_inverse(lag_lead(scaled, [VALUE], [VALUE], [1, LAG], [1, LEAD]), state, [VALUE])


@REGISTRY.add("add_noise", (
    f"WITH {RAW}, spread AS (SELECT stddev_samp(quantity_MW) AS s FROM raw) SELECT datetime, country, event_id, {r('quantity_MW', 'quantity_MW')}, "
    f"{r('quantity_MW + 0.01::DOUBLE * s * ' + gauss_sql(EVENT_KEY), 'quantity_MW_noise')} FROM raw, spread"
))
def _(spark, sf):
    rows = raw(spark, sf)
    spread = rows.agg(F.stddev_samp(VALUE)).first()[0]
    return rows.withColumn("quantity_MW_noise", add_noise(F.col(VALUE), F.col("event_id"), 0.01 * spread, 42))


STEP_KEY = "country || '|' || epoch(datetime)::BIGINT::VARCHAR || '#' || step::VARCHAR || '|7'"


@REGISTRY.add("noise_array", (
    f"WITH {IDX}, {windows_sql(SEQ)}, steps AS (SELECT country, datetime, time_idx, unnest(range(0, {SEQ})) AS step, unnest(xs) AS x FROM wins) "
    f"SELECT country, time_idx, step::INTEGER AS step, {r('steps.x + 0.05::DOUBLE * ' + gauss_sql(STEP_KEY), 'x')} FROM steps"
))
def _(spark, sf):
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], SEQ, LEAD)
    key = F.concat_ws("|", "country", F.unix_seconds("datetime").cast("string"))
    noisy = windows.withColumn("X", noise_array(F.col("X"), key, 0.05, 7))
    return noisy.select("country", "time_idx", F.posexplode("X").alias("step", "x"))


@REGISTRY.add("group_id", f"WITH {BOTH} SELECT {ALL}, country || '_' || year(datetime)::VARCHAR AS _group_id FROM both_raw")
def _(spark, sf):
    rows = both(spark, sf).withColumn("year", F.year("datetime"))
    return rows.withColumn("_group_id", group_id(["country", "year"])).drop("year")


@REGISTRY.add("resolution_minutes", (
    "SELECT event_id, CASE WHEN value < 5 THEN -1 WHEN value < 10 THEN 1440 + 60 * hour(ts) WHEN value > 50 THEN hour(ts) ELSE 60 * hour(ts) END::INTEGER AS minutes FROM events"
))
def _(spark, sf):
    unit = F.when(F.col("value") > 50, "M").otherwise("H")
    text = F.concat(F.lit("PT"), F.hour("ts").cast("string"), unit)
    text = F.when(F.col("value") < 5, "P1M").when(F.col("value") < 10, F.concat(F.lit("P1DT"), F.hour("ts").cast("string"), F.lit("H"))).otherwise(text)
    return table(spark, sf, "events").select("event_id", F.coalesce(resolution_minutes(text), F.lit(-1)).alias("minutes"))


@REGISTRY.add("point_time", "SELECT event_id, date_trunc('minute', ts) AS datetime FROM events")
def _(spark, sf):
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    position = F.hour("ts") * 60 + F.minute("ts") + 1
    return table(spark, sf, "events").select("event_id", point_time(day, position, F.lit(1)).alias("datetime"))


@REGISTRY.add("floor_hour", "SELECT event_id, date_trunc('hour', ts) - INTERVAL 10 DAY AS start FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", floor_hour(F.col("ts").cast("timestamp"), 10).alias("start"))


@REGISTRY.add("period_format", "SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS period FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", period_format(F.col("ts").cast("timestamp")).alias("period"))

"""Sources, sinks, datasets and saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.catalog.tables import (
    BOTH,
    HOURLY,
    LAG,
    LEAD,
    NAIVE,
    RAW,
    SEQ,
    SHARES,
    SPLIT,
    VALUE,
    Registry,
    both,
    columns,
    hourly,
    lag_sql,
    lead_sql,
    naive,
    r,
    raw,
    table,
    unpack,
)
from loadcast.functions.clock import CYCLE_COLUMNS, floor_hour, time_cycle, time_parts
from loadcast.operators.encode import label_encode, label_fit
from loadcast.operators.metrics import forecast_wide
from loadcast.operators.scale import fit_scaler, scale_transform
from loadcast.operators.split import fit_split, split_fraction, split_keep
from loadcast.operators.windows import flat_matrix, panel_frame, sequence_windows, step_columns
from loadcast.plans.collect import collect_load
from loadcast.plans.evaluate import result_table
from loadcast.session import scratch_path
from loadcast.sources.datasets import (
    read_flat_split,
    read_meta,
    read_panel_split,
    read_seq_split,
    write_flat_split,
    write_panel_split,
    write_seq_split,
)
from loadcast.sources.documents import build_load_xml, land_documents, parse_load_periods, parse_load_xml, read_load_periods, request_grid
from loadcast.sources.measurements import (
    as_measurements,
    load_state,
    read_forecast_csv,
    save_state,
    scan_measurements,
    write_base,
    write_forecast_csv,
)

REGISTRY = Registry()
GROUPS = ["split", "country"]
FEATURES = [VALUE, *step_columns(VALUE, "lag", LAG)]
TARGETS = step_columns(VALUE, "lead", LEAD)


def split_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    return split_fraction(rows, fit_split(rows, *SHARES))


@REGISTRY.add(
    "scan_measurements",
    f"WITH {RAW} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')} FROM raw WHERE country IN ('click', 'view')",
)
def _(spark, sf):
    readings = as_measurements(table(spark, sf, "events"), "ts", "event_type", "value")
    return scan_measurements(spark, write_base(readings, scratch_path(spark, "readings")), ["click", "view"])


@REGISTRY.add(
    "parse_load_xml",
    f"WITH {RAW}, minutely AS (SELECT date_trunc('minute', raw.datetime) AS datetime, country, "
    "first(quantity_MW ORDER BY raw.datetime, event_id) AS v FROM raw GROUP BY 1, 2) "
    "SELECT country, (epoch(datetime - date_trunc('day', datetime)) / 60)::INTEGER + 1 AS position, "
    f"{r('v', 'quantity_MW')}, strftime(datetime, '%Y-%m-%dT00:00Z') AS period_start, 'PT1M' AS resolution, datetime FROM minutely",
)
def _(spark, sf):
    minute = F.date_trunc("minute", "datetime").alias("datetime")
    first = F.min_by(VALUE, F.struct("datetime", "event_id")).alias(VALUE)
    return parse_load_xml(build_load_xml(raw(spark, sf).groupBy(minute, "country").agg(first)))


@REGISTRY.add(
    "parse_load_periods",
    f"WITH {RAW}, minutely AS (SELECT date_trunc('minute', raw.datetime) AS datetime, country, "
    "first(quantity_MW ORDER BY raw.datetime, event_id) AS v FROM raw GROUP BY 1, 2) "
    "SELECT country, (epoch(datetime - date_trunc('day', datetime)) / 60)::INTEGER + 1 AS position, "
    f"{r('v', 'quantity_MW')}, strftime(datetime, '%Y-%m-%dT00:00Z') AS period_start, 'PT1M' AS resolution, datetime FROM minutely",
)
def _(spark, sf):
    minute = F.date_trunc("minute", "datetime").alias("datetime")
    first = F.min_by(VALUE, F.struct("datetime", "event_id")).alias(VALUE)
    documents = build_load_xml(raw(spark, sf).groupBy(minute, "country").agg(first))
    return parse_load_periods(read_load_periods(spark, land_documents(documents, scratch_path(spark, "landed"))))


@REGISTRY.add("collect_load", (
    f"WITH {RAW}, minutely AS (SELECT date_trunc('minute', raw.datetime) AS datetime, country, "
    "first(quantity_MW ORDER BY raw.datetime, event_id) AS v FROM raw GROUP BY 1, 2) "
    f"SELECT date_trunc('hour', datetime) AS datetime, country, {r('first(v ORDER BY datetime)', 'quantity_MW')} FROM minutely GROUP BY 1, 2"
))
def _(spark, sf):
    minute = F.date_trunc("minute", "datetime").alias("datetime")
    first = F.min_by(VALUE, F.struct("datetime", "event_id")).alias(VALUE)
    documents = build_load_xml(raw(spark, sf).groupBy(minute, "country").agg(first))
    landed = land_documents(documents, scratch_path(spark, "landed"))
    return scan_measurements(spark, collect_load(spark, landed, scratch_path(spark, "base")))


@REGISTRY.add(
    "request_grid",
    f"WITH {RAW}, ends AS (SELECT country, date_trunc('hour', max(datetime)) AS hi FROM raw GROUP BY country), "
    "days AS (SELECT country, unnest(generate_series(hi - INTERVAL 10 DAY, hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM ends) "
    "SELECT 'load_total' AS item, 'A65' AS document_type, 'A16' AS process_type, 'area-' || country AS domain, country, day, "
    "strftime(day, '%Y%m%d%H%M') AS period_start, strftime(day + INTERVAL 1 DAY, '%Y%m%d%H%M') AS period_end FROM days",
)
def _(spark, sf):
    series = raw(spark, sf).groupBy("country").agg(F.max("datetime").alias("last"))
    codes = {name: f"area-{name}" for name in ("click", "error", "purchase", "signup", "view")}
    return request_grid(series, floor_hour(F.col("last"), 10), floor_hour(F.col("last")), codes=codes)


HOURLY_ROWS = f"WITH {HOURLY} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')} FROM hourly"


@REGISTRY.add("write_base", HOURLY_ROWS)
def _(spark, sf):
    path = write_base(hourly(spark, sf), scratch_path(spark, "base"), ["country"])
    return scan_measurements(spark, path)


@REGISTRY.add("forecast_csv", (
    f"WITH {NAIVE} SELECT country, datetime, time_idx, "
    + columns([r(f"max(y_true) FILTER (lead = {k})", f"quantity_MW_lead{k}_true") for k in range(1, LEAD + 1)])
    + ", "
    + columns([r(f"max(y_pred) FILTER (lead = {k})", f"quantity_MW_lead{k}_pred") for k in range(1, LEAD + 1)])
    + " FROM fc GROUP BY country, datetime, time_idx"
))
def _(spark, sf):
    wide = forecast_wide(naive(spark, sf), ["country", "datetime", "time_idx"], VALUE, LEAD, "true")
    path = write_forecast_csv(wide, scratch_path(spark, "forecast"))
    return read_forecast_csv(spark, path, wide.schema)


@REGISTRY.add("state_save_load", (
    f"WITH {BOTH}, labels AS (SELECT country AS label, row_number() OVER (ORDER BY country) - 1 AS code FROM (SELECT DISTINCT country FROM both_raw)) "
    "SELECT 'country' AS col, label, code::INTEGER AS code, 0::DOUBLE AS mean, 0::DOUBLE AS std FROM labels "
    "UNION ALL SELECT 'country', '__unknown__', (max(code) + 1)::INTEGER, 0, 0 FROM labels "
    f"UNION ALL SELECT 'quantity_MW', 'global', -1::INTEGER, {r('avg(quantity_MW)', 'mean')}, {r('stddev_pop(quantity_MW)', 'std')} FROM both_raw"
))
def _(spark, sf):
    rows = both(spark, sf)
    labels = save_state(label_fit(rows, ["country"]), scratch_path(spark, "labels"))
    scaler = save_state(fit_scaler(rows, [VALUE]), scratch_path(spark, "scaler"))
    scales = load_state(spark, scaler).select("col", F.col("group").alias("label"), "mean", "std")
    both_states = load_state(spark, labels).unionByName(scales, allowMissingColumns=True)
    return both_states.fillna({"code": -1, "mean": 0.0, "std": 0.0})


def flat_sql(cast: str, where: str) -> str:
    names = [f"quantity_MW_lag{k}" for k in range(1, LAG + 1)] + [f"quantity_MW_lead{k}" for k in range(1, LEAD + 1)]
    wide = columns([*lag_sql("quantity_MW_lag", range(1, LAG + 1)), *lead_sql("quantity_MW_lead", range(1, LEAD + 1))])
    values = columns([r(f"{c}{cast}", c) for c in ["quantity_MW", *names]])
    return (
        f"WITH {SPLIT}, wide AS (SELECT *, {wide} FROM sidx WINDOW w AS (PARTITION BY split, country ORDER BY datetime)) "
        f"SELECT {where.partition('|')[0]}country, datetime, {values} FROM wide "
        f"WHERE time_idx >= {LAG} AND time_idx + {LEAD} < n{where.partition('|')[2]}"
    )


def flat_written(spark: SparkSession, sf: str) -> str:
    flat = flat_matrix(split_panel(spark, sf), [VALUE], [VALUE], LAG, LEAD, groups=GROUPS)
    path = scratch_path(spark, "flat")
    write_flat_split(flat, path, FEATURES, TARGETS, ["country", "datetime"])
    return path


@REGISTRY.add("write_flat_split", flat_sql("", "split, |"))
def _(spark, sf):
    return spark.read.parquet(flat_written(spark, sf)).withColumn("split", F.col("split").cast("string"))


@REGISTRY.add("read_flat_split", flat_sql("::FLOAT::DOUBLE", "| AND split = 'train'"))
def _(spark, sf):
    return read_flat_split(spark, flat_written(spark, sf), "train")


@REGISTRY.add("result_table", (
    f"WITH {SPLIT}, wide AS (SELECT *, {columns(lead_sql('r', range(1, LEAD + 1)))}, "
    + columns([f"lag(quantity_MW, {LAG - k}) OVER w AS p{k}" for k in range(1, LEAD + 1)])
    + " FROM sidx WINDOW w AS (PARTITION BY split, country ORDER BY datetime)) SELECT country, datetime, round(quantity_MW, 2) AS quantity_MW, "
    + columns([f"round(r{k}, 2) AS quantity_MW_lead{k}_real, round(p{k}, 2) AS quantity_MW_lead{k}_pred" for k in range(1, LEAD + 1)])
    + f" FROM wide WHERE split = 'train' AND time_idx >= {LAG} AND time_idx + {LEAD} < n"
))
def _(spark, sf):
    panel = split_panel(spark, sf)
    train = split_keep(panel, ["train"]).withColumn("year", F.year("datetime"))
    scaler, labels = fit_scaler(train, [VALUE]), label_fit(train, ["country", "year"])
    encoded = label_encode(time_cycle(panel), labels, ["country"])
    flat = flat_matrix(scale_transform(encoded, scaler, [VALUE]), [VALUE], [VALUE], LAG, LEAD, groups=GROUPS)
    features = [*CYCLE_COLUMNS, "year", *FEATURES]
    path = scratch_path(spark, "scaled")
    write_flat_split(flat, path, features, TARGETS, ["country"])
    day_before = [features.index(f"{VALUE}_lag{LAG - k}") for k in range(1, LEAD + 1)]
    rows = read_flat_split(spark, path, "train")
    table_ = result_table(rows, features, TARGETS, lambda x: x[:, day_before], scaler, VALUE, labels)
    values = [VALUE, *[f"{VALUE}_lead{k}_{kind}" for k in range(1, LEAD + 1) for kind in ("real", "pred")]]
    return table_.select("country", F.col("datetime").cast("timestamp_ntz").alias("datetime"), *[F.round(c, 2).alias(c) for c in values])


SEQ_X = [f"x{i}" for i in range(1, SEQ + 1)]
SEQ_Y = [f"y{k}" for k in range(1, LEAD + 1)]


def seq_sql(select: str, where: str) -> str:
    wide = columns(
        [
            *[f"lag(quantity_MW, {SEQ - i}) OVER w AS x{i}" for i in range(1, SEQ + 1)],
            *lead_sql("y", range(1, LEAD + 1)),
        ]
    )
    values = columns([r(f"{c}::FLOAT::DOUBLE", c) for c in [*SEQ_X, *SEQ_Y]])
    return (
        f"WITH {SPLIT}, codes AS (SELECT country AS label, (row_number() OVER (ORDER BY country) - 1)::INTEGER AS code FROM (SELECT DISTINCT country FROM hourly)), "
        f"wide AS (SELECT *, {wide} FROM sidx WINDOW w AS (PARTITION BY split, country ORDER BY datetime)) "
        f"SELECT {select}datetime, code AS country_id, {values} FROM wide JOIN codes ON label = country "
        f"WHERE time_idx >= {SEQ - 1} AND time_idx + {LEAD} < n{where}"
    )


def sequences_written(spark: SparkSession, sf: str) -> str:
    from loadcast.operators.encode import apply_codes

    panel = split_panel(spark, sf)
    coded = apply_codes(panel, label_fit(panel, ["country"]), "country", "country_id")
    windows = sequence_windows(coded, [VALUE], [VALUE], SEQ, LEAD, GROUPS, keep=["country_id"])
    path = scratch_path(spark, "sequence")
    write_seq_split(windows.drop("country", "time_idx"), path, [VALUE], [VALUE], SEQ, LEAD)
    return path


@REGISTRY.add("write_seq_split", seq_sql("split, ", ""))
def _(spark, sf):
    rows = spark.read.parquet(sequences_written(spark, sf)).withColumn("split", F.col("split").cast("string"))
    return unpack(unpack(rows, "X", "x", SEQ), "Y", "y", LEAD)


@REGISTRY.add("read_seq_split", seq_sql("", " AND split = 'train'"))
def _(spark, sf):
    rows = read_seq_split(spark, sequences_written(spark, sf), "train")
    flat = rows.withColumns({"X": F.flatten("X"), "Y": F.flatten("Y")})
    return unpack(unpack(flat, "X", "x", SEQ), "Y", "y", LEAD)


def panel_written(spark: SparkSession, sf: str) -> str:
    panel = panel_frame(time_parts(split_panel(spark, sf)), GROUPS).withColumn("_group_id", F.col("country"))
    path = scratch_path(spark, "panel")
    write_panel_split(panel, path, [VALUE, "year", "month", "day", "hour", "minute"], [VALUE], SEQ, LEAD)
    return path


@REGISTRY.add("write_panel_split", (
    f"WITH {SPLIT} SELECT split, datetime, country, {r('quantity_MW', 'quantity_MW')}, year(datetime)::INTEGER AS year, "
    "month(datetime)::SMALLINT AS month, day(datetime)::SMALLINT AS day, hour(datetime)::SMALLINT AS hour, "
    "minute(datetime)::SMALLINT AS minute, time_idx::INTEGER AS time_idx, country AS _group_id FROM sidx"
))
def _(spark, sf):
    return spark.read.parquet(panel_written(spark, sf)).withColumn("split", F.col("split").cast("string"))


@REGISTRY.add("read_panel_split", (
    f"WITH {SPLIT}, wide AS (SELECT *, "
    + columns([f"lag(quantity_MW, {SEQ - i}) OVER w AS e{i}" for i in range(1, SEQ + 1)] + lead_sql("d", range(1, LEAD + 1)))
    + ", "
    + columns([f"lead(hour(datetime), {k}) OVER w AS h{k}" for k in range(1, LEAD + 1)])
    + " FROM sidx WINDOW w AS (PARTITION BY split, country ORDER BY datetime)) "
    + "SELECT country, datetime, time_idx::INTEGER AS time_idx, "
    + columns([r(c, c) for c in [f"e{i}" for i in range(1, SEQ + 1)] + [f"d{k}" for k in range(1, LEAD + 1)]])
    + ", "
    + columns([f"h{k}::DOUBLE AS h{k}" for k in range(1, LEAD + 1)])
    + f" FROM wide WHERE split = 'train' AND time_idx >= {SEQ - 1} AND time_idx + {LEAD} < n"
))
def _(spark, sf):
    rows = read_panel_split(spark, panel_written(spark, sf), "train", windows=True)
    known = 6  # time_idx, year, month, day, hour, minute
    hours = [F.get("decoder_known", F.lit(i * known + 4)).alias(f"h{i + 1}") for i in range(LEAD)]
    wide = unpack(unpack(rows, "encoder_target", "e", SEQ), "decoder_target", "d", LEAD)
    return wide.select(
        "country", "datetime", "time_idx", *[f"e{i}" for i in range(1, SEQ + 1)], *[f"d{k}" for k in range(1, LEAD + 1)], *hours
    )


@REGISTRY.add("dataset_meta", (
    f"WITH {SPLIT} SELECT split, 'panel' AS kind, count(*) AS rows, count(DISTINCT country) AS groups, "
    "strftime(min(datetime), '%Y-%m-%dT%H:%M:%S+00:00') AS min_time, strftime(max(datetime), '%Y-%m-%dT%H:%M:%S+00:00') AS max_time, "
    f"{SEQ} AS lag, {LEAD} AS lead, 6 AS x_dim, 1 AS y_dim, 'datetime' AS time_col, 'quantity_MW' AS target, 'double' AS target_type FROM sidx GROUP BY split"
))
def _(spark, sf):
    meta = read_meta(spark, panel_written(spark, sf), "panel")
    return meta.select(
        "split", "kind", "rows", "groups", "min_time", "max_time", "lag", "lead", "x_dim", "y_dim", "time_col",
        F.col("tft_schema.target").alias("target"), F.col("dtypes")[VALUE].alias("target_type"),
    )


@REGISTRY.add("split_keep", f"WITH {SPLIT} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, split FROM parts WHERE split IN ('val', 'test')")
def _(spark, sf):
    return split_keep(split_panel(spark, sf), ["val", "test"])

"""Lags, leads, matrices, sequences and panel windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast.catalog.tables import (
    BOTH,
    HOURLY,
    IDX,
    LAG,
    LEAD,
    SEQ,
    VALUE,
    Registry,
    both,
    columns,
    hourly,
    lag_sql,
    lead_sql,
    r,
    unpack,
)
from loadcast.functions.clock import time_parts
from loadcast.operators.encode import label_encode, label_fit
from loadcast.operators.positions import time_idx
from loadcast.operators.scale import fit_scaler
from loadcast.operators.windows import (
    flat_matrix,
    lag_lead,
    last_step_features,
    min_length_groups,
    panel_frame,
    panel_windows,
    sequence_windows,
    time_lag_lead,
    to_flat,
    to_steps,
    window_country_id,
)

REGISTRY = Registry()
LAGS = [f"quantity_MW_lag{k}" for k in range(1, LAG + 1)]
LEADS = [f"quantity_MW_lead{k}" for k in range(1, LEAD + 1)]
W = "WINDOW w AS (PARTITION BY country ORDER BY datetime)"


def wide_sql(exprs: list[str], names: list[str], where: str = "", keys: str = "datetime, country, ") -> str:
    values = columns([r(c, c) for c in ["quantity_MW", *names]])
    return f"WITH {IDX}, wide AS (SELECT *, {columns(exprs)} FROM idx {W}) SELECT {keys}{values}, time_idx FROM wide{where}"


@REGISTRY.add("lag_features", wide_sql(lag_sql("quantity_MW_lag", range(1, LAG + 1)), LAGS))
def _(spark, sf):
    return lag_lead(hourly(spark, sf), [VALUE], [], range(1, LAG + 1), [])


# Two series columns whose joined texts are alike, one of them NULL for some series.
PAIR = {"click": ("a_b", "c"), "view": ("a", "b_c"), "error": (None, "c"), "purchase": ("__nan__", "c"), "signup": ("a", None)}


def pair_sql(i: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN " + (f"'{v[i]}'" if v[i] else "NULL") for k, v in PAIR.items())
    return f"CASE country {cases} END AS {'pq'[i]}"


def paired(rows):
    """The rows with the columns ``p`` and ``q`` in place of the series."""
    names = F.create_map(*[F.lit(x) for k, v in PAIR.items() for x in (k, F.struct(*[F.lit(t).cast("string").alias(c) for c, t in zip("pq", v)]))])
    return rows.withColumn("_pair", names[F.col("country")]).withColumns({"p": F.col("_pair.p"), "q": F.col("_pair.q")}).drop("_pair", "country")


@REGISTRY.add("lag_features_multi", (
    f"SELECT * EXCLUDE (country), {pair_sql(0)}, {pair_sql(1)} FROM ("
    + wide_sql(lag_sql("quantity_MW_lag", range(1, 4)) + lead_sql("quantity_MW_lead", range(1, 3)), [*LAGS[:3], *LEADS[:2]])
    + ")"
))
def _(spark, sf):
    return lag_lead(paired(hourly(spark, sf)), [VALUE], [VALUE], range(1, 4), range(1, 3), groups=["p", "q"])


@REGISTRY.add("min_length_multi", (
    f"WITH {HOURLY}, counted AS (SELECT *, strftime(datetime, '%Y-%m-%d') AS day, count(*) OVER (PARTITION BY country, date_trunc('day', datetime)) AS n FROM hourly) "
    f"SELECT datetime, {r('quantity_MW', 'quantity_MW')}, {pair_sql(0)}, {pair_sql(1)}, day FROM counted WHERE n >= {SEQ + LEAD}"
))
def _(spark, sf):
    rows = paired(hourly(spark, sf)).withColumn("day", F.date_format("datetime", "yyyy-MM-dd"))
    return min_length_groups(rows, SEQ + LEAD, ["p", "q", "day"])


LABEL = {"click": r"a\_b_c", "view": r"a_b\_c", "error": "__nan___c", "purchase": r"\_\_nan\_\__c", "signup": "a___nan__"}


@REGISTRY.add("scaler_fit_multi", (
    f"WITH {HOURLY} SELECT 'quantity_MW' AS col, CASE country " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL.items())
    + f" END AS \"group\", {r('avg(quantity_MW)', 'mean')}, {r('stddev_pop(quantity_MW)', 'std')}, {r('min(quantity_MW)', 'min')}, "
    f"{r('max(quantity_MW)', 'max')} FROM hourly GROUP BY country"
))
def _(spark, sf):
    return fit_scaler(paired(hourly(spark, sf)), [VALUE], ["p", "q"])


@REGISTRY.add("lag_masked", wide_sql(
    lag_sql("quantity_MW_lag", range(1, SEQ + 1)) + [f"-999::DOUBLE AS quantity_MW_lag{k}" for k in range(SEQ + 1, LAG + 1)], LAGS
))
def _(spark, sf):
    return lag_lead(hourly(spark, sf), [VALUE], [], range(1, SEQ + 1), [], range(SEQ + 1, LAG + 1), -999.0)


@REGISTRY.add("lead_targets", wide_sql(lead_sql("quantity_MW_lead", range(1, LEAD + 1)), LEADS))
def _(spark, sf):
    return lag_lead(hourly(spark, sf), [], [VALUE], [], range(1, LEAD + 1))


@REGISTRY.add("lag_time_based", (
    f"WITH {HOURLY} SELECT h.datetime, h.country, {r('h.quantity_MW', 'quantity_MW')}, {r('a.quantity_MW', 'quantity_MW_lag1')}, "
    f"{r('b.quantity_MW', 'quantity_MW_lag24')}, {r('c.quantity_MW', 'quantity_MW_lead1')} FROM hourly h "
    "LEFT JOIN hourly a ON a.country = h.country AND a.datetime = h.datetime - INTERVAL 1 HOUR "
    "LEFT JOIN hourly b ON b.country = h.country AND b.datetime = h.datetime - INTERVAL 24 HOUR "
    "LEFT JOIN hourly c ON c.country = h.country AND c.datetime = h.datetime + INTERVAL 1 HOUR"
))
def _(spark, sf):
    return time_lag_lead(hourly(spark, sf), [VALUE], [VALUE], [1, 24], [1])


@REGISTRY.add("flat_matrix", wide_sql(
    lag_sql("quantity_MW_lag", range(1, LAG + 1)) + lead_sql("quantity_MW_lead", range(1, LEAD + 1)),
    LAGS + LEADS,
    f" WHERE time_idx >= {LAG} AND time_idx + {LEAD} < n",
))
def _(spark, sf):
    return flat_matrix(hourly(spark, sf), [VALUE], [VALUE], LAG, LEAD)


@REGISTRY.add("time_idx", (
    f"WITH {BOTH} SELECT datetime, country, {r('quantity_MW', 'quantity_MW')}, key, "
    "row_number() OVER (PARTITION BY country ORDER BY datetime, key) - 1 AS time_idx FROM both_raw"
))
def _(spark, sf):
    return time_idx(both(spark, sf), order=["key"])


def sequence_sql(extra: str = "", select: str = "country, datetime, time_idx") -> str:
    exprs = [f"lag(quantity_MW, {SEQ - i}) OVER w AS x{i}" for i in range(1, SEQ + 1)] + lead_sql("y", range(1, LEAD + 1))
    names = [f"x{i}" for i in range(1, SEQ + 1)] + [f"y{k}" for k in range(1, LEAD + 1)]
    return (
        f"WITH {IDX}{extra}, wide AS (SELECT *, {columns(exprs)} FROM idx {W}) SELECT {select}, {columns([r(c, c) for c in names])} "
        f"FROM wide WHERE time_idx >= {SEQ - 1} AND time_idx + {LEAD} < n"
    )


@REGISTRY.add("sequence_windows", sequence_sql())
def _(spark, sf):
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], SEQ, LEAD)
    return unpack(unpack(windows, "X", "x", SEQ), "Y", "y", LEAD)


@REGISTRY.add("window_country_id", (
    f"WITH {IDX}, codes AS (SELECT country AS label, (row_number() OVER (ORDER BY country) - 1)::INTEGER AS code FROM (SELECT DISTINCT country FROM hourly)) "
    f"SELECT code AS country, datetime, time_idx, code AS country_id FROM idx JOIN codes ON label = country WHERE time_idx >= {SEQ - 1} AND time_idx + {LEAD} < n"
))
def _(spark, sf):
    panel = hourly(spark, sf)
    coded = label_encode(panel, label_fit(panel, ["country"]), ["country"])
    windows = sequence_windows(coded, [VALUE], [VALUE], SEQ, LEAD)
    return window_country_id(windows).drop("X", "Y")


@REGISTRY.add("last_step_features", (
    f"WITH {IDX} SELECT country, datetime, time_idx, {r('quantity_MW', 'f1')}, hour(datetime)::DOUBLE AS f2 FROM idx "
    f"WHERE time_idx >= {SEQ - 1} AND time_idx + {LEAD} < n"
))
def _(spark, sf):
    panel = time_parts(hourly(spark, sf))
    windows = sequence_windows(panel, [VALUE, "hour"], [VALUE], SEQ, LEAD)
    last = windows.withColumn("X", last_step_features("X", 2)).drop("Y")
    return unpack(last, "X", "f", 2)


PANEL_NAMES = [f"e{i}" for i in range(1, SEQ + 1)] + [f"d{k}" for k in range(1, LEAD + 1)]


@REGISTRY.add("panel_windows", (
    f"WITH {IDX}, wide AS (SELECT *, "
    + columns([f"lag(quantity_MW, {SEQ - i}) OVER w AS e{i}" for i in range(1, SEQ + 1)] + lead_sql("d", range(1, LEAD + 1)))
    + ", "
    + columns([f"lag(hour(datetime), {SEQ - i}) OVER w AS eh{i}" for i in range(1, SEQ + 1)])
    + ", "
    + columns([f"lead(day(datetime), {k}) OVER w AS dd{k}" for k in range(1, LEAD + 1)])
    + f" FROM idx {W}) SELECT country, datetime, time_idx::INTEGER AS time_idx, "
    + columns([r(c, c) for c in PANEL_NAMES])
    + ", "
    + columns([f"eh{i}::DOUBLE AS eh{i}" for i in range(1, SEQ + 1)] + [f"dd{k}::DOUBLE AS dd{k}" for k in range(1, LEAD + 1)])
    + f" FROM wide WHERE time_idx >= {SEQ - 1} AND time_idx + {LEAD} < n"
))
def _(spark, sf):
    known = ["time_idx", "year", "month", "day", "hour", "minute"]
    windows = panel_windows(panel_frame(time_parts(hourly(spark, sf))), VALUE, SEQ, LEAD, known)
    width = len(known)
    hours = [F.get("encoder_known", F.lit(i * width + 4)).alias(f"eh{i + 1}") for i in range(SEQ)]
    days = [F.get("decoder_known", F.lit(i * width + 3)).alias(f"dd{i + 1}") for i in range(LEAD)]
    wide = unpack(unpack(windows, "encoder_target", "e", SEQ), "decoder_target", "d", LEAD)
    return wide.select("country", "datetime", "time_idx", *PANEL_NAMES, *hours, *days)


@REGISTRY.add("relative_time", (
    f"WITH {IDX} SELECT country, datetime, time_idx::INTEGER AS time_idx, {SEQ} AS encoder_length, (k.k + {SEQ})::INTEGER AS step, {r(f'k.k / {SEQ}::DOUBLE', 'relative_time_idx')} "
    f"FROM idx CROSS JOIN (SELECT unnest(range(-{SEQ}, {LEAD})) AS k) k WHERE time_idx >= {SEQ - 1} AND time_idx + {LEAD} < n"
))
def _(spark, sf):
    windows = panel_windows(panel_frame(time_parts(hourly(spark, sf))), VALUE, SEQ, LEAD)
    return windows.select(
        "country", "datetime", "time_idx", "encoder_length", F.posexplode("relative_time_idx").alias("step", "relative_time_idx")
    )


@REGISTRY.add("flatten_reshape", sequence_sql())
def _(spark, sf):
    windows = sequence_windows(hourly(spark, sf), [VALUE], [VALUE], SEQ, LEAD)
    there_and_back = windows.withColumn("X", to_flat(to_steps("X", SEQ // 2, 2)))
    return unpack(unpack(there_and_back, "X", "x", SEQ), "Y", "y", LEAD)

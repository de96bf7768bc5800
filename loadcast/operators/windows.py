"""Lags, leads, flat matrices, sequences and panel windows.

A series is cut into chunks of consecutive positions. Every row is sent to its own chunk and,
when it lies near an edge, to the neighbours that look back or ahead at it. A chunk is then one
row holding short arrays, and each window is a slice of those arrays: no task holds a whole
series, and no window frame is re-evaluated per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.functions.clock import TIME_PARTS
from loadcast.functions.columns import (
    NOISE_SUFFIX,
    as_double,
    double_sql,
    group_id,
    noise_rename,
    quoted,
    require_columns,
    series_key,
    unique,
)
from loadcast.operators.bounds import broadcast_if_bounded
from loadcast.operators.clean import hourly_grid
from loadcast.operators.positions import time_idx

MIN_CHUNK_ROWS = 256
# New columns up to which Spark compiles a projection together with what is below it.
COMPILED_COLUMNS = 80
DOUBLES = T.ArrayType(T.DoubleType())
COUNTRY = ("country",)


def chunk_size(before: int, after: int) -> int:
    """Rows per chunk: at least four times the overlap, so at most a quarter is sent twice."""
    return max(MIN_CHUNK_ROWS, 4 * (before + after))


def chunked(
    df: DataFrame,
    carry: Sequence[str],
    arrays: dict[str, Column],
    before: int,
    after: int,
    groups: Sequence[str] = COUNTRY,
    time_col: str = "datetime",
    order: Sequence[str] = (),
    chunk_rows: int | None = None,
    indexed: bool = False,
    seconds: int | None = None,
) -> DataFrame:
    """The columns ``carry`` and ``time_idx`` of every row and, per entry of ``arrays``, the
    values around it.

    Column ``_pos`` is the row's 0-based place in those arrays and ``…_full`` says that an
    array of doubles has no gaps. The arrays hold the ``before``
    rows ahead of it and the ``after`` rows behind it, as far as the series has them.
    ``indexed`` says that ``time_idx`` is already there. Give no other columns than needed: then the input is read once
    (see ``per_bucket``).
    """
    size = chunk_rows or chunk_size(before, after)
    rows = df if indexed else time_idx(df.drop("time_idx"), groups, time_col, order, seconds)
    carry = [c for c in carry if c != "time_idx"]
    home = F.expr(f"time_idx div {size}")
    reach = F.sequence(
        F.expr(f"greatest(time_idx - {after}, 0) div {size}"),
        F.expr(f"(time_idx + {before}) div {size}"),
    )
    record = F.struct("time_idx", *carry, *[v.alias(f"_a_{n}") for n, v in arrays.items()])
    chunks = (
        rows.select(series_key(groups).alias("_group"), record.alias("_row"), F.col("time_idx"))
        .withColumn("_chunk", F.explode(reach))
        # Lists do not shrink before the shuffle, so rows are moved as they are and grouped once.
        .repartition("_group", "_chunk")
        .groupBy("_group", "_chunk")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    listed = chunks.select("_chunk", "_rows", *[F.col(f"_rows._a_{n}").alias(n) for n in arrays])
    plain = [n for n in arrays if listed.schema[n].dataType == DOUBLES]
    flags = [f"{n}_full" for n in plain]
    flagged = listed.select("*", *[no_gaps(F.col(n)).alias(f) for n, f in zip(plain, flags)])
    spread = flagged.select("_chunk", *arrays, *flags, F.posexplode("_rows").alias("_pos", "_row"))
    return (
        spread.select("_chunk", "_pos", "_row.time_idx", *[f"_row.{c}" for c in carry], *arrays, *flags)
        .where(home == F.col("_chunk"))
        .drop("_chunk")
    )


def past(array: str, length: int) -> Column:
    """The last ``length`` values up to the current row, oldest first; needs ``has_past``."""
    return F.slice(F.col(array), F.col("_pos") + (2 - length), F.lit(length))


def future(array: str, length: int) -> Column:
    """The next ``length`` values after the current row; needs ``has_future``."""
    return F.slice(F.col(array), F.col("_pos") + 2, F.lit(length))


def cut_out(window: Column) -> Column:
    """The fields of the struct as columns, as a generator of one row.

    Later expressions, which may use lambdas, are not merged below a generator, so they see
    the short window and not the arrays of the whole chunk.
    """
    return F.inline(F.array(window))


def has_past(rows: int) -> Column:
    """At least ``rows`` rows up to and including the current one."""
    return F.col("_pos") >= rows - 1


def has_future(array: str, rows: int) -> Column:
    """At least ``rows`` rows after the current one."""
    return F.col("_pos") + rows < F.size(array)


def no_gaps(window: Column) -> Column:
    """No NULL and no NaN in an array of doubles.

    ``arrays_overlap`` is true if NaN occurs and NULL if a NULL does, and unlike a test with a
    lambda it is compiled together with the operators around it. That matters here: outside
    compiled code every row would carry a copy of its whole chunk.
    """
    return F.coalesce(~F.arrays_overlap(window, F.array(F.lit(float("nan")))), F.lit(False))


def whole(array: str, window: Column) -> Column:
    """No gaps in the window; the test is skipped in chunks that have none at all."""
    return F.col(f"{array}_full") | no_gaps(window)


def lag_lead(
    df: DataFrame,
    lagged: Sequence[str],
    led: Sequence[str],
    lags: Sequence[int],
    leads: Sequence[int],
    masked: Sequence[int] = (),
    mask_value: float = 0.0,
    groups: Sequence[str] = COUNTRY,
    time_col: str = "datetime",
    order: Sequence[str] = (),
    chunk_rows: int | None = None,
    complete: bool = False,
    seconds: int | None = None,
) -> DataFrame:
    """Columns ``x_lag1`` … and ``y_lead1`` … by row position; steps off the series are NULL.

    Steps in ``masked`` get the constant ``mask_value``. A ``_noise`` suffix of a lagged column
    is left out of the new names. With ``complete`` only rows without NULL among the lags and
    leads are kept; that needs steps 1..n and is tested on the arrays, so that no filter over
    hundreds of columns has to be planned. With many new columns the last projection is not compiled any more; it
    then gets a row's own window, cut before, and not the arrays of its chunk.
    """
    require_columns(df, [*lagged, *led, *groups, time_col, *order])
    names = unique([*lagged, *led])
    arrays = {f"_v{i}": as_double(df, c) for i, c in enumerate(names)}
    place = {c: f"_v{i}" for i, c in enumerate(names)}
    carry = [c for c in df.columns if c != "time_idx"]
    before, after = max(lags, default=0), max(leads, default=0)
    rows = chunked(
        df, carry, arrays, before, after, groups, time_col, order, chunk_rows, seconds=seconds
    )
    if complete:
        for c in lagged:
            rows = rows.where(has_past(before + 1) & whole(place[c], F.slice(place[c], F.col("_pos") - (before - 1), F.lit(before))))
        for c in led:
            rows = rows.where(has_future(place[c], after) & whole(place[c], future(place[c], after)))
    wide = len(lagged) * len(lags) + len(led) * len(leads) > COMPILED_COLUMNS
    if wide:
        seen = F.least("_pos", F.lit(before))
        cuts = [F.slice(place[c], F.col("_pos") - seen + 1, seen).alias(f"_b{i}") for i, c in enumerate(lagged)]
        cuts += [future(place[c], after).alias(f"_f{i}") for i, c in enumerate(led)]
        rows = rows.select(*carry, "time_idx", cut_out(F.struct(*cuts)))
    new = []
    for i, c in enumerate(lagged):
        base = c.removesuffix(NOISE_SUFFIX)
        value = f"get(_b{i}, size(_b{i}) - {{}})" if wide else f"get({place[c]}, _pos - {{}})"
        new += [f"{value.format(k)} AS {quoted(f'{base}_lag{k}')}" for k in lags]
        new += [f"double({float(mask_value)!r}) AS {quoted(f'{base}_lag{k}')}" for k in masked]
    for i, c in enumerate(led):
        value = f"get(_f{i}, {{}} - 1)" if wide else f"get({place[c]}, _pos + {{}})"
        new += [f"{value.format(k)} AS {quoted(f'{c}_lead{k}')}" for k in leads]
    return rows.selectExpr(*map(quoted, [*carry, "time_idx"]), *new)


def time_lag_lead(
    df: DataFrame,
    lagged: Sequence[str],
    led: Sequence[str],
    lags: Sequence[int],
    leads: Sequence[int],
    group: str = "country",
    time_col: str = "datetime",
) -> DataFrame:
    """Lags and leads by hour instead of row position, so a missing hour gives NULL.

    Readings at the same minute past the hour form a lane of their series. A lane is completed with its empty
    hours, where positions and hours agree; the rows added for that are taken out again. Rows without a time
    have no lags and leads.
    """
    past_hour = F.unix_micros(time_col) - F.unix_micros(F.date_trunc("hour", time_col))
    laned = df.withColumns({"_present": F.lit(True), "_lane": past_hour})
    full = laned.where(F.col(time_col).isNotNull())
    on_hour = full.withColumn(time_col, F.date_trunc("hour", time_col)).withColumn("_series", F.struct(group, "_lane"))
    marked = hourly_grid(on_hour.drop(group, "_lane"), time_col, "_series")
    wide = lag_lead(marked, lagged, led, lags, leads, groups=["_series"], time_col=time_col).where("_present")
    back = F.timestamp_micros(F.unix_micros(time_col) + F.col("_series._lane")).cast(df.schema[time_col].dataType)
    named = wide.withColumns({time_col: back, group: F.col(f"_series.{group}")}).drop("_present", "_series", "time_idx")
    names = [*df.columns, *[c for c in named.columns if c not in df.columns]]
    return named.select(*names).unionByName(df.where(F.col(time_col).isNull()), allowMissingColumns=True)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a NULL in the given columns."""
    return df.na.drop(subset=list(columns))


def step_columns(base: str, kind: str, steps: int) -> list[str]:
    return [f"{base}_{kind}{k}" for k in range(1, steps + 1)]


def flat_matrix(
    df: DataFrame,
    series: Sequence[str],
    targets: Sequence[str],
    lags: int,
    leads: int,
    seq_len: int | None = None,
    mask_value: float = 0.0,
    drop_nulls: bool = True,
    groups: Sequence[str] = COUNTRY,
    time_col: str = "datetime",
    order: Sequence[str] = (),
    chunk_rows: int | None = None,
    seconds: int | None = None,
) -> DataFrame:
    """One row per time with ``lags`` lag columns per series and ``leads`` lead columns per target.

    With ``seq_len`` below ``lags`` the older lags hold ``mask_value``. Noisy columns take the
    name of their base, and rows with a NULL among the new columns are dropped.
    """
    active = lags if seq_len is None else min(seq_len, lags)
    wide = lag_lead(
        df,
        series,
        targets,
        range(1, active + 1),
        range(1, leads + 1),
        range(active + 1, lags + 1),
        mask_value,
        groups,
        time_col,
        order,
        chunk_rows,
        complete=drop_nulls,
        seconds=seconds,
    )
    return noise_rename(wide)


def flat_arrays(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Keys plus feature columns as array ``X`` and target columns as array ``Y``."""
    used = {*features, *targets}
    keys = [c for c in df.columns if c not in used]
    return df.select(
        *keys,
        F.expr(f"array({', '.join(double_sql(df, c) for c in features)})").alias("X"),
        F.expr(f"array({', '.join(double_sql(df, c) for c in targets)})").alias("Y"),
    )


def flat_windows(
    df: DataFrame,
    features: Sequence[str],
    series: Sequence[str],
    targets: Sequence[str],
    lags: int,
    leads: int,
    histories: Sequence[int] = (),
    mask_value: float = 0.0,
    groups: Sequence[str] = COUNTRY,
    time_col: str = "datetime",
    order: Sequence[str] = (),
    chunk_rows: int | None = None,
    seconds: int | None = None,
) -> DataFrame:
    """The flat matrix as ``X`` and ``Y`` arrays, for several histories from one pass.

    ``X`` holds the features and then the lags 1..``lags`` of each series; lags beyond a history
    hold ``mask_value``. A row appears once per entry of ``histories`` (column ``seq_len``) for
    which its lags and leads are complete. Equal to ``flat_matrix`` per history, without
    hundreds of columns and with a single shuffle for all of them.
    """
    wanted = [min(h, lags) for h in histories or [lags]]
    require_columns(df, [*features, *series, *targets, *groups, time_col, *order])
    names = unique([*series, *targets])
    place = {c: f"_v{i}" for i, c in enumerate(names)}
    arrays = {place[c]: as_double(df, c) for c in names}
    vector = F.expr(f"array({', '.join(double_sql(df, c) for c in features)})")
    kept = unique([*groups, time_col, *order])
    rows = chunked(
        df.withColumn("_f", vector).select(*unique([*kept, *names, "_f"])),
        [*kept, "_f"],
        arrays,
        max(wanted),
        leads,
        groups,
        time_col,
        order,
        chunk_rows,
        seconds=seconds,
    )
    for c in targets:
        rows = rows.where(has_future(place[c], leads) & whole(place[c], future(place[c], leads)))

    def lagged(h: int) -> Column:
        parts, complete = [F.col("_f")], has_past(h + 1)
        for c in series:
            seen = F.slice(place[c], F.col("_pos") - (h - 1), F.lit(h))
            complete = complete & whole(place[c], seen)
            parts += [F.reverse(seen), F.array_repeat(F.lit(float(mask_value)), lags - h)]
        return F.struct(F.lit(h).alias("seq_len"), F.when(complete, F.concat(*parts)).alias("X"))

    y = F.concat(*[future(place[c], leads) for c in targets])
    spread = rows.select(*kept, "time_idx", y.alias("Y"), F.inline(F.array(*map(lagged, wanted))))
    return spread.where(F.col("X").isNotNull())


def sequence_windows(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    seq_len: int,
    lead: int,
    groups: Sequence[str] = COUNTRY,
    time_col: str = "datetime",
    order: Sequence[str] = (),
    keep: Sequence[str] = (),
    drop_nulls: bool = False,
    chunk_rows: int | None = None,
    seconds: int | None = None,
    histories: Sequence[int] = (),
) -> DataFrame:
    """Sliding windows: ``X`` = ``seq_len`` steps of all features, time-major; ``Y`` = next steps.

    A row stands for the last input step, whose time and position it carries. Series shorter
    than ``seq_len + lead`` give no rows. NULLs stay in place unless ``drop_nulls`` is set. With ``histories``, all at
    most ``seq_len``, a row appears once per history it is long enough for (column ``seq_len``), all cut in one pass.
    """
    step_x = F.array(*[as_double(df, c) for c in features])
    step_y = F.array(*[as_double(df, c) for c in targets])
    kept = unique([*groups, time_col, *order, *keep])
    arrays = {"_xs": step_x, "_ys": step_y}
    used = df.select(*unique([*kept, *features, *targets]))
    rows = chunked(
        used, kept, arrays, seq_len - 1, lead, groups, time_col, order, chunk_rows, seconds=seconds
    ).where(has_past(min(histories, default=seq_len)) & has_future("_xs", lead))
    if histories:
        cuts = [F.struct(F.lit(h).alias("seq_len"), F.when(has_past(h), F.flatten(past("_xs", h))).alias("X"), F.flatten(future("_ys", lead)).alias("Y")) for h in histories]
        out = rows.select(*kept, "time_idx", F.inline(F.array(*cuts))).where(F.col("X").isNotNull())
    else:
        window = F.struct(F.flatten(past("_xs", seq_len)).alias("X"), F.flatten(future("_ys", lead)).alias("Y"))
        out = rows.select(*kept, "time_idx", cut_out(window))
    return out.where(no_gaps(F.col("X")) & no_gaps(F.col("Y"))) if drop_nulls else out


def window_country_id(df: DataFrame, code_col: str = "country") -> DataFrame:
    """The window's series code as ``country_id``; 0 where there is no such column."""
    code = F.col(code_col).cast("int") if code_col in df.columns else F.lit(0)
    return df.withColumn("country_id", code)


def to_steps(array: Column | str, steps: int, dim: int) -> Column:
    """A flat, time-major array as an array of ``steps`` vectors of length ``dim``."""
    column = F.col(array) if isinstance(array, str) else array
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice(column, i * dim + 1, F.lit(dim))
    )


def to_flat(array: Column | str) -> Column:
    """The inverse of ``to_steps``."""
    return F.flatten(array)


def last_step_features(array: Column | str, dim: int) -> Column:
    """The feature vector of the last step of a flat, time-major array."""
    return F.slice(array, -dim, dim)


def panel_frame(
    df: DataFrame,
    groups: Sequence[str] = COUNTRY,
    time_col: str = "datetime",
    order: Sequence[str] = (),
) -> DataFrame:
    """The panel with ``_group_id`` and the integer ``time_idx`` of each row."""
    indexed = time_idx(df, groups, time_col, order)
    return indexed.withColumns(
        {"_group_id": group_id(groups), "time_idx": F.col("time_idx").cast("int")}
    )


def panel_windows(
    df: DataFrame,
    target: str,
    encoder: int,
    decoder: int,
    known: Sequence[str] = ("time_idx", *TIME_PARTS),
    groups: Sequence[str] = COUNTRY,
    time_col: str = "datetime",
    order: Sequence[str] = (),
    chunk_rows: int | None = None,
    observed: Sequence[str] = (),
    history: str | None = None,
    static: Sequence[str] = (),
    histories: Sequence[int] = (),
) -> DataFrame:
    """Fixed encoder/decoder windows of a panel frame.

    ``encoder_target`` are the observed values, ``decoder_target`` those to forecast, and the
    ``known`` columns are given for every step of both. ``observed`` columns, if any, are given for the
    encoder's steps alone, as ``encoder_observed``. ``history`` names the column that ``encoder_target`` shows, if it is not
    the target itself (its noisy version, say), and ``static`` columns are given once per window, as the array ``static``.
    With ``histories``, all at most ``encoder``, a row appears once per encoder length it is long enough for, all cut in one
    pass. A row stands for the last encoder step.
    """
    step_known = F.array(*[F.col(c).cast("double") for c in known])
    kept = unique([*groups, time_col, *order])
    arrays = {"_ys": as_double(df, target), "_ks": step_known}
    if history:
        arrays["_hs"] = as_double(df, history)
    if observed:
        arrays["_os"] = F.array(*[as_double(df, c) for c in observed])
    carry = [*kept, "static"] if static else kept
    given = df.withColumn("static", F.array(*[as_double(df, c) for c in static])) if static else df
    lengths = list(histories) or [encoder]
    rows = chunked(
        given, carry, arrays, encoder - 1, decoder, groups, time_col, order, chunk_rows, indexed=True
    ).where(has_past(min(lengths)) & has_future("_ys", decoder))

    def window(h: int) -> Column:
        relative = [(i - h) / h for i in range(h + decoder)]
        return F.struct(
            F.when(has_past(h), past("_hs" if history else "_ys", h)).alias("encoder_target"),
            future("_ys", decoder).alias("decoder_target"),
            F.when(has_past(h), F.flatten(past("_ks", h))).alias("encoder_known"),
            F.flatten(future("_ks", decoder)).alias("decoder_known"),
            *([F.when(has_past(h), F.flatten(past("_os", h))).alias("encoder_observed")] if observed else []),
            F.lit(h).alias("encoder_length"),
            F.array(*map(F.lit, relative)).alias("relative_time_idx"),
        )

    out = rows.select(*carry, "time_idx", F.inline(F.array(*map(window, lengths))))
    return out.where(F.col("encoder_target").isNotNull()) if histories else out


def min_length_groups(
    df: DataFrame, rows: int, groups: Sequence[str] = COUNTRY
) -> DataFrame:
    """Rows of series that have at least ``rows`` rows.

    Series are counted by partial aggregation and their keys joined back; no series is
    gathered in one task.
    """
    key = series_key(groups)
    long_enough = (
        df.groupBy(key.alias("_group"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= rows)
        .select("_group")
    )
    keyed = df.withColumn("_group", key)
    return keyed.join(broadcast_if_bounded(long_enough), "_group", "left_semi").drop("_group")

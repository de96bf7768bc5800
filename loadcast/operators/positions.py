"""Positions of rows in an order, without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.columns import series_key

DAY_SECONDS = 86_400
TARGET_BUCKET_ROWS = 250_000
# Rows that a bucket between cut points may hold, sampled keys per bucket, and buckets at most.
BUCKET_ROWS, DRAWS, MOST_BUCKETS = 1_000_000, 64, 16_384
# Frames up to this size, as the optimizer estimates it, are not sampled.
SMALL_BYTES = 64 << 20
# Widths in microseconds that a rank is narrowed down by, and the rows one task may rank.
WIDTHS = (DAY_SECONDS * 1_000_000, 60 * 1_000_000, 1)
RANK_ROWS = 1_000_000


def time_bucket(time: Column, seconds: int = DAY_SECONDS) -> Column:
    """Number of the fixed-width time bucket; rows without a time come last."""
    return F.coalesce(_micros_bucket(F.unix_micros(time), int(seconds) * 1_000_000), F.lit(1 << 62))


def _micros_bucket(micros: Column, width: int) -> Column:
    """Floor division in integers, also before 1970."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(width)), F.lit(width))


def with_buckets(
    df: DataFrame,
    groups: Sequence[str] = (),
    time_col: str | None = "datetime",
    order: Sequence[str] = (),
    out: str = "_bucket",
    rows: int = BUCKET_ROWS,
    small_bytes: int = SMALL_BYTES,
    nulls_last: bool = True,
) -> DataFrame:
    """Adds a bucket number that rises along (series, time, ``order``), with about half of ``rows`` rows in a bucket.

    Cut points are taken from a sample of keys: where a series, a day or a single timestamp holds many rows, more
    cut points fall inside it, in the end between values of ``order``, so a hot series or day is spread over as many
    buckets as its rows need. Only rows equal in series, time and ``order`` stay together. Two jobs, which read the key
    columns only, count the rows and draw the sample; the driver gets the cut points as one text. A row's bucket is
    found by halving, in compiled code.

    Frames that the optimizer holds for smaller than ``small_bytes`` start no job and get a bucket per day (or one in all).
    """
    plain = df.withColumn(out, time_bucket(F.col(time_col)) if time_col else F.lit(0))
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) <= small_bytes:
        return plain
    key = F.struct(*_comparable(df, [*groups, *([time_col] if time_col else []), *order], nulls_last))
    keys = df.select(key.alias("_key"))
    total = keys.count()
    buckets = min(-(-2 * total // rows), MOST_BUCKETS)
    if buckets < 2:
        return plain
    drawn = keys.sample(min(1.0, DRAWS * buckets / total), seed=1)
    ranked = drawn.select("_key", F.row_number().over(Window.orderBy("_key")).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_all"))
    wanted = F.floor(F.col("_n") * buckets / F.col("_all")) > F.floor((F.col("_n") - 1) * buckets / F.col("_all"))
    cuts = ranked.where(wanted & (F.col("_n") < F.col("_all"))).agg(F.sort_array(F.collect_set("_key")).alias("cuts"))
    text, n = cuts.select(F.to_json("cuts"), F.size("cuts")).first()
    bounds = F.from_json(F.lit(text), f"array<{keys.schema['_key'].dataType.simpleString()}>")
    return _cuts_below(df, bounds, key, n, out)


def _comparable(df: DataFrame, names: Sequence[str], nulls_last: bool) -> list[Column]:
    """Values that sort as the columns do and survive being written as text."""
    out = []
    for i, name in enumerate(names):
        value, kind = F.col(name), df.schema[name].dataType.simpleString()
        if kind.startswith("timestamp"):
            value = F.unix_micros(value.cast("timestamp"))
        elif kind == "date":
            value = F.unix_date(value)
        elif kind == "binary":
            value = F.hex(value)
        elif kind in ("float", "double"):
            value = value.cast("double")
        absent = F.col(name).isNull() if nulls_last else F.col(name).isNotNull()
        out += [absent.alias(f"null{i}"), value.alias(f"value{i}")]
    return out


def _cuts_below(df: DataFrame, cuts: Column, key: Column, n: int, out: str) -> DataFrame:
    """Adds how many of ``n`` sorted cut points lie at or below the key."""
    found = df.withColumns({"_key": key, out: F.lit(0)})
    for i in reversed(range(n.bit_length())):
        step = 1 << i
        beyond = F.get(cuts, F.col(out) + (step - 1)) <= F.col("_key")
        found = found.withColumn(out, F.col(out) + F.when(beyond, step).otherwise(0))
    return found.drop("_key")


def dealt(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with ``_group``, dealt to tasks by (series, ``_bucket``)."""
    return df.withColumn("_group", series_key(groups)).repartition("_group", "_bucket")


def per_bucket(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row per (series, bucket) of dealt rows, with aggregates.

    ``_seen`` is made of every column, so that Spark reads the shuffled rows a second time here, instead of
    reading the input once more for the few columns that the aggregates need.
    """
    whole = [f.name for f in rows.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))]
    sums = rows.groupBy("_group", "_bucket").agg(*[v.alias(k) for k, v in values.items()], F.max(F.xxhash64(*whole)).alias("_seen"))
    return sums.where(F.col("_seen").isNotNull()).drop("_seen")


def with_positions(
    df: DataFrame,
    bucket: Column | str,
    order: Sequence[Column],
    groups: Sequence[str] = (),
    out: str = "position",
) -> DataFrame:
    """0-based position of every row in its group.

    ``bucket`` must rise with ``order``. Rows are dealt once by (group, bucket). They are counted there, the counts are
    summed along the buckets and handed on to later buckets, and only the rows of one bucket are ranked together;
    so a hot group is spread over its buckets.
    """
    keys = ["_group", "_bucket"]
    rows = dealt(df.withColumn("_bucket", F.col(bucket) if isinstance(bucket, str) else bucket), groups)
    earlier = (
        Window.partitionBy("_group")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = per_bucket(rows, {"_rows": F.count(F.lit(1))}).select(
        *keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.join(starts, keys)
        .withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
        .drop(*keys, "_start")
    )


def time_idx(
    df: DataFrame,
    groups: Sequence[str] = ("country",),
    time_col: str = "datetime",
    order: Sequence[str] = (),
    seconds: int | None = None,
    out: str = "time_idx",
    rows: int = BUCKET_ROWS,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """0-based position in time order within each series; ``order`` breaks equal times.

    Rows are ranked in buckets of days, or, in large frames, between cut points found from a sample of keys
    (``with_buckets``), so that no task ranks much more than ``rows`` rows. ``seconds`` asks for time buckets of that width instead.
    """
    columns = [F.col(c).asc_nulls_last() for c in (time_col, *order)]
    return with_positions(in_buckets(df, groups, time_col, order, seconds, rows, small_bytes), "_bucket", columns, groups, out)


def in_buckets(
    df: DataFrame, groups: Sequence[str], time_col: str, order: Sequence[str], seconds: int | None, rows: int, small_bytes: int
) -> DataFrame:
    """Rows with ``_bucket``: of ``seconds``, or as ``with_buckets`` finds them."""
    if seconds is not None:
        return df.withColumn("_bucket", time_bucket(F.col(time_col), seconds))
    return with_buckets(df, groups, time_col, order, "_bucket", rows, small_bytes)


def row_boundaries(
    df: DataFrame,
    ranks: Sequence[Column],
    order: Sequence[str],
    time_col: str = "datetime",
    rank_rows: int = RANK_ROWS,
) -> list[dict | None]:
    """The row found at each 1-based rank in the order (time, ``order``), as column values.

    ``ranks`` are expressions over the total row count ``_total``; ``order`` must make rows of
    equal time distinct. The time axis is narrowed by counting, from days to minutes to single
    timestamps, until the bucket that holds the rank has at most ``rank_rows`` rows; only those
    are ranked. Where a single timestamp holds more, its rows are cut into buckets along ``order`` and ranked there, so
    no task ranks more than about ``rank_rows`` rows. One row per rank reaches the driver; a rank of 0 gives None.
    Rows without a time are not counted.
    """
    rows = df.where(F.col(time_col).isNotNull()).withColumn("_us", F.unix_micros(time_col))
    counts = rows.groupBy(_micros_bucket(F.col("_us"), WIDTHS[0]).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.withColumns(
        {
            "_total": F.sum("_n").over(Window.partitionBy()),
            "_before": F.coalesce(F.sum("_n").over(running), F.lit(0)),
        }
    )
    wanted = F.array(*[r.cast("bigint") for r in ranks])
    rest = F.col("_rank") - F.col("_before")
    hits = (
        totals.select("_b", "_n", "_before", F.posexplode(wanted).alias("_which", "_rank"))
        .where((rest > 0) & (rest <= F.col("_n")))
        .select("_which", "_b", rest.alias("_rest"), "_n")
        .collect()
    )
    found = {h["_which"]: (h["_b"], h["_rest"], h["_n"]) for h in hits}
    width = WIDTHS[0]
    for finer in WIDTHS[1:]:
        if all(n <= rank_rows for _, _, n in found.values()):
            break
        found = _narrow(rows, found, time_col, width, finer)
        width = finer
    picked = _pick(rows, found, order, time_col, width, rank_rows)
    return [picked.get(i) for i in range(len(ranks))]


def _narrow(rows: DataFrame, found: dict, time_col: str, width: int, finer: int) -> dict:
    """The finer bucket that holds each wanted rank, found by counting inside the coarse ones."""
    fine = (
        rows.where(_in_buckets(time_col, {b for b, _, _ in found.values()}, width))
        .groupBy(
            _micros_bucket(F.col("_us"), width).alias("_p"),
            _micros_bucket(F.col("_us"), finer).alias("_b"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    along = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))

    def holds(p: int, rest: int) -> Column:
        inside = F.lit(rest) - F.col("_before")
        return (F.col("_p") == p) & (inside > 0) & (inside <= F.col("_n"))

    hits = fine.where(_any([holds(p, rest) for p, rest, _ in found.values()])).collect()
    return {
        which: next(
            (h["_b"], rest - h["_before"], h["_n"])
            for h in hits
            if h["_p"] == p and 0 < rest - h["_before"] <= h["_n"]
        )
        for which, (p, rest, _) in found.items()
    }


def _pick(rows: DataFrame, found: dict, order: Sequence[str], time_col: str, width: int, rank_rows: int) -> dict:
    """The time and order columns of each wanted row, ranked within its bucket."""
    if not found:
        return {}
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    near = rows.where(_in_buckets(time_col, {b for b, _, _ in found.values()}, width))
    keyed = near.select(_micros_bucket(F.col("_us"), width).alias("_b"), "_us", *order)
    along = [F.col("_us"), *[F.col(c).asc_nulls_first() for c in order]]
    if max(n for _, _, n in found.values()) > rank_rows:
        cut = with_buckets(keyed, ["_b"], None, ["_us", *order], "_bucket", rank_rows, 0, nulls_last=False)
        ranked = with_positions(cut, "_bucket", along, ["_b"], "_rank").withColumn("_rank", F.col("_rank") + 1)
    else:
        ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_b").orderBy(*along)))
    tests = [(F.col("_b") == b) & (F.col("_rank") == rest) for b, rest, _ in found.values()]
    at = {(h["_b"], h["_rank"]): h for h in ranked.where(_any(tests)).collect()}
    out = {}
    for which, (b, rest, _) in found.items():
        row = at[b, rest]
        out[which] = {"us": row["_us"], "ties": {c: F.lit(row[c]).cast(kinds[c]) for c in order}}
    return out


def at_or_before(boundary: dict | None, time_col: str) -> Column:
    """True for rows at or before a boundary row, in the order it was found in."""
    if boundary is None:
        return F.lit(False)
    time, stamp = F.col(time_col), F.timestamp_micros(F.lit(boundary["us"]))
    if not boundary["ties"]:
        return time <= stamp
    names = list(boundary["ties"])
    row = F.struct(*[F.col(c) for c in names])
    last = F.struct(*[v.alias(c) for c, v in boundary["ties"].items()])
    return (time <= stamp) & ((time < stamp) | (row <= last))


def before(boundary: dict, time_col: str) -> Column:
    """True for rows before a boundary row, in the order it was found in."""
    time, stamp = F.col(time_col), F.timestamp_micros(F.lit(boundary["us"]))
    if not boundary["ties"]:
        return time < stamp
    row = F.struct(*[F.col(c) for c in boundary["ties"]])
    last = F.struct(*[v.alias(c) for c, v in boundary["ties"].items()])
    return (time < stamp) | ((time == stamp) & (row < last))


def _any(tests: Sequence[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def _in_buckets(time_col: str, buckets: Iterable[int], width: int) -> Column:
    """Rows whose time lies in one of the buckets, as plain bounds that a scan can use."""
    return _any(
        [
            (F.col(time_col) >= F.timestamp_micros(F.lit(b * width)))
            & (F.col(time_col) < F.timestamp_micros(F.lit((b + 1) * width)))
            for b in sorted(set(buckets))
        ]
    )

"""Autocorrelation and partial autocorrelation of every series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.columns import as_double, null_safe
from loadcast.operators.bounds import broadcast_if_bounded
from loadcast.operators.windows import chunked

# Fixed value: 97.5 % point of the normal distribution, for a 95 % band.
Z95 = 1.959963984540054


def acf(
    df: DataFrame,
    lags: int = 60,
    value: str = "quantity_MW",
    group: str = "country",
    time_col: str = "datetime",
    order: Sequence[str] = (),
    seconds: int | None = None,
) -> DataFrame:
    """Autocorrelation for lags 0..``lags`` with the half width of its 95 % Bartlett band.

    Columns ``country, lag, acf, band``. Lags count rows; rows without a value are left out
    first. A constant series gives NULL.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_x", as_double(df, value))
    means = rows.groupBy(group).agg(F.avg("_x").alias("_mean"), F.count("_x").alias("_n"))
    centred = null_safe(rows, broadcast_if_bounded(means), [group]).withColumn("_x", F.col("_x") - F.col("_mean"))
    spread = chunked(centred, [group, "_n"], {"_xs": F.col("_x")}, lags, 0, [group], time_col, order, seconds=seconds)
    products = [F.expr(f"sum(get(_xs, _pos) * get(_xs, _pos - {k}))").alias(f"_p{k}") for k in range(lags + 1)]
    sums = spread.groupBy(group).agg(F.first("_n").alias("_n"), *products)
    table = sums.select(
        group, "_n", "_p0", F.posexplode(F.array(*[f"_p{k}" for k in range(lags + 1)])).alias("lag", "_p")
    ).where(F.col("lag") < F.col("_n"))
    r = table.withColumn("acf", F.col("_p") / F.nullif("_p0", F.lit(0.0)))
    before = Window.partitionBy(group).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    band = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(Z95 * F.sqrt((1 + 2 * squares) / F.col("_n")))
    return r.select(group, "lag", "acf", band.alias("band"), F.col("_n").alias("n"))


def pacf(
    df: DataFrame,
    lags: int = 60,
    value: str = "quantity_MW",
    group: str = "country",
    time_col: str = "datetime",
    order: Sequence[str] = (),
) -> DataFrame:
    """Partial autocorrelation (Yule-Walker) for lags 0..``lags``: ``country, lag, pacf, band``.

    The recursion runs over the array of a series' autocorrelations, ``lags + 1`` numbers, as an expression.
    """
    table = acf(df, lags, value, group, time_col, order)
    lists = table.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_r"), F.first("n").alias("_n")
    )
    solved = lists.select(group, "_n", F.posexplode(_levinson(F.col("_r.acf"))).alias("lag", "pacf"))
    band = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(Z95 / F.sqrt("_n"))
    return solved.select(group, "lag", "pacf", band.alias("band"))


def _levinson(r: Column) -> Column:
    """Partial autocorrelations from the autocorrelations r[0], r[1], …; NULL from where no variance is left on."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    def step(state: Column, k: Column) -> Column:
        phi, seen = state["phi"], F.slice(r, F.lit(2), k - 1)
        left = 1.0 - dot(phi, seen)
        last = F.when(state["going"] & (left > 0), (F.get(r, k) - dot(phi, F.reverse(seen))) / left)

        def extended(found: Column) -> Column:
            longer = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - found * b), F.array(found))
            return F.struct(longer.alias("phi"), F.concat(state["out"], F.array(found)).alias("out"), found.isNotNull().alias("going"))

        return F.get(F.transform(F.array(last), extended), F.lit(0))

    none = F.array().cast("array<double>")
    first = F.when(F.get(r, F.lit(0)).isNotNull(), 1.0)
    start = F.struct(none.alias("phi"), F.array(first).alias("out"), first.isNotNull().alias("going"))
    later = F.slice(F.sequence(F.lit(0), F.size(r)), F.lit(2), F.size(r) - 1)
    return F.aggregate(later, start, step, lambda state: state["out"])

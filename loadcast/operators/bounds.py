"""Broadcasting only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 10_000


def local_if_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """A local copy when ``df`` has at most ``max_rows`` rows, else None.

    At most ``max_rows + 1`` rows reach the driver. Later uses of the copy run no job.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return None if rows.num_rows > max_rows else df.sparkSession.createDataFrame(rows, df.schema)


def broadcast_if_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast local copy when ``df`` is within the bound, else ``df`` as it is.

    Beyond the bound Spark joins by shuffle and its adaptive skew handling applies.
    """
    local = local_if_bounded(df, max_rows)
    return df if local is None else F.broadcast(local)

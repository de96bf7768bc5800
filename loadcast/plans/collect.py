"""From landed load documents to the written hourly base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from loadcast.operators.clean import dedup_first, ffill, hourly_first
from loadcast.sources.documents import parse_load_periods, read_load_periods
from loadcast.sources.measurements import write_base


def collect_load(
    spark: SparkSession,
    landed: str,
    base: str,
    order: Sequence[str] = ("quantity_MW",),
    partition_by: Sequence[str] = ("country",),
) -> str:
    """Reads the documents below ``landed`` and writes the hourly panel to ``base``, whose path is returned.

    Documents are read period by period, so a large one is split among tasks. Points are made unique by (time, series), the first in ``order``; gaps take the last earlier value before the
    hour takes its first one, so an hour that begins with a gap is not left to a later reading. Points whose
    time cannot be read are left out; ``unread_points`` counts them, ``corrupt_periods`` what is no XML.
    """
    points = parse_load_periods(read_load_periods(spark, landed))
    unique = dedup_first(points.where("datetime is not null"), list(order))
    return write_base(hourly_first(ffill(unique)), base, partition_by)

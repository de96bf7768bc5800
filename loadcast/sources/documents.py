"""Load documents in XML and the grid of requests that fetches them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.clock import (
    parse_period_start,
    period_format,
    point_time_seconds,
    resolution_seconds,
)

_PERIOD = (
    "struct<timeInterval: struct<start: string>, resolution: string, "
    "Point: array<struct<position: int, quantity: double>>>"
)
# Periods stand below a series element or directly below the root.
DOCUMENT = f"TimeSeries array<struct<Period: array<{_PERIOD}>>>, Period array<{_PERIOD}>"

# Area code of each country and the codes of total load.
AREA_CODES = {
    "FR": "10YFR-RTE------C",
    "ES": "10YES-REE------0",
    "PT": "10YPT-REN------W",
}
LOAD_ITEM = {
    "key": "load_total",
    "documentType": "A65",
    "processType": "A16",
    "domainParam": "outBiddingZone_Domain",
}


def read_load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed files, one document per row as ``xml``; folders ``country=XX`` give the series."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml")


def land_documents(documents: DataFrame, path: str) -> str:
    """Writes one file per document (``country``, ``xml``) below ``country=…`` folders."""
    writer = documents.select("country", "xml").write.option("maxRecordsPerFile", 1)
    writer.partitionBy("country").text(path)
    return path


def parse_load_xml(df: DataFrame, xml: str = "xml", keep: Sequence[str] = ("country",)) -> DataFrame:
    """One row per point of every period in the documents.

    Columns ``keep``, ``position``, ``quantity_MW``, ``period_start``, ``resolution``,
    ``datetime``. Namespaces do not matter. Points without position or quantity are skipped;
    documents without a period, or that are not XML, give no rows. A resolution that is
    no duration of days, hours, minutes and seconds leaves ``datetime`` NULL (see ``unread_points``).
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    parsed = df.select(*keep, F.from_xml(F.col(xml), DOCUMENT, options).alias("_doc"))
    nested = F.flatten(F.transform(F.col("_doc.TimeSeries"), lambda s: F.coalesce(s["Period"], F.array())))
    none = F.array().cast(f"array<{_PERIOD}>")
    periods = F.concat(F.coalesce(nested, none), F.coalesce(F.col("_doc.Period"), none))
    return _points(parsed.select(*keep, F.explode(periods).alias("_p")), keep)


def _points(periods: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per complete point of the periods ``_p``."""
    points = (
        periods.select(
            *keep,
            F.col("_p.timeInterval.start").alias("period_start"),
            F.col("_p.resolution").alias("resolution"),
            F.inline("_p.Point"),
        )
        .where(F.col("position").isNotNull() & F.col("quantity").isNotNull())
    )
    start = parse_period_start(F.col("period_start"))
    time = point_time_seconds(start, F.col("position"), resolution_seconds(F.col("resolution")))
    return points.select(
        *keep,
        "position",
        F.col("quantity").alias("quantity_MW"),
        "period_start",
        "resolution",
        time.alias("datetime"),
    )


def read_load_periods(spark: SparkSession, path: str, tag: str = "Period") -> DataFrame:
    """Landed files, one period per row as ``xml``; folders ``country=XX`` give the series.

    Files are read as text records that end where a period does, so a document of any size, in one line or many, is split
    among tasks and no row is longer than a period and what stands before it. ``tag`` is the element's name as written, with
    its prefix if it has one. A file that breaks off inside a period ends in a row that is not XML, which
    ``corrupt_periods`` counts; what follows the last period of a file is no row.
    """
    parts = spark.read.option("lineSep", f"</{tag}>").text(path).withColumnRenamed("value", "xml")
    begun = F.regexp_extract("xml", rf"(?s)^.*(<{tag}[\s>].*)$", 1)
    whole = F.concat(begun, F.lit(f"</{tag}>"))
    return parts.select(whole.alias("xml"), *[c for c in parts.columns if c != "xml"], begun.alias("_begun")).where("_begun <> ''").drop("_begun")


def parse_load_periods(df: DataFrame, xml: str = "xml", keep: Sequence[str] = ("country",)) -> DataFrame:
    """As ``parse_load_xml``, from rows of one period each; periods that cannot be read give no rows (``corrupt_periods``)."""
    return _points(_parsed_periods(df, xml, keep), keep)


def corrupt_periods(df: DataFrame, xml: str = "xml") -> DataFrame:
    """How many periods there are, and how many of them cannot be read as XML."""
    parsed = _parsed_periods(df, xml, ())
    bad = F.col("_p._corrupt").isNotNull() | F.col("_p").isNull()
    return parsed.agg(F.count(F.lit(1)).alias("periods"), F.count_if(bad).alias("corrupt"))


def _parsed_periods(df: DataFrame, xml: str, keep: Sequence[str]) -> DataFrame:
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    schema = _PERIOD.removesuffix(">") + ", _corrupt: string>"
    return df.select(*keep, F.from_xml(F.col(xml), schema, options).alias("_p"))


def unread_points(points: DataFrame) -> DataFrame:
    """How many parsed points have no time, by resolution and whether the period's start could be read."""
    unread = points.where(F.col("datetime").isNull())
    readable = parse_period_start(F.col("period_start")).isNotNull().alias("start_read")
    return unread.groupBy("resolution", readable).agg(F.count(F.lit(1)).alias("points"))


def build_load_xml(df: DataFrame, minutes: int = 1) -> DataFrame:
    """Readings as documents: one per series and day, with a point per ``minutes`` step.

    The rows must hold at most one reading per step, which bounds a document by the steps of
    a day; a second one is an error. The inverse of ``parse_load_xml``, to land measurements in the same format.
    """
    day = F.date_trunc("day", "datetime")
    offset = F.unix_seconds("datetime") - F.unix_seconds(day)
    point = F.struct(
        (F.floor(offset / (60 * minutes)) + 1).cast("int").alias("position"),
        F.col("quantity_MW").alias("quantity"),
    )
    held = F.sort_array(F.collect_list(point))
    steps = F.array_distinct(F.transform(held, lambda p: p["position"]))
    once = F.when(F.size(steps) == F.size(held), held).otherwise(F.raise_error(F.lit("two readings in one step")))
    days = df.groupBy("country", day.alias("_day")).agg(once.alias("_points"))
    period = F.struct(
        F.struct(F.date_format("_day", "yyyy-MM-dd'T'HH:mm'Z'").alias("start")).alias("timeInterval"),
        F.lit(f"PT{minutes}M").alias("resolution"),
        F.col("_points").alias("Point"),
    )
    document = F.struct(F.struct(period.alias("Period")).alias("TimeSeries"))
    return days.select("country", F.to_xml(document, {"rowTag": "Document"}).alias("xml"))


def request_grid(
    series: DataFrame,
    start: Column,
    end: Column,
    column: str = "country",
    codes: dict[str, str] = AREA_CODES,
) -> DataFrame:
    """One request per series and day from ``start`` (inclusive) to ``end`` (exclusive).

    ``start`` and ``end`` are literals or columns of ``series``, which has one row per series.
    Columns ``item, document_type, process_type, domain, country, day, period_start,
    period_end``; ``domain`` is the area code of the series, NULL if it has none.
    """
    domain = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    day = F.make_dt_interval(days=F.lit(1))
    bounded = series.select(column, start.alias("_from"), end.alias("_to"))
    days = bounded.where(F.col("_from") < F.col("_to")).select(
        column, "_to", F.explode(F.sequence("_from", "_to", day)).alias("day")
    )
    return days.where(F.col("day") < F.col("_to")).select(
        F.lit(LOAD_ITEM["key"]).alias("item"),
        F.lit(LOAD_ITEM["documentType"]).alias("document_type"),
        F.lit(LOAD_ITEM["processType"]).alias("process_type"),
        F.try_element_at(domain, F.col(column)).alias("domain"),
        column,
        "day",
        period_format(F.col("day")).alias("period_start"),
        period_format(F.col("day") + day).alias("period_end"),
    )

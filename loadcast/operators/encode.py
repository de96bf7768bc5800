"""Label encoding with a fitted dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.columns import UNKNOWN_LABEL, label_text
from loadcast.operators.bounds import MAX_BROADCAST_ROWS, broadcast_if_bounded, local_if_bounded
from loadcast.operators.positions import BUCKET_ROWS, with_buckets, with_positions
from loadcast.session import scratch_path


def label_fit(df: DataFrame, columns: Sequence[str], rows: int = BUCKET_ROWS, local_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Dictionary ``(col, label, code)``: sorted labels 0..n-1, and ``__unknown__`` as n.

    NULL has a label of its own. If ``__unknown__`` occurs as a value it keeps its sorted code. The distinct labels are
    fetched if they are at most ``local_rows``, else written to a scratch table once; there they are cut into ranges of
    about ``rows`` labels at points taken from a sample, whatever they begin with, and ranked range by range.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), label_text(c).alias("label")) for c in columns])
    labels = df.select(F.inline(pairs)).distinct()
    local = local_if_bounded(labels, local_rows)
    if local is None:
        path = scratch_path(df.sparkSession, "labels")
        labels.write.parquet(path)
        labels = with_buckets(df.sparkSession.read.parquet(path), ["col"], None, ["label"], "_bucket", rows, 0)
    else:
        labels = local.withColumn("_bucket", F.lit(0))
    codes = with_positions(labels, "_bucket", [F.col("label")], ["col"], "code")
    unknown = (
        codes.groupBy("col")
        .agg(
            (F.max("code") + 1).alias("code"),
            F.max(F.col("label") == UNKNOWN_LABEL).alias("_taken"),
        )
        .where(~F.col("_taken"))
        .select("col", F.lit(UNKNOWN_LABEL).alias("label"), "code")
    )
    return codes.unionByName(unknown).withColumn("code", F.col("code").cast("int"))


def label_encode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Labels replaced by their codes; a label that was not fitted gets the unknown code."""

    def encode(frame: DataFrame, name: str) -> DataFrame:
        codes = dictionary.where(F.col("col") == name).select("label", "code")
        known = broadcast_if_bounded(codes)
        other = known.where(F.col("label") == UNKNOWN_LABEL).first()
        joined = frame.withColumn("_label", label_text(name)).join(
            known.toDF("_label", "_code"), "_label", "left"
        )
        code = F.coalesce("_code", F.lit(other["code"] if other else None)).cast("int")
        return joined.withColumn(name, code).select(*frame.columns)

    return reduce(encode, columns, df)


def label_decode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes replaced by their labels; NULL for a code that does not exist."""

    def decode(frame: DataFrame, name: str) -> DataFrame:
        labels = dictionary.where(F.col("col") == name).select(
            F.col("code").alias("_code"), F.col("label").alias("_label")
        )
        joined = frame.withColumn("_code", F.col(name).cast("int")).join(
            broadcast_if_bounded(labels), "_code", "left"
        )
        return joined.withColumn(name, F.col("_label")).select(*frame.columns)

    return reduce(decode, columns, df)


def apply_codes(df: DataFrame, dictionary: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the code of ``column`` as ``out`` and keeps the label."""
    return label_encode(df.withColumn(out, F.col(column)), dictionary_as(dictionary, column, out), [out])


def dictionary_as(dictionary: DataFrame, column: str, name: str) -> DataFrame:
    """The dictionary of ``column`` under another column name."""
    return dictionary.where(F.col("col") == column).withColumn("col", F.lit(name))

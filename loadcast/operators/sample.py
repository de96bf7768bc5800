"""Seeded samples and shuffles that do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.columns import series_key
from loadcast.functions.noise import hash_number
from loadcast.operators.bounds import broadcast_if_bounded, local_if_bounded
from loadcast.operators.positions import TARGET_BUCKET_ROWS, with_positions

HASH_BITS = 48
MAX_BUCKET_BITS = 20


def _hashed(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Rows with their ``_hash`` and its leading bits as ``_slot``.

    The number of slots follows the number of rows, so that one slot is a task of ordinary size.
    """
    bits = min(max(math.ceil(math.log2(max(df.count(), 1) / TARGET_BUCKET_ROWS)), 0) + 2, MAX_BUCKET_BITS)
    row_key = F.concat_ws("|", *[_part(c) for c in key])
    hashed = df.withColumn("_hash", hash_number(row_key, seed))
    return hashed.withColumn("_slot", F.shiftright("_hash", HASH_BITS - bits))


def _part(name: str) -> Column:
    """A key column as text of its own: bars and backslashes inside are marked, and NULL is no text."""
    marked = F.regexp_replace(F.col(name).cast("string"), r"([|\\])", r"\\$1")
    return F.coalesce(marked, F.lit("\\N"))


def _slot(hash_col: str, fraction: float) -> Column:
    """Number of a hash slot; it rises with the hash. Slots are the narrower the nearer they lie to ``fraction`` of
    the range, eight to each doubling of the distance, so a sample ends in a slot of about the square root of its
    group's rows, however many these are."""
    away = F.col(hash_col) - F.lit(int(fraction * (1 << HASH_BITS)))
    far = F.abs(away)
    bits = F.length(F.bin(far))
    slot = bits * 8 + F.call_function("shiftright", F.shiftleft(far, 4), bits)
    return F.when(away >= 0, slot).otherwise(-slot).cast("int")


def sample_per_group(
    df: DataFrame, fraction: float, key: Sequence[str], groups: Sequence[str] = ("country",), seed: int = 42
) -> DataFrame:
    """``round(fraction * n)`` rows of every group without replacement (half rounds to even).

    Rows are taken in the order of a seeded hash of their key, so the sample is exact and the
    same under any partitioning. Two jobs read the key and group columns only: counts per hash slot (at most some 800
    a group) tell in which slot a group's sample ends, and the keys of that slot tell after which one. The
    sample itself is then a filter that moves no row. Only where a key at a group's end is repeated, and not all its rows are
    wanted, are those rows dealt out and counted.
    """
    row_key = F.concat_ws("|", *[_part(c) for c in key])
    slotted = df.withColumns({"_group": series_key(groups), "_hash": hash_number(row_key, seed)}).withColumn("_slot", _slot("_hash", fraction))
    counts = slotted.groupBy("_group", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.bround(F.sum("_n").over(Window.partitionBy("_group")).cast("double") * F.lit(float(fraction)), 0).cast("bigint")
    ends = _reaching(counts.withColumn("_wanted", wanted), ["_slot"]).select("_group", F.col("_slot").alias("_end"), F.col("_rest").alias("_wanted"))
    edge = slotted.join(broadcast_if_bounded(ends), "_group").where(F.col("_slot") == F.col("_end"))
    names = [f"_last{i}" for i in range(len(key))]
    keys = edge.select("_group", "_end", "_wanted", "_hash", *[F.col(c).alias(n) for c, n in zip(key, names)])
    same = keys.groupBy("_group", "_end", "_wanted", "_hash", *names).agg(F.count(F.lit(1)).alias("_n"))
    last = _reaching(same, ["_hash", *names]).select(
        "_group", "_end", F.col("_hash").alias("_last"), *names, F.col("_rest").alias("_ties"), (F.col("_rest") < F.col("_n")).alias("_some")
    )
    local = local_if_bounded(last)
    bounded = slotted.join(last if local is None else F.broadcast(local), "_group")
    own, end = F.struct("_hash", *key), F.struct(F.col("_last").alias("_hash"), *[F.col(n).alias(c) for c, n in zip(key, names)])
    sure = bounded.where((F.col("_slot") < F.col("_end")) | ((F.col("_slot") == F.col("_end")) & F.when(F.col("_some"), own < end).otherwise(own <= end)))
    if local is not None and local.where("_some").isEmpty():
        return sure.select(*df.columns)
    tied = bounded.where(F.col("_some") & (F.col("_slot") == F.col("_end")) & (own == end))
    numbered = tied.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy("_hash")))
    return sure.select(*df.columns).union(numbered.where(F.col("_rank") <= F.col("_ties")).select(*df.columns))


def _reaching(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """The row of each group at which its running ``_n`` reaches ``_wanted``, with what that row gives as ``_rest``."""
    running = Window.partitionBy("_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("_wanted") - F.coalesce(F.sum("_n").over(running), F.lit(0))
    return counts.withColumn("_rest", rest).where((F.col("_rest") > 0) & (F.col("_rest") <= F.col("_n")))


def shuffle_batches(df: DataFrame, size: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A seeded shuffle: ``shuffle_rank`` is the new position, ``batch_id`` the batch it falls in."""
    hashed = _hashed(df, key, seed)
    order = [F.col("_hash"), *[F.col(c) for c in key]]
    ranked = with_positions(hashed, F.col("_slot"), order, (), "shuffle_rank").drop("_hash", "_slot")
    return ranked.withColumn("batch_id", F.expr(f"shuffle_rank div {int(size)}"))

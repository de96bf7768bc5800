"""What several of these operators need: tables, lineage cuts, streams of sorted rows, links to components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side may have at most to be broadcast; callers count first and join by shuffle beyond it.
BROADCAST_ROWS = 200_000
#: The same in bytes, where values may be long.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master only; on a
    cluster executors could not read each other's files there, so it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loadcast-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that losing executors repeats nothing before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows read back from a Parquet table in the shared folder, and its path; ``remove`` it after use."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def light(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its counted bytes are few; otherwise Spark joins by shuffle. Columns must cast to text."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= bound else df


def complete(vector: Column) -> Column:
    """Whether a vector is there and holds neither a null nor a non-finite component."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    return F.coalesce(fine, F.lit(False))


def floors(vector: Column, scale: int, bound: int) -> Column:
    """Components as the integers floor(scale * x), held between -bound and bound."""
    limit = float(bound)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("int"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of 64-bit integers; shorter lists end in zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), kind))


def squared_distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from integer points; doubles hold them where they are small enough."""
    most = int(max(np.abs(x).max(initial=0), np.abs(points).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), points.astype(np.float64)
        return ((b * b).sum(axis=1) - 2 * (a @ b.T) + (a * a).sum(axis=1)[:, None]).astype(np.int64)
    return np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)


def nearest_points(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, index) of the nearest point to each row; ties to the lower index."""
    d = squared_distances(x, points)
    at = d.argmin(axis=1)
    return d[np.arange(len(x)), at], at


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its counted rows are few; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows <= bound else df


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the position from 0 in a global order; ties take any order. No task holds all rows."""
    placed = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    inner = placed.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    joined = inner.join(starts, "_part")
    return joined.withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_part", "_start")


def runs_of(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[pa.RecordBatch]]:
    """Of a stream sorted by integer keys: the pieces of each stretch of whole key groups, batch by batch.

    Each list holds whole groups only; a group that goes on in the next batch is carried over.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield held
            held = []
        starts = np.flatnonzero(change)
        if len(starts):
            last = int(starts[-1])
            yield [*held, batch.slice(0, last)]
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield held


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links between integer nodes: rows (node, root).

    Nodes without a link to another node have no row. Alternates large and small stars until the links no
    longer change (each is then a node and its smallest reachable node); the number of rounds grows with the
    logarithm of the largest component. Every round is cut, and only its row count and checksum reach the driver.
    """
    edges = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        edges = cut(_star(_star(edges, large=True), large=False))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or not larger) neighbour of a node to the least node around it."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
    return out.where("u != v").distinct()

"""Exact k-means whose bounds are loosened by plane geometry, so that most vectors are not scanned in a round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.llm.common import complete, cut, floors, matrix, remove, squared_distances, written

#: Centroids, rounds, components of a vector, integers per unit, and what precedes an id where seeds are drawn.
CENTROIDS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
#: Integers are held to this size, so that every squared distance of vectors up to 128 wide is exact in 64 bits.
BOUND = 1 << 26
#: What bounds give way to rounding: relative to the numbers added, and relative to a centroid's drift.
SLACK, DRIFT_SLACK = 1e-12, 1e-6


@dataclass
class Motion:
    """Centroids, and how bounds on distances to the earlier ones become bounds on distances to these."""

    centres: np.ndarray
    drift: np.ndarray
    loosen: np.ndarray
    half: np.ndarray


def plane_loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``out[i, j]``: how much nearer centroid j can have come to any point within ``radius[i]`` of the old centroid i.

    With a, b the old and new centroid j, m their middle and D their distance, |x - a| - |x - b| is
    2 (x - m)·(b - a) / (|x - a| + |x - b|), and the denominator is at least 2 |x - m|. So the gain is at most
    D cos φ, φ being the angle at m between b - a and x - m. In the plane through a, b and the sphere's centre,
    the sphere lies within β = asin(r / R) of the direction to its centre, R away at the angle φ₀; so no
    point of it gains more than D cos(φ₀ - β), none gains anything beyond a right angle, and the full drift D is
    the bound only for φ₀ <= β or a sphere around m.
    """
    k = len(old)
    out = np.zeros((k, k))
    for j in range(k):
        move = new[j] - old[j]
        d = float(np.sqrt(move @ move))
        if not d:
            continue
        for i in range(k):
            w = old[i] - (old[j] + new[j]) / 2
            far = float(np.sqrt(w @ w))
            out[i, j] = d
            if i != j and radius[i] < far:
                cos0 = min(1.0, max(-1.0, float(w @ move) / (far * d)))
                sin_b = radius[i] / far
                cos_b = (1 - sin_b * sin_b) ** 0.5
                if cos0 < cos_b:
                    gain = d * (cos0 * cos_b + (1 - cos0 * cos0) ** 0.5 * sin_b)
                    out[i, j] = min(d, max(0.0, gain) + DRIFT_SLACK * d)
    return out


def motion(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Motion:
    """Drift of each centroid, loosening of each cluster's lower bounds, and half the way to its nearest other centroid."""
    k = len(new)
    a, b = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((b - a) ** 2).sum(axis=1))
    others = ~np.eye(k, dtype=bool)
    loosen = np.where(others, plane_loosening(a, b, radius), 0.0).max(axis=1, initial=0.0)
    between = np.where(others, np.sqrt(((b[:, None] - b[None]) ** 2).sum(axis=2)), np.inf).min(axis=1, initial=np.inf)
    return Motion(new, drift, loosen, between / 2 * (1 - SLACK))


def scan(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bound) by exact distances to all centroids, ties to the smaller number."""
    d = squared_distances(x, centres)
    at, row = d.argmin(axis=1), np.arange(len(x))
    root = np.sqrt(d.astype(np.float64))
    upper = root[row, at] * (1 + SLACK)
    root[row, at] = np.inf
    return at, upper, root.min(axis=1) * (1 - SLACK)


def own_distance(x: np.ndarray, centres: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((x - centres[at]) ** 2).sum(axis=1)


def advance(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, m: Motion) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids moved, and how many vectors were scanned.

    The upper bound grows by the own centroid's drift, the lower one gives way by its cluster's loosening. Where the
    upper bound stays below the lower one, or below half the way to the nearest other centroid, the cluster
    stands. Others get their exact own distance as upper bound; those still in doubt, ties among them, are scanned.
    """
    at, upper = at.copy(), (upper + m.drift[at]) * (1 + SLACK)
    loosen = m.loosen[at]
    lower = np.where(np.isinf(lower), lower, lower - loosen - SLACK * (lower + loosen))
    limit = np.maximum(lower, m.half[at])
    doubt = np.flatnonzero(upper >= limit)
    if len(doubt):
        upper[doubt] = np.sqrt(own_distance(x[doubt], m.centres, at[doubt]).astype(np.float64)) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= limit[doubt]]
    if len(doubt):
        at[doubt], upper[doubt], lower[doubt] = scan(x[doubt], m.centres)
    return at, upper, lower, len(doubt)


def _state(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower"))


def _pass(df: DataFrame, m: Motion, width: int, first: bool, last: bool) -> DataFrame:
    """One assignment of rows (id, v, cluster, upper, lower); the last one gives (id, cluster, distance)."""
    fields = [T.StructField("id", df.schema["id"].dataType)]
    if last:
        fields += [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    else:
        fields += [T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType())]
        fields += [T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width)
            at, upper, lower = scan(x, m.centres) if first else advance(x, *_state(batch), m)[:3]
            out = {"id": batch.column("id"), "v": batch.column("v"), "cluster": pa.array(at.astype(np.int32)), "upper": pa.array(upper), "lower": pa.array(lower)}
            if last:
                out["distance"] = pa.array(own_distance(x, m.centres, at))
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return df.mapInArrow(run, T.StructType(fields))


def _next(state: DataFrame, centres: np.ndarray) -> Motion:
    """The motion after a round: floors of exact means, spheres from the largest upper bound of each cluster.

    One number per centroid and component leaves a task and, added up, reaches the driver.
    """
    k, width = centres.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, radius = np.zeros((k, width + 1), dtype=np.int64), np.zeros(k)
        for batch in batches:
            x = matrix(batch.column("v"), width)
            at, upper = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper"))
            for j in range(k):
                mine = at == j
                total[j, 0] += mine.sum()
                total[j, 1:] += x[mine].sum(axis=0)
                radius[j] = max(radius[j], upper[mine].max(initial=0.0))
        slot = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.reshape(-1)), pa.array(np.repeat(radius, width + 1))], ["slot", "value", "high"])

    partial = state.select("v", "cluster", "upper").mapInArrow(run, "slot long, value long, high double")
    sums, radius = np.zeros(k * (width + 1), dtype=object), np.zeros(k)
    for slot, value, high in partial.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")), F.max("high")).collect():
        sums[slot], radius[slot // (width + 1)] = int(value), high
    sums = sums.reshape(k, width + 1)
    new = centres.copy()
    used = sums[:, 0] > 0
    new[used] = (sums[used, 1:] // sums[used, :1]).astype(np.int64)
    return motion(centres, new, radius)


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) and the integer centroids: Lloyd's rounds on floor(scale * x), squared distances,
    ties to the smaller number, exactly as if all distances were compared.

    Centroids start as the ``k`` vectors whose SHA-256 of ``seed:id`` is smallest (all, if there are fewer; null ids come
    last, equal ids in order of their vectors). A round assigns all vectors, then moves each centroid that has any to the
    floor of their mean; in the end vectors are assigned once more. Each vector keeps an upper bound on the distance
    to its centroid and a lower bound on that to any other; see ``plane_loosening`` and ``advance``.

    Vectors of another width than ``width``, null ones and ones with a null or non-finite component have no row;
    every other row has one, repeated ones and null ids too. Integers beyond ``BOUND`` count as ``BOUND``. An empty
    table gives no rows and no centroids. Other columns are not read. No row is shuffled: clusters and bounds are
    written beside each vector, read where they lie and deleted once the next ones are written.
    """
    spark, vector = vectors.sparkSession, F.col(vector_col)
    fits = complete(vector) & (F.size(vector) == width)
    kept = vectors.where(fits).select(F.col(id_col).alias("id"), floors(vector, scale, BOUND).alias("v"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = kept.orderBy(drawn.asc_nulls_last(), "v").limit(k).select("v").toArrow().column("v").combine_chunks()
    if not len(seeds):
        kind = kept.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long"), np.zeros((0, width), dtype=np.int64)
    start = matrix(seeds, width)
    state, before, now = kept, None, motion(start, start, np.zeros(len(start)))
    for n in range(rounds):
        state, path = written(_pass(state, now, width, n == 0, False), "clusters")
        if before:
            remove(spark, before)
        before, now = path, _next(state, now.centres)
    out = cut(_pass(state, now, width, rounds == 0, True))
    if before:
        remove(spark, before)
    return out, now.centres


def centroid_sha256(centres: np.ndarray) -> list[str]:
    """Of each centroid's components as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]


def with_inertia(clustered: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (null beyond a long) and ``centroid_sha256``; one sum per centroid reaches the driver."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r[0]: int(r[1]) for r in clustered.groupBy("cluster").agg(total).collect()}
    fit = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")

    def of(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("cluster")) if values else F.lit(None)

    own = of([fit(sums.get(j, 0)) for j in range(len(centres))]).cast("long")
    return clustered.withColumns(
        {
            "cluster_inertia": own,
            "inertia": fit(sum(sums.values())),
            "centroid_sha256": of([F.lit(h) for h in centroid_sha256(centres)]).cast("string"),
        }
    )

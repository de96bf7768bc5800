"""Approximate nearest neighbours by a forest of random-projection trees with one shared priority queue."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.llm.common import cut, runs_of

TREES = 12
#: Vectors that the trees are fitted on at most (fewer for long vectors), and of those in a fitted leaf.
SAMPLE, SAMPLE_FLOATS, LEAF = 20_000, 4_000_000, 64
#: Vectors in a cell that further random splits aim at, and cells that a query visits at least.
CELL, VISITS = 256, 320
#: Queries whose true neighbours are found by comparing all, and the share of these that the visits must reach.
PROBES, REACH = 200, 0.93


@dataclass
class Forest:
    """Trees as arrays. Children below zero are leaves (``~leaf``). Leaves are split ``extra`` times more by random
    hyperplanes through their centre, so cells stay small however many vectors there are."""

    normals: list[np.ndarray]
    offsets: list[np.ndarray]
    children: list[np.ndarray]
    centres: list[np.ndarray]
    bank: np.ndarray
    extra: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector in each tree."""
        out = np.empty((len(x), len(self.normals)), dtype=np.int64)
        for t, (normal, offset, child, centre) in enumerate(zip(self.normals, self.offsets, self.children, self.centres)):
            node = np.zeros(len(x), dtype=np.int64)
            if not len(normal):
                node[:] = -1
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                right = np.einsum("ij,ij->i", x[inner], normal[at]) > offset[at]
                node[inner] = child[at, right.astype(int)]
            leaf = ~node
            cell = leaf
            for level in range(self.extra):
                cell = cell << 1 | (np.einsum("ij,j->i", x - centre[leaf], self.bank[t, level]) > 0)
            out[:, t] = cell
        return out

    def search(self, x: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The first (tree, cell) pairs for a query."""
        return list(islice(self.walk(x), visits))

    def reached(self, x: np.ndarray, near: np.ndarray, most: int) -> list[int]:
        """After how many visits each vector, given by its cell in each tree, is met."""
        waiting: dict[tuple[int, int], list[int]] = {}
        for i, cells in enumerate(near.tolist()):
            for t, cell in enumerate(cells):
                waiting.setdefault((t, cell), []).append(i)
        met: dict[int, int] = {}
        for n, at in enumerate(self.walk(x), 1):
            for i in waiting.get(at, ()):
                met.setdefault(i, n)
            if len(met) == len(near):
                break
        return [met.get(i, most) for i in range(len(near))]

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, cell) pairs for a query, from one queue for all trees ordered by squared distance over the planes crossed."""
        margins = [(n @ x - o).tolist() for n, o in zip(self.normals, self.offsets)]
        queue: list[tuple] = []
        for t, m in enumerate(margins):
            heappush(queue, (0.0, t, 0 if m else -1, 0, 0))
        sides: dict[tuple[int, int], list[float]] = {}
        while queue:
            cost, t, node, level, bits = heappop(queue)
            while node >= 0:
                m = margins[t][node]
                near = int(m > 0)
                heappush(queue, (cost + m * m, t, int(self.children[t][node, 1 - near]), 0, 0))
                node = int(self.children[t][node, near])
            if level < self.extra:
                key = (t, node)
                if key not in sides:
                    sides[key] = (self.bank[t, : self.extra] @ (x - self.centres[t][~node])).tolist()
                for i in range(level, self.extra):
                    m = sides[key][i]
                    heappush(queue, (cost + m * m, t, node, i + 1, bits << 1 | int(m <= 0)))
                    bits = bits << 1 | int(m > 0)
            yield t, ~node << self.extra | bits


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, cell: int = CELL, seed: int = 4) -> Forest:
    """Trees on a sample of unit vectors. Each split lies between two random vectors of its node, at the median."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if len(sample) else 1
    share = rows / max(1, len(sample))
    extra = max(0, int(np.ceil(np.log2(max(1.0, leaf * share / cell)))))
    bank = rng.normal(size=(trees, max(1, extra), dim))
    bank /= np.linalg.norm(bank, axis=2, keepdims=True)
    parts: list[list] = [[], [], [], []]
    for _ in range(trees):
        normals, offsets, children, centres = [], [], [], []
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            mine, parent, side = todo.pop()
            split = None
            for _ in range(4 if len(mine) > leaf else 0):
                a, b = sample[rng.choice(mine, 2, replace=False)]
                gap = np.linalg.norm(a - b)
                if gap > 1e-9:
                    normal = (a - b) / gap
                    at = sample[mine] @ normal
                    middle = float(np.median(at))
                    right = at > middle
                    if 0.1 < right.mean() < 0.9:
                        split = normal, middle, right
                        break
            if split:
                number = len(normals)
                normals.append(split[0])
                offsets.append(split[1])
                children.append([0, 0])
                todo += [(mine[~split[2]], number, 0), (mine[split[2]], number, 1)]
            else:
                number = ~len(centres)
                centres.append(sample[mine].mean(axis=0) if len(mine) else np.zeros(dim))
            if parent >= 0:
                children[parent][side] = number
        parts[0].append(np.array(normals).reshape(-1, dim))
        parts[1].append(np.array(offsets))
        parts[2].append(np.array(children, dtype=np.int64).reshape(-1, 2))
        parts[3].append(np.array(centres).reshape(-1, dim))
    return Forest(*parts, bank, extra)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    visits: int = VISITS,
    trees: int = TREES,
) -> DataFrame:
    """For every query row the ``k`` nearest other rows found: (query_id, rank, vec_id, score), by cosine.

    Equal vectors are indexed and searched once, with their k + 1 smallest ids, which is all that their answers can
    need; so neither a common vector nor a common query is a hot key. The trees are fitted on a hash sample of
    at most ``SAMPLE`` distinct vectors, and every vector is indexed in a cell of each tree. Vectors and queries
    that meet in a cell are compared there; scores are computed in double precision from the vectors as given, scaled by
    powers of two only, so very large and very small components neither overflow nor vanish.
    For a hash sample of ``PROBES`` queries all vectors are compared, and every query visits at least as many cells as
    reach ``REACH`` of their true neighbours, so visits grow with the table as recall needs.
    Should any query have found fewer than k, all are searched again with more visits, up to all cells.

    Rows without an id, null vectors, those with a null, infinite or NaN component, zero vectors and vectors of
    another length than most take no part, as queries neither. Ties go to the smaller id. Repeated rows count
    once. With fewer than k candidates a query gets them all; an empty table gives no rows.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    component = F.col(vector_col) if kind == "float" else F.transform(vector_col, lambda v: v.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), component.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = lengths["n"] if lengths else 1
    keyed = rows.where(F.size("v") == dim).withColumn("key", F.xxhash64("v"))
    single = keyed.groupBy("key", "id").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
    lowest = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    kept = single.withColumn("n", lowest).where(F.col("n") <= k + 1)
    distinct = cut(kept.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = cut(single.where("asks").select(F.col("id").alias("query_id"), "key"))
    n = distinct.count()
    most = min(SAMPLE, SAMPLE_FLOATS // dim)
    drawn = F.pmod(F.xxhash64(F.lit(4), "key"), F.lit(1 << 30)) / float(1 << 30)
    sample = distinct.where(drawn < min(1.0, most / max(1, n))).select("key", "v").orderBy("key").toArrow().column("v")
    points = np.array(sample.to_pylist(), dtype=np.float64).reshape(-1, dim)
    forest = fit(_unit(points), n, trees)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)
    searched = distinct.join(asked.select("key").distinct(), "key", "left_semi")
    every = sum(len(c) for c in forest.centres) << forest.extra
    visits = max(visits, _needed(distinct, searched, forest, shared, dim, k, every)) if every > visits else visits
    while True:
        answers = _answers(distinct, searched, asked, shared, dim, k, visits, kind == "float")
        if visits >= every or n <= 1:
            return answers
        answers = cut(answers)
        if not answers.groupBy("query_id").count().where(F.col("count") < k).limit(1).count():
            return answers
        visits *= 8


def _needed(distinct: DataFrame, searched: DataFrame, forest: Forest, shared, dim: int, k: int, every: int) -> int:
    """Cells that a query must visit so that ``REACH`` of the ``k`` nearest distinct vectors of sampled queries lie in them."""
    probes = searched.orderBy(F.xxhash64(F.lit(5), "key"), "key").limit(PROBES).select("key", "v").toArrow()
    if not probes.num_rows:
        return 1
    keys, asked = probes.column("key").to_numpy(), _unit(_matrix(probes.column("v").combine_chunks(), dim))
    sent = distinct.sparkSession.sparkContext.broadcast((keys, asked))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        for b in batches:
            key = b.column("key").to_numpy()
            for at in range(0, len(key), 4096):
                part = key[at : at + 4096]
                x = _unit(_matrix(b.column("v").slice(at, len(part)), dim))
                cosine = np.where(own[:, None] == part[None, :], -np.inf, q @ x.T)
                keep = min(k, len(part))
                best = np.argpartition(-cosine, keep - 1, axis=1)[:, :keep]
                who, c = np.repeat(np.arange(len(q)), keep), best.reshape(-1)
                right = np.isfinite(cosine[who, c])
                who, c = who[right], c[right]
                cells = shared.value.cells(x[np.unique(c)])[np.searchsorted(np.unique(c), c)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who), pa.array(cosine[who, c]), pa.array(part[c]), pa.array(cells.tolist(), pa.list_(pa.int64()))], ["probe", "cosine", "key", "cells"]
                )

    found = distinct.select("key", "v").mapInArrow(scan, "probe long, cosine double, key long, cells array<long>")
    order = Window.partitionBy("probe").orderBy(F.desc("cosine"), "key")
    nearest_of = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("probe").agg(F.collect_list("cells").alias("cells"))

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for probe, near in zip(b.column("probe").to_pylist(), b.column("cells").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.reached(sent.value[1][probe], np.array(near), every))], ["steps"])

    needed = np.sort(nearest_of.repartition("probe").mapInArrow(steps, "steps long").toArrow().column("steps").to_numpy())
    return int(needed[min(len(needed) - 1, int(np.ceil(REACH * len(needed))) - 1)]) if len(needed) else 1


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) if len(x) else x
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def _even(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component between 0.5 and 1: the same cosines to the
    last bit, without overflow or underflow in their products."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _answers(distinct: DataFrame, searched: DataFrame, asked: DataFrame, shared, dim: int, k: int, visits: int, single: bool) -> DataFrame:
    columns = f"tree int, cell long, ask int, key long, id long, v array<{'float' if single else 'double'}>"
    names = [c.split()[0] for c in columns.split(", ")]

    def batch(tree, cell, ask, key, ids, v) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim)
        vectors = pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1).astype(np.float32 if single else np.float64)))
        numbers = [np.asarray(tree, np.int32), np.asarray(cell, np.int64), np.full(len(v), ask, np.int32), key, ids]
        return pa.RecordBatch.from_arrays([*map(pa.array, numbers), vectors], names)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, key, ids = _matrix(b.column("v"), dim), b.column("key").to_numpy(), b.column("id").to_numpy()
            cells = shared.value.cells(_unit(v))
            for t in range(cells.shape[1]):
                yield batch(np.full(len(v), t), cells[:, t], 1, key, ids, v)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, key, ids = _matrix(b.column("v"), dim), b.column("key").to_numpy(), b.column("id").to_numpy()
            for i, x in enumerate(_unit(v)):
                tree, cell = zip(*shared.value.search(x, visits))
                at = np.full(len(tree), i)
                yield batch(tree, cell, 0, key[at], ids[at], v[at])

    named = [F.col("key"), F.col("ids")[0].alias("id"), F.col("v")]
    met = searched.select(*named).mapInArrow(ask, columns).unionAll(distinct.select(*named).mapInArrow(index, columns))
    dealt = met.repartition("tree", "cell").sortWithinPartitions("tree", "cell", "ask", "key")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in runs_of(batches, ["tree", "cell"]):
            t = pa.Table.from_batches(stretch).combine_chunks()
            tree, cell, asks, key, ids = (t.column(c).to_numpy() for c in names[:5])
            v = _matrix(t.column("v").combine_chunks(), dim)
            u, v = _unit(v), _even(v)
            size = np.linalg.norm(v, axis=1)
            edges = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (cell[1:] != cell[:-1]), True])
            out: list[list] = [[], [], [], []]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                m = a + int((asks[a:b] == 0).sum())
                if m in (a, b):
                    continue
                near = u[a:m] @ u[m:b].T
                keep = min(2 * k + 2, b - m)
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep] + m
                q = np.repeat(np.arange(a, m), keep)
                c = best.reshape(-1)
                exact = (v[q] * v[c]).sum(axis=1) / (size[q] * size[c])
                for column, x in zip(out, (key[q], key[c], ids[c], exact)):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["asked", "key", "id", "score"])

    found = dealt.mapInArrow(compare, "asked long, key long, id long, score double")
    once = found.groupBy("asked", "key").agg(F.max("score").alias("score"), F.min("id").alias("id"))
    top = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    short = once.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).select("asked", "key", "score")
    expanded = short.join(distinct.select("key", "ids"), "key").select("asked", "score", F.explode("ids").alias("vec_id"))
    best = expanded.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")))
    lists = best.where(F.col("n") <= k + 1).groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    own = asked.join(lists, asked.key == lists.asked)
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

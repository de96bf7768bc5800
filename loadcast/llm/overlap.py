"""Near copies by the share of five-word shingles in common: MinHash finds candidates, whole texts confirm them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.llm.common import components, cut, runs_of, small
from loadcast.llm.simhash import keepers, members, row_key

#: Texts are near copies from this share of common shingles on, as a fraction.
NEAR = (4, 5)
#: Bands of MinHash values. A pair at 0.8 shares none of them with probability (1 - 0.8 ** 5) ** 40, one in 8 million.
BANDS, BAND_ROWS = 40, 5
#: Rows of a candidate cluster that are compared in one task; larger clusters are split into pairs of parts.
PART_ROWS = 512
_rng = np.random.default_rng(58)
MIX, ODD = (_rng.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of k words, case and white space aside."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, k = b" ".join(words), min(k, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a : b - 1], 7) for a, b in zip([0, *ends], ends[k - 1 :])], dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash per band over the least values of its permutations."""
    least = np.full(len(MIX), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 512):
        mixed = hashes[None, i : i + 512] ^ MIX
        mixed *= ODD
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], dtype=np.uint64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * common >= NEAR[0] * (len(a) + len(b) - common)


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, key, fp, bands): ``fp`` is a hash of the set of shingles (0 without words), ``bands`` empty without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) if len(s) else 0 for s in sets], dtype=np.uint64)
            made = pa.array([bands(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(fp.view(np.int64)), made], ["id", "key", "fp", "bands"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, key long, fp long, bands array<long>")


def cluster_links(sets: list[np.ndarray], signs: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links between sets that share a band and overlap enough; pairs already joined are not compared."""
    n, label, links = len(sets), np.arange(len(sets)), []
    size = np.array([len(s) for s in sets])
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        fits = NEAR[1] * np.minimum(size[i], size[rest]) >= NEAR[0] * np.maximum(size[i], size[rest])
        rest = rest[fits & (label[rest] != label[i])]
        for j in rest[(signs[rest] == signs[i]).any(axis=1)].tolist():
            if label[i] != label[j] and near(sets[i], sets[j]):
                links.append((i, j))
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return links


def near_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) between ``fp`` values of rows (fp, bands, root, text, parts) of the same candidate cluster ``root``."""
    placed = (
        texts.withColumn("mine", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("parts = 1 or other != mine")
        .select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp", "bands", "text")
    )
    dealt = placed.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in runs_of(batches, ["root", "lo", "hi"]):
            t = pa.Table.from_batches(stretch)
            columns = [t.column(c).to_numpy() for c in ("root", "lo", "hi")]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), t.num_rows]
            fp = t.column("fp").to_numpy()
            for a, b in zip(edges[:-1], edges[1:]):
                part = t.slice(a, b - a)
                sets = [shingles(x.as_py()) for x in part.column("text")]
                signs = np.array(part.column("bands").to_pylist(), dtype=np.int64).reshape(b - a, -1)
                ends = np.array([(fp[a + i], fp[a + j]) for i, j in cluster_links(sets, signs)], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links_of_rows(known: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) from the ``fp`` of each row's text to that of its keeper, for rows (key, keeper) linked by another rule."""
    texts = cut(known.select("key", "fp").distinct())
    others = found.where("key != keeper").select("key", "keeper").distinct()
    pairs = others.join(texts, "key").select("keeper", F.col("fp").alias("a")).distinct()
    ends = texts.select(F.col("key").alias("keeper"), F.col("fp").alias("b"))
    return pairs.join(ends, "keeper").where("a != b").select("a", "b").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """The documents with one row of each component of near copies: that with the least id (null last).

    Two texts are linked if they share at least 0.8 (Jaccard) of their distinct five-word shingles; a shorter text is
    one shingle. Texts of one set of shingles are one node. Nodes that share a band are joined to candidate clusters,
    which hold every component whole; inside a cluster the whole texts of pairs that share a band are compared.
    Texts without words are copies of each other. All columns are kept as they are.

    ``found`` are rows (key, keeper) as ``simhash.near_duplicates`` returns them: rows with one keeper are linked too,
    and components are whatever links of both rules reach together.
    """
    known = cut(prints(docs, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    classes = cut(known.groupBy("fp").agg(first, F.first("bands").alias("bands")))
    banded = classes.select("fp", F.posexplode("bands").alias("n", "band"))
    least = banded.groupBy("n", "band").agg(F.min("fp").alias("to"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    clusters = components(banded.join(least, ["n", "band"]).select("fp", "to"), "fp", "to")
    inside = clusters.unionAll(clusters.select(F.col("root").alias("node"), "root").distinct())
    parts = inside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    candidates = cut(
        inside.join(parts, "root").join(classes, F.col("node") == F.col("fp")).select("fp", "bands", "root", "parts", F.col("first.key").alias("_row_key"))
    )
    rows = docs.select(row_key(id_col, text_col).alias("_row_key"), F.col(text_col).alias("text"))
    texts = rows.join(small(candidates, candidates.count()), "_row_key").dropDuplicates(["fp"])
    links = near_links(texts)
    if found is not None:
        links = links.unionAll(links_of_rows(known, found))
    roots = components(links, "a", "b")
    return keepers(docs, members(known, classes, roots), id_col, text_col)

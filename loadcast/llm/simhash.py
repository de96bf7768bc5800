"""Near duplicates by SimHash, compared on vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadcast.llm.common import components, cut, runs_of

#: Rows of a bucket that are compared with each other at once; larger buckets are split into pairs of parts.
PART_ROWS = 2048
#: Rows whose bit planes are built together.
BLOCK_ROWS = 4096
BLOCKS, BLOCK_BITS = 4, 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in over half the shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = [xxhash.xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :])]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, key, fp): the fingerprint as a signed long and a hash of id and text that names the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(fp.view(np.int64))], ["id", "key", "fp"])

    named = docs.select(
        F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")
    )
    return named.mapInArrow(run, "id long, key long, fp long")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between different fingerprints (column ``fp``, distinct rows) that differ in at most
    ``radius`` bits: enough of them to join whatever any chain of such links joins, not all pairs.

    With 4 blocks of 16 bits, two fingerprints within 2 bits agree on at least two blocks, so both lie in the
    bucket of one of the 6 pairs of blocks (for smaller radii too). A bucket with more than ``PART_ROWS`` rows
    is split by hash into parts and each pair of parts compared in a task of its own, so no task grows with a bucket.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    block = [F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(BLOCKS)]
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 2 * BLOCK_BITS).bitwiseOR(F.shiftleft(block[i], BLOCK_BITS)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = (
        keyed.join(shared, "key")
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("parts = 1 or other != mine")
        .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    )
    dealt = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in runs_of(batches, ["key", "lo", "hi"]):
            t = pa.Table.from_batches(stretch)
            columns = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new)
            fp = t.column("fp").to_numpy().view(np.uint64)
            found = [link for a, b in _blocks(group) for link in bucket_links(fp[a:b], group[a:b], radius)]
            ends = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _blocks(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups with about ``BLOCK_ROWS`` rows."""
    n, at = len(group), 0
    while at < n:
        end = min(at + BLOCK_ROWS, n)
        if end < n:
            end = int(np.searchsorted(group, group[end], side="left"))
            if end <= at:
                end = int(np.searchsorted(group, group[at], side="right"))
        yield at, end
        at = end


def bucket_links(fp: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links between rows of the same group within ``radius`` bits. Groups lie together.

    Bit plane p holds bit p of all rows as one long integer. For a distance d between rows, a plane XORed with
    itself shifted by d tells for all pairs (i, i + d) at once whether they differ there. Carry-save counters,
    planes themselves, start such that they overflow beyond ``radius``; the block is abandoned for this d as
    soon as all its pairs have overflowed.
    """
    n = len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(p.tobytes(), "little") for p in np.packbits(bits.T, axis=1, bitorder="little")]
    width = radius.bit_length() if radius else 1
    start = (1 << width) - 1 - radius
    label, links = np.arange(n), []
    for d in range(1, n):
        same = group[d:] == group[:-d]
        if not same.any():
            break
        live = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        counters = [live if start >> k & 1 else 0 for k in range(width)]
        over = 0
        for p, plane in enumerate(planes):
            carry = (plane ^ (plane >> d)) & live
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if p % 4 == 3 and over == live:
                break
        near = live & ~over
        if not near:
            continue
        raw = np.frombuffer(near.to_bytes((n + 7) // 8, "little"), dtype=np.uint8)
        i = np.flatnonzero(np.unpackbits(raw, bitorder="little"))
        i = i[label[i] != label[i + d]]
        for a in i.tolist():
            x, y = label[a], label[a + d]
            if x != y:
                links.append((int(fp[a]), int(fp[a + d])))
                label[label == max(x, y)] = min(x, y)
    return links


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``key``, ``fp``, ``component_id`` (least id of its component) and ``keeper``
    (the ``key`` of the one row that stands for the component: that with the least id, null last).

    Documents are linked if their fingerprints differ in at most ``radius`` bits; components are whatever
    links reach. Copies share one fingerprint, so they cost one row in the search. Null and empty texts, and
    texts of white space, have fingerprint zero and are linked like any other. Repeated rows and repeated ids
    are rows like any other; a component whose ids are all null has a null id. Extra columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    classes = cut(prints.groupBy("fp").agg(first))
    roots = components(near_links(classes.select("fp"), radius), "a", "b")
    return members(prints, classes, roots)


def members(prints: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (id, key, fp) with the least id and the keeper of the component that their class ``fp`` belongs to."""
    member = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    known = member.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.key").alias("keeper"))
    return prints.join(known, "fp").select("id", "key", "fp", "component_id", "keeper")


def deduplicate(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each component of near duplicates: that with the least id (null last).

    All columns are kept as they are; of repeated rows with the keeper's id and text one stays.
    """
    found = near_duplicates(docs, radius, shingle, id_col, text_col)
    return keepers(docs, found, id_col, text_col)


def keepers(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stand for their component, each once."""
    keep = found.where("key = keeper").select(F.col("key").alias("_row_key")).distinct()
    rows = docs.withColumn("_row_key", row_key(id_col, text_col)).join(keep, "_row_key")
    one = Window.partitionBy("_row_key").orderBy("_row_key")
    return rows.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_nth", "_row_key")

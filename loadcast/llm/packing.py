"""Packing token sequences by a grouping genetic algorithm that runs as islands on Spark."""

from __future__ import annotations

import json
import re
import random
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.llm.common import cut

CAPACITY = 2048
#: Items of a shard, the problem that its islands work on.
SHARD_ITEMS = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION, CHILDREN, ELITES = 2, 2, 6, 5, 4, 2
#: Bins filled less than this enter the second season, where shards are formed anew.
WELL_FILLED = 0.985
#: Entries of a worker's table of encoded segments; it starts afresh beyond them, which changes no result.
SEGMENTS = 200_000

_encoders: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """Text to token ids (little-endian unsigned 32-bit), by the byte-level BPE vocabulary of a tokenizer file.

    A single space between two other characters always starts a new piece of the pre-tokenizer, so a text can be
    cut there and each segment encoded once per worker. Texts with other white space next to a space are
    encoded whole. Where the string of an added token stands in a text it is that token, and what lies between such
    strings is encoded by itself, as the tokenizer does with its default settings.
    """
    if path in _encoders:
        return _encoders[path]
    import tiktoken

    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    added = {token["content"]: token["id"] for token in described.get("added_tokens", [])}
    if any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in described.get("added_tokens", [])):
        raise ValueError("added tokens that take in what is beside them are not supported")
    between = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
    byte_of = _byte_of()
    ranks = {
        bytes(byte_of[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in added
    }
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = own.encode_ordinary
    known: dict[str, bytes | None] = {}

    def ids(text: str) -> bytes:
        found = whole(text)
        return struct.pack(f"<{len(found)}I", *found)

    def encode(text: str) -> bytes:
        if between is None or not between.search(text):
            return plain(text)
        out, at = [], 0
        for m in between.finditer(text):
            out += [plain(text[at : m.start()]), struct.pack("<I", added[m[0]])]
            at = m.end()
        return b"".join([*out, plain(text[at:])])

    def plain(text: str) -> bytes:
        segments = text.split(" ")
        if len(segments) == 1:
            return ids(text)
        first = segments[0]
        if not first or first != first.strip():
            return ids(text)
        if len(known) > SEGMENTS:
            known.clear()
        out = list(map(known.get, segments[1:]))
        if None in out:
            for i, part in enumerate(out, 1):
                if part is None:
                    s = segments[i]
                    if not s or s != s.strip():
                        return ids(text)
                    out[i - 1] = known[s] = ids(" " + s)
        return ids(first) + b"".join(out)

    _encoders[path] = encode
    return encode


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves,
    the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(
    docs: DataFrame,
    path: str,
    pattern: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Token pieces of documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for,
    ``ids``. Each text is encoded and ``end_id`` put behind; a document longer than ``capacity`` is cut such that
    all pieces but the first are full. Null text counts as empty and gives the end id alone."""
    end = np.array([end_id], dtype="<u4").tobytes()
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            kept = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    part = ids[4 * at : 4 * (at + length)]
                    for column, v in zip(rows, (doc, piece, at, length, zlib.crc32(part))):
                        column.append(v)
                    if keep_ids:
                        kept.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    at, piece = at + length, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(rows, types)]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in columns.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, columns)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, seed: int = 8) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Full pieces are sequences of their own. The others are dealt by hash into shards of about ``SHARD_ITEMS``
    items. On each shard several islands evolve populations of packings: a child takes whole well-filled bins
    of one parent, the other parent's bins that hold any of their items go, and the displaced items are put back
    by best fit, largest first. After an epoch the islands' elites migrate to the next island. In a second
    season the bins that are not well filled are dealt into new shards, whole, and evolve from there, so no
    packing gets worse. Items, never texts, move; a task holds one shard at a time.

    Sequence ids are arbitrary but repeatable; offsets are gapless from 0. Repeated rows are items of their own.
    Extra columns stay, but ``sequence_id`` and ``offset`` are replaced. An empty table gives no rows.
    """
    named = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset")]
    rows = cut(cut_pieces.select(*named).withColumn("_item", F.monotonically_increasing_id()))
    items = rows.where(F.col("length") < capacity).select("_item", F.col("length").cast("int").alias("length"))
    first = cut(_season(items.withColumn("bin", F.lit(None).cast("long")), capacity, seed))
    fill = first.groupBy("bin").agg(F.sum("length").alias("fill"))
    loose = first.join(fill.where(F.col("fill") < WELL_FILLED * capacity).select("bin"), "bin", "left_semi")
    tight = first.join(fill.where(F.col("fill") >= WELL_FILLED * capacity).select("bin"), "bin", "left_semi")
    second = _season(loose.select("_item", "length", "bin"), capacity, seed + 1)
    placed = tight.unionByName(second).select(
        "_item", F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset")
    )
    full = rows.where(F.col("length") >= capacity).select(
        "_item", (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return rows.join(placed.unionByName(full), "_item").select(*named, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ``ids``: ``sequence_id`` and ``ids``."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(inside, lambda x: x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"))


def _season(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Packs (_item, length, bin) anew and returns (_item, length, bin, offset); a given bin is a start to better.

    New bin numbers are taken from their first item, so they are unique over all shards and seasons.
    """
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("bin", "_item")), F.lit(shards)))
    state = (
        dealt.groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("_item", "length", "bin"))).alias("items"))
        .select("shard", "items._item", "items.length", "items.bin", F.array().cast("array<struct<island:int,genomes:array<array<int>>>>").alias("elites"))
    )
    columns = "shard long, _item array<long>, length array<int>, bin array<long>, island int, bins int, genomes array<array<int>>"
    for epoch in range(EPOCHS):
        islands = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).repartition("shard", "island")
        evolved = islands.mapInArrow(_evolve(capacity, seed, epoch), columns)
        alike = [F.first(c).alias(c) for c in ("_item", "length", "bin")]
        found = F.struct("bins", "island", "genomes")
        state = evolved.groupBy("shard").agg(
            *alike, F.collect_list(F.struct("island", "genomes")).alias("elites"), F.min(found).alias("best")
        )
    best = state.select("_item", "length", F.col("best.genomes")[0].alias("genome"))

    def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                item, length, genome = (np.asarray(b.column(c)[i].values) for c in ("_item", "length", "genome"))
                order = np.argsort(genome, kind="stable")
                item, length, genome = item[order], length[order], genome[order]
                starts = np.flatnonzero(np.r_[True, genome[1:] != genome[:-1]])
                counts = np.diff(np.r_[starts, len(genome)])
                before = np.cumsum(length) - length
                offset = before - np.repeat(before[starts], counts)
                arrays = [pa.array(x) for x in (item, length, np.repeat(item[starts], counts), offset.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["_item", "length", "bin", "offset"])

    return best.mapInArrow(unfold, "_item long, length int, bin long, offset int")


def _evolve(capacity: int, seed: int, epoch: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in ("shard", "island", "_item", "length", "bin", "elites")}
                lengths = np.asarray(row["length"].values)
                island = row["island"].as_py()
                arrived = {e["island"]: e["genomes"] for e in row["elites"].as_py()}
                start = [np.array(g) for who in (island, (island - 1) % ISLANDS) for g in arrived.get(who, [])]
                bins = row["bin"].values
                if not start and bins.null_count == 0:
                    start = [np.unique(np.asarray(bins), return_inverse=True)[1]]
                best = evolve(lengths, capacity, random.Random(f"{seed} {epoch} {row['shard'].as_py()} {island}"), start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"].as_py()], pa.int64()),
                        *(pa.array([row[c].as_py()], t) for c, t in (("_item", pa.list_(pa.int64())), ("length", pa.list_(pa.int32())), ("bin", pa.list_(pa.int64())))),
                        pa.array([island], pa.int32()),
                        pa.array([int(best[0].max()) + 1], pa.int32()),
                        pa.array([[g.tolist() for g in best]], pa.list_(pa.list_(pa.int32()))),
                    ],
                    ["shard", "_item", "length", "bin", "island", "bins", "genomes"],
                )

    return run


def evolve(lengths: np.ndarray, capacity: int, rng: random.Random, start: list[np.ndarray]) -> list[np.ndarray]:
    """The best packings found, best first: for each item the number of its bin, from 0 without gaps."""
    least = -(-int(lengths.sum()) // capacity)
    population = [_scored(g, lengths, capacity) for g in start]
    while len(population) < POPULATION:
        noise = np.array([rng.random() for _ in range(len(lengths))]) * (0.0 if not population else 0.15)
        order = np.argsort(-(lengths * (1 - noise)), kind="stable")
        nothing = np.full(len(lengths), -1)
        population.append(_scored(_best_fit(nothing, np.zeros(0, dtype=np.int64), order, lengths, capacity), lengths, capacity))
    population.sort(key=lambda x: x[0])
    for _ in range(GENERATIONS):
        if population[0][0][0] <= least:
            break
        children = []
        for _ in range(CHILDREN):
            a, b = (min(rng.sample(range(len(population)), 2)) for _ in range(2))
            children.append(_scored(_cross(population[a][1], population[b][1], lengths, capacity, rng), lengths, capacity))
        population = sorted(population + children, key=lambda x: x[0])[:POPULATION]
    return [g for _, g in population[:ELITES]]


def _scored(genome: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[tuple[int, float], np.ndarray]:
    """Fewer bins first, then bins filled more unevenly, which leaves room for later items."""
    fill = np.bincount(genome, weights=lengths)
    return (len(fill), -float(np.square(fill / capacity).mean())), genome


def _cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Whole well-filled bins of ``b`` go into ``a``; what they displace is put back by best fit, largest first."""
    fill = np.bincount(b, weights=lengths)
    chance = np.array([rng.random() for _ in range(len(fill))])
    take = (fill / capacity) ** 8 * 0.6 > chance
    inject = take[b]
    gone = np.zeros(a.max() + 1, dtype=bool)
    gone[a[inject]] = True
    rest = np.bincount(a, weights=lengths)
    poor = np.array([rng.random() for _ in range(len(rest))]) > (rest / capacity) ** 0.5
    gone |= poor
    displaced = np.flatnonzero(gone[a] & ~inject)
    joined = np.where(inject, b + len(gone), a)
    joined[displaced] = -1
    placed = joined >= 0
    names, new = np.unique(joined[placed], return_inverse=True)
    child = np.full(len(a), -1)
    child[placed] = new
    fill = np.bincount(new, weights=lengths[placed], minlength=len(names)).astype(np.int64)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return _best_fit(child, fill, order, lengths, capacity)


def _best_fit(genome: np.ndarray, fill: np.ndarray, order: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the items in this order into the fullest bin that takes them, or a new one."""
    room = sorted(zip((capacity - fill).tolist(), range(len(fill))))
    bins = len(fill)
    for i in order.tolist():
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, name = room.pop(at)
        else:
            left, name, bins = capacity, bins, bins + 1
        genome[i] = name
        if left > size:
            insort(room, (left - size, name))
    return genome

"""Vector codes by product quantisation, trained with Lloyd rounds that compare moved entries only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.llm.common import complete, cut, floors, light, lists, matrix, nearest_points, remove, written

#: Parts of a vector, entries of a part's codebook, rounds of training, and integers per unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held to this size, so that every distance and task's sum is exact in 64 bits.
BOUND = 1 << 24
#: Numbers of a block of rows that is worked on together.
BLOCK = 1 << 21


@dataclass
class Codebooks:
    """``entries[part, index]`` are integer points; ``moved[part, index]`` tells which changed in the last round."""

    entries: np.ndarray
    moved: np.ndarray

    def sha256(self) -> str:
        """Of all components as decimal integers by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def assign(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of all parts of some vectors, every entry compared."""
    parts, _, length = books.entries.shape
    found = [nearest_points(x[:, p * length : (p + 1) * length], books.entries[p]) for p in range(parts)]
    return np.stack([at for _, at in found], axis=1).astype(np.uint8), np.stack([d for d, _ in found], axis=1)


def reassign(x: np.ndarray, code: np.ndarray, distance: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and distances after a round, and the number of comparisons made.

    A part whose entry stayed keeps its distance, which is exact; no entry that stayed can have become nearer, so
    only moved entries are compared with it, and one wins if it is nearer, or as near with a lower index. A part
    whose entry moved is compared with all entries.
    """
    parts, entries, length = books.entries.shape
    code, distance, made = code.copy(), distance.copy(), 0
    for p in range(parts):
        part = x[:, p * length : (p + 1) * length]
        active = np.flatnonzero(books.moved[p])
        lost = books.moved[p][code[:, p]]
        kept, again = np.flatnonzero(~lost), np.flatnonzero(lost)
        if len(active) and len(kept):
            d, at = nearest_points(part[kept], books.entries[p][active])
            at = active[at]
            now, old = code[kept, p], distance[kept, p]
            won = (d < old) | ((d == old) & (at < now))
            code[kept[won], p], distance[kept[won], p] = at[won], d[won]
        if len(again):
            distance[again, p], code[again, p] = nearest_points(part[again], books.entries[p])
        made += len(active) * len(kept) + entries * len(again)
    return code, distance, made


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK // max(width, 1))
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts)


def _pass(df: DataFrame, books: Codebooks, width: int, first: bool, last: bool) -> DataFrame:
    """One assignment of all rows (id, label, v, code, distance); the last one keeps the error instead of v and distance."""
    parts = books.entries.shape[0]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"])]
    if not last:
        fields.append(T.StructField("v", T.ArrayType(T.IntegerType())))
    fields.append(T.StructField("code", T.BinaryType()))
    fields.append(T.StructField("error", T.LongType()) if last else T.StructField("distance", T.ArrayType(T.LongType())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole, width):
                x = matrix(batch.column("v"), width)
                if first:
                    code, distance = assign(x, books)
                else:
                    code, distance, _ = reassign(x, _codes(batch.column("code"), parts), matrix(batch.column("distance"), parts), books)
                out = {"id": batch.column("id"), "label": batch.column("label"), "v": batch.column("v")}
                out |= {"code": pa.array([c.tobytes() for c in code], pa.binary()), "distance": lists(distance, pa.int64()), "error": pa.array(distance.sum(axis=1))}
                names = [f.name for f in fields]
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return df.mapInArrow(run, T.StructType(fields))


def _next(state: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """The codebooks after a round: floors of exact means; what no part was assigned to stays.

    Each task adds up its rows, so one number per entry and component leaves it; the totals, of which there are
    as many however many rows there are, reach the driver.
    """
    parts, entries, length = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, length + 1), dtype=np.int64)
        for whole in batches:
            for batch in _blocks(whole, width):
                x, code = matrix(batch.column("v"), width), _codes(batch.column("code"), parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], np.c_[np.ones(len(x), dtype=np.int64), x[:, p * length : (p + 1) * length]])
        flat = total.reshape(-1)
        slot = np.flatnonzero(np.repeat(total[:, :, 0] > 0, length + 1))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot])], ["slot", "value"])

    partial = state.select("v", "code").mapInArrow(run, "slot long, value long")
    sums = np.zeros(parts * entries * (length + 1), dtype=object)
    for slot, value in partial.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        sums[slot] = int(value)
    sums = sums.reshape(parts, entries, length + 1)
    new = books.entries.copy()
    used = sums[:, :, 0] > 0
    new[used] = (sums[used][:, 1:] // sums[used][:, :1]).astype(np.int64)
    return Codebooks(new, (new != books.entries).any(axis=2))


def quantise(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """Rows (id, label, code, error) and the codebooks: ``code`` holds a byte per part (at most 256 entries), ``error``
    is the squared distance of the integer vector floor(scale * x) from what the code stands for.

    Codebooks start as the parts of the ``entries`` vectors with the smallest ids (all, if there are fewer; null ids
    come last, equal ids in order of their vectors). Each round assigns every part to the nearest entry, ties to the
    lower index, and moves every used entry to the floor of its parts' mean; in the end parts are assigned once
    more. After the first assignment only moved entries are compared where a part's entry stayed (``reassign``).

    Vectors that are null or hold a null or non-finite component have no row; every other row has one, repeated ones
    and null ids too. Vectors are taken as ending in zeros up to the next multiple of ``parts`` from the longest one, so lengths
    may differ. Integers beyond ``BOUND`` count as ``BOUND``. An empty table gives no rows and no codebooks. Other
    columns are not read. No row is shuffled: state between rounds is a written table beside each vector, read
    where it lies and deleted after the next one is written; what the driver holds depends on the width only.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code byte tells at most 256 entries apart")
    vector = F.col(vector_col)
    kept = vectors.where(complete(vector)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), floors(vector, scale, BOUND).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
        return vectors.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code binary, error long"), None
    width = parts * max(1, -(-longest // parts))
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    start = matrix(seeds, width).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(start), np.ones(start.shape[:2], dtype=bool))
    state, before = kept, None
    for n in range(rounds):
        state, path = written(_pass(state, books, width, n == 0, False), "codes")
        if before:
            remove(vectors.sparkSession, before)
        before, books = path, _next(state, books, width)
    out = cut(_pass(state, books, width, rounds == 0, True))
    if before:
        remove(vectors.sparkSession, before)
    return out, books


def with_label_errors(coded: DataFrame, name: str = "label_error") -> DataFrame:
    """Adds the error summed over the rows of an equal label, nulls together; a sum beyond a long is null.

    Sums are made from partial ones, so a hot label is no hot task; they come back by broadcast if their bytes are
    few, else by a join whose skewed side Spark may split.
    """
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = cut(coded.groupBy("label").agg(total.alias("_sum")).select(F.col("label").alias("_label"), F.expr("try_cast(_sum AS bigint)").alias(name)))
    return coded.join(light(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def code_text(code: Column | str) -> Column:
    """Two lower-case hex digits per part."""
    return F.lower(F.hex(code))

"""Quality by a vote of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.llm.chars import chunks
from loadcast.llm.common import cut

#: Labelled documents of either label that vote at most, and of those that the space is fitted on, chosen by hash.
PER_LABEL, PER_LABEL_SPACE = 3000, 1000
#: Hash slots for terms, dimensions of the space, and neighbours that vote.
SLOTS, DIMENSIONS, NEIGHBOURS = 1 << 14, 64, 25
#: Words back that a repeat is looked for, and terms that repeats count as.
BACK, REPEATS = 4, 128
#: Similarities are told apart to this step; a neighbour's vote weighs its similarity to this power.
STEP, POWER = 1e-5, 8
#: Documents that are compared with all labelled ones at once.
BLOCK = 512
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - 14)


@dataclass
class Space:
    """Inverse document frequencies of term slots, and the directions they are projected on."""

    idf: np.ndarray
    basis: np.ndarray


@dataclass
class Model:
    """Labelled vectors of length one (or zero), their labels, what each vote stands for, and the share of label 1."""

    space: Space
    vectors: np.ndarray
    good: np.ndarray
    weight: np.ndarray
    prior: float


def _kinds() -> np.ndarray:
    """Kind of an ASCII character: 0 white space, 1 small letter, 2 capital letter, 3 digit, or the sign itself."""
    out = np.arange(128, dtype=np.uint64)
    for c in range(128):
        out[c] = 0 if chr(c).isspace() or not c else 1 if chr(c).islower() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else c
    return out


def _kind(points: np.ndarray) -> np.ndarray:
    """Characters beyond ASCII count as small letters, or capitals below 0x2000 that have a small form 32 further on."""
    kinds = _kinds()
    capital = (points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)
    return np.where(points < 128, kinds[np.minimum(points, 127)], np.where(capital, 2, 1)).astype(np.uint64)


def _terms(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every term of some texts.

    Terms are three characters in a row as written, three kinds of characters in a row, lengths of words by powers
    of two, and words that stand already among the ``BACK`` before them; the latter count as ``REPEATS`` terms in
    turn, so that a text of repeats has as much to say of them as of its few words.
    """
    c = points.astype(np.uint64)
    n = len(c)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if n < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _kind(points)
    whole = np.flatnonzero((c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0))
    three = (c[whole] * _A + c[whole + 1] * _B + c[whole + 2] * _C) * _A >> _SHIFT
    shape = (kind[whole] * _C + kind[whole + 1] * _A + kind[whole + 2] * _B + np.uint64(7)) * _B >> _SHIFT
    inside = kind > 0
    begin = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    end = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    place = np.arange(n, dtype=np.uint64)
    extra, at = [], []
    if len(begin):
        first = np.repeat(begin, end - begin).astype(np.uint64)
        within = np.flatnonzero(inside)
        mixed = (c[within] + _B) * ((place[within] - first) * _A + _C)
        mixed ^= mixed >> np.uint64(31)
        word = np.add.reduceat(mixed * _B, np.r_[0, np.cumsum(end - begin)[:-1]])
        home = doc[begin]
        repeat = np.zeros(len(word), dtype=bool)
        for back in range(1, BACK + 1):
            repeat[back:] |= (word[back:] == word[:-back]) & (home[back:] == home[:-back])
        again = np.flatnonzero(repeat)
        nth = np.arange(len(again)) - np.searchsorted(home[again], home[again])
        size = np.log2(end - begin).astype(np.uint64)
        at += [home[again], home]
        extra += [((nth % REPEATS).astype(np.uint64) + np.uint64(101)) * _A >> _SHIFT, (size + np.uint64(11)) * _C >> _SHIFT]
    return np.r_[doc[whole], doc[whole], *at], np.concatenate([three, shape, *extra]).astype(np.int64)


def _counted(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, document, slot, count) of the distinct terms of each text, sorted by document, chunk by chunk."""
    for first, end, points, starts in chunks(texts, lower=False):
        doc, slot = _terms(points, starts)
        key, count = np.unique(doc * SLOTS + slot, return_counts=True)
        yield first, end, key // SLOTS, key % SLOTS, count


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all texts each slot occurs, and how many texts there are; one number per slot reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows - batch.column("text").null_count
            for _, _, _, slot, _ in _counted(batch.column("text").to_pylist()):
                total += np.bincount(slot, minlength=SLOTS)
        slot = np.r_[np.flatnonzero(total), SLOTS]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.r_[total, n][slot])], ["slot", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, dtype=np.int64)
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _weights(slot: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(count)) * idf[slot]).astype(np.float32)


def embed(texts: list[str | None], space: Space) -> np.ndarray:
    """The vector of each text, of length one; zero for a text without terms."""
    out = np.zeros((len(texts), space.basis.shape[1]), dtype=np.float32)
    for first, _, doc, slot, count in _counted(texts):
        w = _weights(slot, count, space.idf)
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
        for a, b in zip(head, [*head[1:], len(doc)]):
            out[first + doc[a]] = w[a:b] @ space.basis[slot[a:b]]
    size = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
    return (out / np.maximum(size, 1e-12)[:, None]).astype(np.float32)


def _space(rows: DataFrame, idf: np.ndarray) -> Space:
    """Truncated singular value decomposition, by a randomised range finder, of the term weights of some rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, doc, slot, count in _counted(batch.column("text").to_pylist()):
                w = _weights(slot, count, idf)
                bound = np.searchsorted(doc, np.arange(end - first + 1)).astype(np.int32)
                slots, values = pa.array(slot.astype(np.int16)), pa.array(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("h").to_numpy()[first:end]), pa.ListArray.from_arrays(pa.array(bound), slots), pa.ListArray.from_arrays(pa.array(bound), values)], ["h", "slot", "w"]
                )

    got = rows.select("text", "h").mapInArrow(run, "h long, slot array<smallint>, w array<float>").orderBy("h", "slot").toArrow()
    size = got.column("slot").combine_chunks().value_lengths().to_numpy()
    slot = got.column("slot").combine_chunks().flatten().to_numpy().astype(np.int64)
    w = got.column("w").combine_chunks().flatten().to_numpy().astype(np.float32)
    row = np.repeat(np.arange(len(size)), size)
    norm = np.sqrt(np.bincount(row, weights=w.astype(np.float64) ** 2, minlength=len(size)))
    w /= np.maximum(norm, 1e-12)[row].astype(np.float32)
    start = np.cumsum(size) - size
    by_slot = np.argsort(slot, kind="stable")
    rank = min(DIMENSIONS, len(size), SLOTS)

    def times(right: np.ndarray) -> np.ndarray:
        return np.stack([w[a : a + n] @ right[slot[a : a + n]] for a, n in zip(start, size)])

    columns, first = np.unique(slot[by_slot], return_index=True)
    last = np.r_[first[1:], len(slot)]

    def transposed(left: np.ndarray) -> np.ndarray:
        out = np.zeros((SLOTS, left.shape[1]), dtype=np.float32)
        for c, a, b in zip(columns, first, last):
            at = by_slot[a:b]
            out[c] = w[at] @ left[row[at]]
        return out

    rng = np.random.default_rng(13)
    y = times(rng.standard_normal((SLOTS, rank + 16)).astype(np.float32))
    for _ in range(3):
        q = np.linalg.qr(y)[0].astype(np.float32)
        y = times(transposed(q))
    q = np.linalg.qr(y)[0].astype(np.float32)
    _, _, v = np.linalg.svd(transposed(q).T, full_matrices=False)
    return Space(idf, np.ascontiguousarray(v[:rank].T.astype(np.float32)))


def _drawn(seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = PER_LABEL,
    per_label_space: int = PER_LABEL_SPACE,
    seed: int = 11,
) -> Model | None:
    """Document frequencies of all texts, a space, and labelled vectors; None if no labelled row has a text.

    The vectors are those of about ``per_label`` documents of either label at most, told apart by id, text and label and chosen
    by hash; the space is fitted on about ``per_label_space`` of either. These two bounds are those of the fit; all of it
    then is of one size however many documents there are. Rows with a null id, text or label teach nothing.
    Each vote stands for as many labelled documents as its own share was drawn from.
    """
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y")).distinct()
    sizes = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    if not sizes:
        return None
    share = F.when(F.col("y") == 1, min(1.0, per_label / sizes.get(1, 1))).otherwise(min(1.0, per_label / sizes.get(0, 1)))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = marked.where(_drawn(seed, F.col("id")) < share)
    digest = F.xxhash64("id", "text", "y").alias("h")
    rows = cut(read.join(F.broadcast(sample), "id").select("text", "y", digest).dropDuplicates(["h", "y"]))
    drawn = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if not drawn:
        return None

    def most(bound: int) -> DataFrame:
        keep = F.when(F.col("y") == 1, bound / drawn.get(1, 1)).otherwise(bound / drawn.get(0, 1))
        return rows.where(_drawn(seed + 1, F.col("h")) < keep)

    frequency, n = document_frequencies(docs, text_col)
    idf = np.log((n + 1) / (frequency + 1)) + 0.1
    space = _space(most(per_label_space), idf)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = embed(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(list(found), pa.list_(pa.float32()))], ["h", "y", "v"])

    got = most(2 * per_label).mapInArrow(run, "h long, y int, v array<float>").orderBy("h", "y").toArrow()
    if not got.num_rows:
        return None
    vectors = got.column("v").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    good = got.column("y").to_numpy().astype(np.float64)
    each = {y: sizes[y] / max(1, int((good == y).sum())) for y in sizes}
    weight = np.where(good == 1, each.get(1, 0.0), each.get(0, 0.0))
    return Model(space, vectors, good, weight, float(sizes.get(1, 0) / sum(sizes.values())))


def votes(x: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The share of label 1 among the nearest labelled vectors of each vector, weighted by similarity.

    Cosines with all labelled vectors are computed, block by block. The ``neighbours`` largest vote, and all others
    as near as the last of them, so ties and their order do not matter. Where nothing is similar the prior stands.
    """
    out = np.full(len(x), model.prior)
    k = min(neighbours, len(model.vectors))
    for a in range(0, len(x), BLOCK):
        near = np.floor(np.maximum(x[a : a + BLOCK] @ model.vectors.T, 0) / STEP + 0.5) * STEP
        least = np.partition(near, len(model.vectors) - k, axis=1)[:, len(model.vectors) - k]
        w = np.where(near >= np.maximum(least, STEP)[:, None], near, 0.0) ** POWER * model.weight
        total = w.sum(axis=1)
        voted = total > 0
        out[a : a + BLOCK][voted] = (w[voted] @ model.good) / total[voted]
    return out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """Rows (id, score, predicted): how likely label 1 is, and whether that is 0.5 or more.

    Whole texts are read. Null texts, empty ones and ones of fewer than three characters are like no document and get the
    share of label 1 among labelled ids; without a model all score 0.5. Each row gives a row, repeated ones too; equal
    texts get equal scores. Nothing is shuffled; the broadcast model's size is fixed by the bounds of the fit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            if m is not None:
                p = np.clip(votes(embed(batch.column("text").to_pylist(), m.space), m, neighbours), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, predicted int")

"""Document fingerprints by I-Match: hashes of a document's terms of medium frequency, over random lexicons."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of all documents that a term of the lexicon occurs in: idf from ln 5 to ln 2000. A document of m distinct
#: terms on average allows at most 2000 m terms, whatever the number of documents, so a lexicon can be broadcast.
LEAST, MOST = 1 / 2000, 1 / 5
#: Lexicons: first the whole band, then random ones that keep 2 ** -SPARSEST to 2 ** -DENSEST of its terms in turn.
LEXICONS, DENSEST, SPARSEST = 64, 3, 9
#: Terms that a task counts before it hands them on.
HELD_TERMS = 500_000
DOCS_PER_BUCKET, MOST_BUCKETS = 500, 50_000
TERM = re.compile(r"\w+")


def terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def _mask(term: str) -> int:
    """Bit i tells whether the i-th random lexicon keeps the term."""
    data = term.encode("utf-8", "surrogatepass")
    kept = 1
    for i in range(1, LEXICONS):
        exponent = SPARSEST - i % (SPARSEST - DENSEST + 1)
        if not xxhash.xxh64_intdigest(data, i) & ((1 << exponent) - 1):
            kept |= 1 << i
    return kept


@dataclass
class Lexicon:
    """The terms of the band, with a hash and the lexicons of each."""

    place: dict[str, int]
    hashes: np.ndarray
    masks: np.ndarray


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> Lexicon:
    """The terms whose share of documents lies within the band, counted over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            arrays = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(terms(text or ""))
                if len(held) > HELD_TERMS:
                    yield out()
                    held.clear()
        yield out()

    n = docs.count()
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n").between(least * n, most * n)).select("term").toArrow().column("term").to_pylist()
    kept.sort()
    hashes = np.array([xxhash.xxh64_intdigest(t.encode()) for t in kept], dtype=np.uint64)
    return Lexicon({t: i for i, t in enumerate(kept)}, hashes, np.array([_mask(t) for t in kept], dtype=np.uint64))


_BITS = np.arange(LEXICONS, dtype=np.uint64)


def fingerprint(text: str, known: Lexicon) -> np.ndarray:
    """One 16-bit hash for each random lexicon of the document's sorted distinct terms in it; 0 where it has none.

    A text without terms of the band is hashed by all its terms, and one without terms as a whole, so that such
    texts are not all alike.
    """
    words = terms(text)
    at = [known.place[w] for w in words if w in known.place]
    if at:
        hashes, masks = known.hashes[at], known.masks[at]
    else:
        rest = sorted(words) or [text]
        hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in rest], dtype=np.uint64)
        masks = np.array([_mask(w) for w in rest], dtype=np.uint64)
        if not words:
            masks[:] = np.uint64(2**64 - 1)
    order = np.argsort(hashes)
    hashes, inside = hashes[order], (masks[order][:, None] >> _BITS & np.uint64(1)).astype(bool)
    out = np.zeros(LEXICONS, dtype="<u2")
    for i in np.flatnonzero(inside.any(axis=0)).tolist():
        out[i] = xxhash.xxh32_intdigest(hashes[inside[:, i]].tobytes(), i) % 65535 + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the lexicons in which either text has a term, the part in which both hashes agree; 1 for equal prints."""
    used = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum() / used) if used else 1.0


def fingerprints(docs: DataFrame, known: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint) with the hashes as hexadecimal digits. Null text counts as empty; each row gives a row."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t or "", shared.value).astype(">u2").tobytes().hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint string")


def edited_pairs(docs: DataFrame, known: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document in descending order of id.

    The edited text has the last half of its characters, rounded down, replaced by as many of the next document's
    first (or all it has). After the last document comes the first; one alone is its own next. Null text
    counts as empty, rows without id come last, and rows with the same id lie in order of their text.

    Ids are cut into buckets of like numbers of rows. A bucket gets, besides its own rows, the first row of the
    bucket behind it, so texts are shuffled once and no order of all rows is needed.
    """
    lowest = -(1 << 63)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // DOCS_PER_BUCKET)))
    parts = [1 - i / buckets for i in range(1, buckets)]
    found = rows.agg(F.max("key").alias("top"), F.percentile_approx("key", parts or [1.0], 4 * buckets + 1000).alias("cuts")).first()
    top = found["top"] if found["top"] is not None else lowest
    heads = [top, *sorted({c for c in (found["cuts"] or []) if parts and c < top}, reverse=True)]
    bucket = _place(F.col("key"), heads)
    last = len(heads) - 1
    is_head = F.col("key") == F.element_at(F.lit(heads), F.col("bucket") + 1)
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))
    also = F.struct(before.alias("b"), F.lit(True).alias("guest"))
    dealt = (
        rows.withColumn("bucket", bucket)
        .withColumn("to", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))))
        .select(F.col("to.b").alias("bucket"), F.col("to.guest").alias("guest"), "id", "key", "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "guest", F.desc("key"), "text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(known)
    columns = (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        held = None
        for batch in batches:
            out: list[tuple] = []
            for b, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "id", "text"))):
                if guest and held and held[1]:
                    continue
                print_ = fingerprint(text, lex)
                if held and held[0] == b and not held[1]:
                    out.append(_compared(held[2], held[3], held[4], text, print_, lex))
                held = (b, guest, doc, text, print_)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in columns.split(", ")])

    return dealt.mapInArrow(run, columns)


def _compared(doc: int, text: str, mine: np.ndarray, after: str, its: np.ndarray, lex: Lexicon) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = fingerprint(edited, lex)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    prints = (x.astype(">u2").tobytes().hex() for x in (mine, changed))
    return (doc, len(text), digest, *prints, likeness(mine, changed), likeness(mine, its))


def _place(key: Column, heads: list[int]) -> Column:
    """How many of the heads behind the first are not below the key, by binary search; heads fall."""
    if len(heads) == 1:
        return F.lit(0)
    steps = [1 << s for s in range((len(heads) - 1).bit_length() - 1, -1, -1)]
    array, n = F.lit(heads), len(heads)

    def step(low: Column, size: Column) -> Column:
        probe = low + size
        return F.when((probe < n) & (F.get(array, probe) >= key), probe).otherwise(low)

    return F.aggregate(F.lit(steps), F.lit(0), step)

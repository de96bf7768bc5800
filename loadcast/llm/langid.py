"""Language identification by expectation-maximisation over the languages of a document's words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.llm.chars import chunks, letters

#: Hash slots for three letters and for two letters, so a model has one size per language.
SLOTS = 1 << 16
#: Labelled documents per language that a model is fitted on at most, chosen by hash of their id.
PER_LANGUAGE = 20_000
ITERATIONS = 12
UNKNOWN = "und"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(48)


@dataclass
class Model:
    """Log probabilities per language: ``three`` of a letter after two, ``first`` of a word's first two."""

    languages: list[str]
    three: np.ndarray
    two: np.ndarray
    words: np.ndarray


def _grams(points: np.ndarray, starts: np.ndarray):
    """Of each letter: slots of (before, it, after) and (before, it), whether it begins a word; and each word's document."""
    c = np.where(letters()[points], points, 0).astype(np.uint64)
    before = np.concatenate([[np.uint64(0)], c[:-1]])
    after = np.concatenate([c[1:], [np.uint64(0)]])
    at = np.flatnonzero(c)
    b, x, a = before[at], c[at], after[at]
    pair = b * _A + x * _B
    two = (pair * _C >> _SHIFT).astype(np.int64)
    three = ((pair + a * _C) * _A >> _SHIFT).astype(np.int64)
    begins = b == 0
    doc = np.searchsorted(starts, at[begins], side="right") - 1
    return three, two, begins, doc


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    seed: int = 1,
) -> Model | None:
    """Counts n-grams of labelled documents; at most about ``per_language`` of a language are read, the bound of
    the fit. Rows without text or label teach nothing. None if no row is left."""
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(drawn < F.element_at(share, F.col(lang_col)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, end, points, starts in chunks(batch.column("text").to_pylist()):
                three, two, begins, doc = _grams(points, starts)
                if not len(three):
                    continue
                of_letter = langs[first:end][doc][np.cumsum(begins) - 1]
                for lang in set(langs[first:end]):
                    mine = of_letter == lang
                    have = counts.setdefault(lang, np.zeros(2 * SLOTS + 1, dtype=np.int64))
                    have[:SLOTS] += np.bincount(three[mine], minlength=SLOTS)
                    have[SLOTS:-1] += np.bincount(two[mine], minlength=SLOTS)
                    have[-1] += int((begins & mine).sum())
        for lang, have in counts.items():
            slot = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(have[slot])], ["lang", "slot", "n"]
            )

    read = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = read.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    if not names:
        return None
    counts = np.zeros((2 * SLOTS + 1, len(names)))
    which = {n: i for i, n in enumerate(names)}
    column = np.array([which[x] for x in found.column("lang").to_pylist()])
    counts[found.column("slot").to_numpy(), column] = found.column("n").to_numpy()
    floor = 1 / 64
    three = np.log(counts[:SLOTS] + floor).astype(np.float32)
    two = np.log(counts[SLOTS:-1] + floor * 32).astype(np.float32)
    return Model(names, three, two, np.log(counts[-1] + floor * 32).astype(np.float32))


def _word_likelihood(model: Model, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each word in each language, and its document."""
    three, two, begins, doc = _grams(points, starts)
    if not len(three):
        return np.zeros((0, len(model.languages)), dtype=np.float32), doc
    letter = model.three[three] - np.where(begins[:, None], model.words, model.two[two])
    return np.add.reduceat(letter, np.flatnonzero(begins), axis=0), doc


def mixtures(ll: np.ndarray, doc: np.ndarray, n_docs: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each document, and how many languages were kept. Words of a document lie together.

    Expectation-maximisation first with all languages, then, for the sets of the 1, 2, … largest, with those
    alone; the set with the best log likelihood less half the logarithm of the number of words per free
    proportion is taken. A larger set is tried only if the likelihood of all languages could make it win.
    """
    k = ll.shape[1]
    shares, kept = np.zeros((n_docs, k)), np.zeros(n_docs, dtype=np.int32)
    present, first, n = np.unique(doc, return_index=True, return_counts=True)
    if not len(present):
        return shares, kept
    top = ll.max(axis=1)
    like = np.exp(ll - top[:, None])
    base = np.add.reduceat(top.astype(np.float64), first)
    active = np.ones((len(present), k), dtype=bool)
    pi, all_ll = _em(like, np.repeat(np.arange(len(present)), n), first, n, active, iterations)
    all_ll += base
    order = np.argsort(-pi, axis=1, kind="stable")
    single = np.add.reduceat(ll.astype(np.float64), first, axis=0)
    best_one = single.argmax(axis=1)
    best = single.max(axis=1)
    shares[present, best_one] = 1.0
    kept[present] = 1
    price = 0.5 * np.log(np.maximum(n, 2))
    for size in range(2, k + 1):
        todo = np.flatnonzero(all_ll - price * (size - 1) > best)
        if not len(todo):
            break
        mask = np.zeros((len(todo), k), dtype=bool)
        np.put_along_axis(mask, order[todo, :size], True, axis=1)
        words = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in todo])
        count = n[todo]
        begin = np.cumsum(count) - count
        p, got = _em(like[words], np.repeat(np.arange(len(todo)), count), begin, count, mask, iterations)
        value = got + base[todo] - price[todo] * (size - 1)
        won = value > best[todo]
        best[todo[won]] = value[won]
        shares[present[todo[won]]] = p[won]
        kept[present[todo[won]]] = size
    return shares, kept


def _em(like, doc, first, n, active, iterations):
    pi = active / active.sum(axis=1, keepdims=True)
    pi = pi.astype(np.float32)
    for _ in range(iterations):
        r = like * pi[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        pi = np.add.reduceat(r, first, axis=0) / n[:, None].astype(np.float32)
    total = np.maximum((like * pi[doc]).sum(axis=1), 1e-30)
    return pi.astype(np.float64), np.add.reduceat(np.log(total.astype(np.float64)), first)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, languages): the language with the largest share of the words, that share,
    and all languages kept, as (lang, share), largest first.

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a model. Ties go
    to the first language in code point order. Every row gives a row, repeated ones too; whole texts are read,
    one chunk of characters at a time.
    """
    columns = "id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            for first, end, points, starts in chunks(texts) if known else ():
                ll, doc = _word_likelihood(known, points, starts)
                shares, kept = mixtures(ll, doc, end - first)
                for i in np.flatnonzero(kept).tolist():
                    ranked = np.argsort(-shares[i], kind="stable")[: kept[i]]
                    pred[first + i] = known.languages[ranked[0]]
                    score[first + i] = min(1.0, float(shares[i, ranked[0]]))
                    sets[first + i] = [{"lang": known.languages[j], "share": float(shares[i, j])} for j in ranked if shares[i, j] > 0]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, kind)], ["id", "lang_pred", "score", "languages"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, columns)


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents whose language is known and has more than ``least`` of the words; all columns as they are.

    Null texts and texts without a letter go; without a model all go. Rows are judged one by one, nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            good = np.zeros(len(texts), dtype=bool)
            for first, end, points, starts in chunks(texts) if known else ():
                ll, doc = _word_likelihood(known, points, starts)
                shares, kept = mixtures(ll, doc, end - first)
                good[first:end] = (kept > 0) & (shares.max(axis=1) > least)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str | Column = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a document's id lies in the fold that no model learns from; rows without an id do."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))

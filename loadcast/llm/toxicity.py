"""Toxicity by a support vector machine with a gap-tolerant subsequence kernel and Nyström landmarks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.llm.chars import chunks, letters
from loadcast.llm.common import cut

#: Labelled documents that are learned from at most, for either label, chosen by hash of their id.
PER_LABEL = 15_000
#: Three letters in order, within this many characters, each skipped or used character costing a factor DECAY.
SPAN, DECAY = 6, 0.7
LANDMARKS = 320
#: Units of clean documents that the machine starts from, and that join it in a round.
NEGATIVES, HARD = 6000, 2000
ROUNDS = 3
#: Units that a toxic document offers, and toxic documents from which on more than the first counts at once.
OFFERED, SURE = 4, 5
#: Letters have 63 symbols, and as many again where they begin a unit.
SYMBOLS, PLAIN = 128, 64
LONGEST = 64


@dataclass
class Model:
    """Weight of each three symbols, offset of the machine, and the line from largest unit to log odds."""

    weights: np.ndarray
    offset: float
    slope: float
    base: float


def _symbols(points: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """0 for what is no letter, 1 to 26 for a to z, the rest shared by all other letters; the first of a unit differs."""
    plain = points - np.uint32(96)
    other = (points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(PLAIN - 27) + np.uint32(27)
    s = np.where((points >= 97) & (points <= 122), plain, other)
    first = np.maximum.accumulate(np.r_[-1, unit[:-1]]) < unit
    return np.where(letters()[points], s + np.where(first, PLAIN, 0), 0).astype(np.int32)


def _units(points: np.ndarray) -> np.ndarray:
    """The unit that each character belongs to, from 0; -1 outside.

    A unit is a run of letters. Runs are joined over one character that is no white space, and over one space if
    both runs are single letters, so spaced and dotted spellings are one unit.
    """
    letter = letters()[points]
    begin = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    end = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
    if not len(begin):
        return np.full(len(points), -1)
    between = points[end[:-1]]
    one = begin[1:] - end[:-1] == 1
    single = end - begin == 1
    dotted = (between > 32) & (between != 160)
    joined = one & (dotted | ((between == 32) & single[1:] & single[:-1]))
    number = np.cumsum(np.r_[True, ~joined]) - 1
    out = np.full(len(points), -1)
    inner = np.zeros(len(points) + 1, dtype=np.int64)
    np.add.at(inner, begin, 1)
    run = np.cumsum(inner[:-1]) - 1
    out[:] = np.where(run >= 0, number[np.maximum(run, 0)], -1)
    last = np.zeros(number[-1] + 1, dtype=np.int64)
    last[number] = end
    out[(out >= 0) & (np.arange(len(points)) >= last[np.maximum(out, 0)])] = -1
    return out


def _subsequences(symbols: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(place, feature, weight) of all three-letter subsequences within the span, one pattern of gaps at a time."""
    n = len(symbols)
    for a, b in combinations(range(1, SPAN), 2):
        if n <= b:
            continue
        x, y, z = symbols[: n - b], symbols[a : n - b + a], symbols[b:]
        good = np.flatnonzero((unit[: n - b] == unit[b:]) & (x > 0) & (y > 0) & (z > 0))
        yield good, (x[good] << 14) | (y[good] << 7) | z[good], DECAY ** (b + 1)


def unit_scores(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit of each character, score of each unit): the normalised kernel expansion, collapsed to one weight a feature."""
    unit = _units(points)
    n = int(unit.max()) + 1
    total, size = np.zeros(n), np.zeros(n)
    for place, feature, w in _subsequences(_symbols(points, unit), unit):
        at = unit[place]
        total += np.bincount(at, weights=weights[feature], minlength=n) * w
        size += np.bincount(at, minlength=n) * w * w
    return unit, total / np.sqrt(np.maximum(size, 1e-9))


def _features(words: list[str], columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of normalised subsequence features of some words, and the column of each feature (-1 for none).

    Without ``columns`` every feature of these words gets one; with it, other features are left out, which
    changes no inner product with words that have none of them.
    """
    found = []
    for word in words:
        points = np.frombuffer(word.encode("utf-32-le"), dtype="<u4")
        unit = np.zeros(len(points), dtype=np.int64)
        symbols = _symbols(points, unit)
        parts = [(feature, np.full(len(feature), w)) for _, feature, w in _subsequences(symbols, unit)]
        feature, weight = (np.concatenate(x) if parts else np.zeros(0, dtype=np.int64) for x in (zip(*parts) if parts else ((), ())))
        found.append((feature, weight / max(float((weight**2).sum()), 1e-9) ** 0.5))
    if columns is None:
        every = np.unique(np.concatenate([f for f, _ in found]))
        columns = np.full(SYMBOLS**3, -1)
        columns[every] = np.arange(len(every))
    out = np.zeros((len(words), int(columns.max()) + 1))
    for row, (feature, weight) in zip(out, found):
        at = columns[feature]
        np.add.at(row, at[at >= 0], weight[at >= 0])
    return out, columns


def _split(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The distinct units of each text, without those too short for the kernel."""
    for first, end, points, starts in chunks(texts):
        unit = _units(points)
        at = np.flatnonzero(np.r_[unit[:1] >= 0, (unit[1:] != unit[:-1]) & (unit[1:] >= 0)])
        stop = np.flatnonzero(np.r_[(unit[:-1] != unit[1:]) & (unit[:-1] >= 0), unit[-1:] >= 0]) + 1
        whole = points.tobytes().decode("utf-32-le", "surrogatepass")
        doc = np.searchsorted(starts, at, side="right") - 1
        found: list[set[str]] = [set() for _ in range(end - first)]
        for d, a, b in zip(doc.tolist(), at.tolist(), stop.tolist()):
            if 3 <= b - a <= LONGEST:
                found[d].add(whole[a:b])
        for i, words in enumerate(found):
            yield first + i, sorted(words)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = PER_LABEL,
    seed: int = 5,
) -> Model | None:
    """Fits a model on a sample of at most about ``per_label`` documents of each label; None without both labels.

    A toxic document is toxic for some unit that is not known, a clean one has none. Of near copies one is
    learned from, so that their other units do not look like insults. Units are counted by label, and each
    toxic document offers those that speak most for its label. In rounds, the machine is fitted on what toxic
    documents offer against units of clean documents; then of each document's offers those that the machine
    holds for toxic stay, the highest at least, and the highest units of clean documents join the negatives.
    """
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, per_label / sizes[1])).otherwise(min(1.0, per_label / sizes[0]))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    sample = marked.where(drawn < share)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) >= 5)
    least = [F.array_min(F.transform(words, lambda w, n=n: F.xxhash64(F.lit(n), w))) for n in range(3)]
    sign = F.when(F.size(words) > 0, F.xxhash64(*least)).otherwise(F.xxhash64("text"))
    rows = cut(read.join(F.broadcast(sample), "id").select("y", "text", sign.alias("sign")).dropDuplicates(["y", "sign"]).drop("sign"))
    counted = cut(
        rows.mapInArrow(_count, "unit string, toxic long, clean long")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("odds", F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) + F.lit(float(np.log(sizes[0] / sizes[1]))))
    )
    strong = counted.where("toxic > 1 and odds > 2").orderBy(F.desc("odds"), "unit").limit(20_000).toArrow()
    clean = counted.where("clean > 0 and odds < 1")
    often = clean.orderBy(F.desc("clean"), "unit").limit(NEGATIVES // 3)
    any_of = clean.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES - NEGATIVES // 3)
    negatives = sorted(set(often.unionAll(any_of).toArrow().column("unit").to_pylist()))
    speaks = {u: (o, t) for u, o, t in zip(*(strong.column(c).to_pylist() for c in ("unit", "odds", "toxic")))}
    if not speaks or not negatives:
        return None
    offered = rows.where("y = 1").mapInArrow(_offer(speaks), "units array<string>").toArrow().column("units").to_pylist()
    chosen = [u for o in offered for i, u in enumerate(o) if not i or speaks[u][1] >= SURE]
    hard: list[str] = []
    for n in range(ROUNDS):
        weights, offset = _fit(chosen, negatives, hard)
        largest = rows.mapInArrow(_largest(weights, offset), "f double, y int, unit string").toArrow()
        f, y = largest.column("f").to_numpy(), largest.column("y").to_numpy()
        unit = largest.column("unit").to_pylist()
        known = sorted({u for o in offered for u in o})
        value = dict(zip(known, document_scores(known, weights, offset).tolist()))
        chosen = [u for o in offered for u in o if value[u] > 0 or value[u] == max(map(value.get, o))]
        worst = sorted({(v, u) for u, toxic, v in zip(unit, y, f) if not toxic and u and v > -1}, reverse=True)
        hard = sorted({*hard, *(u for _, u in worst[:HARD])})
    return Model(weights, offset, *_line(f, y, sizes[0] / max(1, (y == 0).sum()), sizes[1] / max(1, (y == 1).sum())))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("y").to_pylist()
        toxic, clean = Counter(), Counter()
        for i, words in _split(batch.column("text").to_pylist()):
            (toxic if label[i] else clean).update(words)
        units = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(units, pa.string()), pa.array([toxic[u] for u in units], pa.int64()), pa.array([clean[u] for u in units], pa.int64())],
            ["unit", "toxic", "clean"],
        )


def _offer(speaks: dict[str, tuple[float, int]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, words in _split(batch.column("text").to_pylist()):
                out.append(sorted((w for w in words if w in speaks), key=lambda w: (-speaks[w][0], w))[:OFFERED])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["units"])

    return run


def _largest(weights: np.ndarray, offset: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, units = document_scores(batch.column("text").to_pylist(), weights, offset, named=True)
            yield pa.RecordBatch.from_arrays([pa.array(f), batch.column("y"), pa.array(units, pa.string())], ["f", "y", "unit"])

    return run


def _fit(chosen: list[str], negatives: list[str], hard: list[str]) -> tuple[np.ndarray, float]:
    """Squared-hinge machine on Nyström features of units: those that toxic documents chose against all others."""
    rng = np.random.default_rng(5)
    count = Counter(chosen)
    against = sorted({*negatives, *hard} - {u for u, n in count.items() if n > 1})
    firm = [u for u, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n > 1] or sorted(count)
    part = LANDMARKS // 4
    marks = firm[: 2 * part]
    for pool, n in ((hard, part), (negatives, part)):
        marks += rng.choice(pool, min(n, len(pool)), replace=False).tolist()
    landmarks, columns = _features(sorted(set(marks)))
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    words = [*firm, *against]
    x = np.concatenate([_features(words[i : i + 256], columns)[0] @ landmarks.T for i in range(0, len(words), 256)]) @ root
    y = np.r_[np.ones(len(firm)), -np.ones(len(against))]
    cost = np.r_[np.sqrt([count[w] for w in firm]), np.ones(len(against))]
    cost[: len(firm)] *= len(against) / cost[: len(firm)].sum()
    w, offset = _squared_hinge(x, y, cost / len(x))
    weights = np.zeros(SYMBOLS**3, dtype=np.float32)
    weights[columns >= 0] = (landmarks.T @ (root @ w))[columns[columns >= 0]]
    return weights, offset


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 1000.0) -> tuple[np.ndarray, float]:
    """Newton steps on ½|w|² + c Σ cost·max(0, 1 − y f)², with an offset that costs nothing."""
    z = np.c_[x, np.ones(len(x))]
    keep = np.r_[np.ones(x.shape[1]), 1e-6]
    v = np.zeros(z.shape[1])
    for _ in range(30):
        inside = y * (z @ v) < 1
        a = z[inside] * (2 * c * cost[inside])[:, None]
        new = np.linalg.solve(np.diag(keep) + a.T @ z[inside], a.T @ y[inside])
        if np.abs(new - v).max() < 1e-8:
            break
        v = new
    return v[:-1], float(v[-1])


def _line(f: np.ndarray, y: np.ndarray, clean: float, toxic: float) -> tuple[float, float]:
    """Slope and base of the log odds, with each label weighed as in all labelled rows."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    weight = np.where(y == 1, toxic, clean)
    z = np.c_[np.clip(f, -5, 5), np.ones(len(f))]
    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (t - p)) - 1e-3 * v)
        v = v + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(v[0], 1e-3)), float(v[1])


def document_scores(texts: list[str | None], weights: np.ndarray, offset: float, named: bool = False):
    """The largest unit score of each text, the offset alone for a text without units; if asked for, also that unit."""
    out, units = np.full(len(texts), offset), [None] * len(texts)
    for first, _, points, starts in chunks(texts):
        unit, score = unit_scores(points, weights)
        if not len(score):
            continue
        begins = np.flatnonzero((unit >= 0) & (np.r_[-2, unit[:-1]] < unit) & (np.maximum.accumulate(np.r_[-1, unit[:-1]]) < unit))
        doc = np.searchsorted(starts, begins, side="right") - 1
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[first + doc[head]] = np.maximum.reduceat(score, head) + offset
        if named:
            last = len(points) - np.unique(unit[::-1], return_index=True)[1][-len(score) :]
            for d, a, b in zip(doc[head].tolist(), head.tolist(), [*head[1:].tolist(), len(score)]):
                k = a + int(score[a:b].argmax())
                if last[k] - begins[k] <= LONGEST:
                    units[first + d] = points[begins[k] : last[k]].tobytes().decode("utf-32-le", "surrogatepass")
    return (out, units) if named else out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted): how likely the label toxic is, and whether that is 0.5 or more.

    The score of a document is that of its most toxic unit, so length does not dilute it. Null and empty texts
    score as a text without units. Without a model all score 0. Each row gives a row; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = np.zeros(batch.num_rows)
            if m is not None:
                f = document_scores(batch.column("text").to_pylist(), m.weights, m.offset)
                p = 1 / (1 + np.exp(-np.clip(m.slope * np.clip(f, -5, 5) + m.base, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, predicted int")

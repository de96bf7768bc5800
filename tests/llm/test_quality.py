"""Quality votes: held-out accuracy, the vote against plain loops, and odd input."""

import random

import numpy as np
import pytest

from loadcast.llm import quality

DOCS = "doc_id long, text string, lang string, y string, h int, id string"
PIECES = "kamo tiru sena loka miro tanu bel dor fin gra".split()


def prose(seed: int, n: int, junk: bool) -> str:
    rng = random.Random(seed)
    words = [rng.choice(PIECES) + rng.choice(PIECES) for _ in range(n)]
    if not junk:
        return " ".join(words).capitalize() + "."
    return (" ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[: 2 + n // 8] for _ in range(9)))[seed // 21 % 3]


def bad(i: int) -> bool:
    return i % 7 == 0


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, prose(i, 20 + i % 60, bad(i)), "xa", None, 1, "z") for i in range(1400)]
    rows += [(9000, None, None, None, None, None), (9001, "", None, None, None, None), (9002, "ab", None, None, None, None), (9003, " \n\t ", None, None, None, None)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, None), (9004, prose(7, 60_000, True), None, None, None, None), (9005, "x" * 300_000, None, None, None, None)]
    labels = [(i, int(not bad(i)), 0) for i in range(1400)] + [(3, 1, 0), (4, None, 0), (None, 1, 0), (9001, 1, 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, y int")


def test_held_out_documents(spark, frames):
    docs, labels = frames
    model = quality.train(docs, labels.where("doc_id % 3 != 1"))
    found = quality.score(docs, model).collect()
    assert len(found) == docs.count()
    apart = [r for r in found if r.id is not None and r.id < 1400 and r.id % 3 == 1]
    assert np.mean([r.predicted == int(not bad(r.id)) for r in apart]) > 0.99
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.id in (9000, 9001, 9002):
            assert r.score == pytest.approx(model.prior)
    assert {r.predicted for r in found if r.id == 9004} == {0}
    assert len({r.score for r in found if r.id == 0}) == 1


def test_rerun_and_partitions_do_not_matter(spark, frames):
    docs, labels = frames
    some = docs.where("doc_id < 300")
    scores = []
    for n in (1, 4):
        model = quality.train(docs.repartition(n), labels.where("doc_id % 3 != 1"))
        scores.append({r.id: r.score for r in quality.score(some.repartition(n), model).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 0.02


def test_votes_are_those_of_plain_loops():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 6))
    v /= np.sqrt((v**2).sum(axis=1))[:, None]
    v[7] = v[8] = v[9]
    v[11] = 0
    good, weight = (rng.random(50) < 0.7).astype(float), rng.uniform(1, 3, 50)
    model = quality.Model(quality.Space(np.ones(1), np.ones((1, 6))), v.astype(np.float32), good, weight, 0.3)
    x = np.r_[v[:20], np.zeros((1, 6))].astype(np.float32)
    got = quality.votes(x, model, neighbours=4)
    for i, q in enumerate(x):
        near = [round(max(0.0, float(np.float32(q) @ e)) / quality.STEP) * quality.STEP for e in model.vectors]
        least = max(sorted(near, reverse=True)[3], quality.STEP)
        w = [(s if s >= least else 0) ** quality.POWER * n for s, n in zip(near, weight)]
        want = sum(a * b for a, b in zip(w, good)) / sum(w) if sum(w) else 0.3
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_document_frequencies_are_those_of_single_texts(spark, frames):
    docs, _ = frames
    counted, n = quality.document_frequencies(docs.where("doc_id < 200"))
    want = np.zeros(quality.SLOTS, dtype=int)
    texts = [r.text for r in docs.where("doc_id < 200").collect()]
    for text in texts:
        for _, _, _, slot, _ in quality._counted([text]):
            want[slot] += 1
    assert n == len(texts) and (counted == want).all()


def test_without_labels_texts_or_rows(spark, frames):
    docs, labels = frames
    none = spark.createDataFrame([], DOCS)
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.train(none, labels) is None
    assert {(r.score, r.predicted) for r in quality.score(docs, None).collect()} == {(0.5, 1)}
    one = quality.train(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score(docs, one).collect()} == {1}
    assert quality.score(none, one).collect() == []


def test_the_fit_is_bounded(spark, frames):
    docs, labels = frames
    many = docs.where("doc_id = 14").unionAll(docs.where("doc_id < 1400"))
    hot = many.unionAll(docs.selectExpr("14L AS doc_id", "concat(text, doc_id) AS text", "lang", "y", "h", "id"))
    model = quality.train(hot, labels, per_label=60, per_label_space=30)
    assert len(model.vectors) < 400

"""Codebooks and clusters against plain loops, with ties, nulls, odd values, repeats and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from loadcast.llm import centroids, codebooks, common

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code int, cluster string, _sum int"


def rows_of(n: int, width: int, seed: int, levels: int = 4) -> list[tuple]:
    """Few different values, so distances tie often."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [rng.randrange(-levels, levels) / 64 + rng.choice((0.0, 1e-4)) for _ in range(width)]
        rows.append((i, vector, rng.choice((None, 1, 2, 2, 2)), "x", 1, "y", 2))
    return rows


def odd_rows(width: int) -> list[tuple]:
    good = [0.25] * width
    bad = [None, [None, *good[1:]], [math.nan, *good[1:]], [math.inf, *good[1:]], [-math.inf, *good[1:]]]
    return [(1000 + i, v, 1, None, None, None, None) for i, v in enumerate(bad)]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def integers(vector, scale, bound):
    return [math.floor(min(max(scale * x, -bound), bound)) for x in vector]


def plain_codes(rows, parts, entries, rounds, scale):
    """Every entry compared with every part, in loops."""
    kept = [(i, label, integers(v, scale, codebooks.BOUND)) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = parts * max(1, -(-max(len(v) for *_, v in kept) // parts))
    kept = sorted(((i, label, v + [0] * (width - len(v)), v) for i, label, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    m = width // parts
    books = [[v[p * m : (p + 1) * m] for _, _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        found = [(sum((a - b) ** 2 for a, b in zip(v[p * m : (p + 1) * m], e)), n) for n, e in enumerate(books[p])]
        return min(found)

    for _ in range(rounds):
        near = [[nearest(v, p)[1] for p in range(parts)] for _, _, v, _ in kept]
        for p in range(parts):
            for n in range(len(books[p])):
                mine = [v[p * m : (p + 1) * m] for (_, _, v, _), at in zip(kept, near) if at[p] == n]
                if mine:
                    books[p][n] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, label, v, _ in kept:
        near = [nearest(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{n:02x}" for _, n in near), sum(d for d, _ in near)))
    return out, books


@pytest.mark.parametrize("n, width, entries, rounds", [(300, 8, 9, 3), (70, 7, 64, 2), (5, 8, 64, 2), (40, 8, 5, 0)])
def test_codes_are_those_of_plain_rounds(spark, n, width, entries, rounds):
    rows = rows_of(n, width, n) + odd_rows(width) + [(None, [0.5] * width, 3, None, None, None, None), (2, [0.125] * width, 2, None, None, None, None)]
    rows += [rows[0], rows[0], (3000, [], None, None, None, None, None), (3001, [1e300, -1e300, *[0.0] * (width - 2)], 5, None, None, None, None)]
    coded, books = codebooks.quantise(table(spark, rows), parts=4, entries=entries, rounds=rounds)
    want, plain = plain_codes(rows, 4, entries, rounds, codebooks.SCALE)
    found = [(r.vec, r.label, r.hex, r.error) for r in coded.selectExpr("id AS vec", "label", "lower(hex(code)) AS hex", "error").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert books.entries.tolist() == plain
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in plain for e in p for x in e).encode()).hexdigest()
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    for r in codebooks.with_label_errors(coded).collect():
        assert r.label_error == sums[r.label]


def test_active_entries_give_a_whole_scan_with_fewer_comparisons():
    rng = np.random.default_rng(3)
    x = rng.integers(-6, 6, (400, 8))
    first = codebooks.Codebooks(rng.integers(-6, 6, (2, 16, 4)), np.ones((2, 16), dtype=bool))
    code, distance = codebooks.assign(x, first)
    entries = first.entries.copy()
    entries[0, [3, 7, 8]] += rng.integers(-1, 2, (3, 4))
    moved = codebooks.Codebooks(entries, (entries != first.entries).any(axis=2))
    got, far, made = codebooks.reassign(x, code, distance, moved)
    want, near = codebooks.assign(x, moved)
    assert (got == want).all() and (far == near).all()
    assert made < 400 * 16
    large = common.squared_distances(x + (1 << 25), first.entries[:, :, :].reshape(-1, 8))
    assert large[5, 3] == sum((int(a) - int(b)) ** 2 for a, b in zip(x[5] + (1 << 25), first.entries.reshape(-1, 8)[3]))


def test_codes_of_nothing(spark):
    for rows in ([], odd_rows(8)):
        coded, books = codebooks.quantise(spark.createDataFrame(rows, SCHEMA))
        assert books is None
        assert codebooks.with_label_errors(coded).collect() == []
    with pytest.raises(ValueError):
        codebooks.quantise(spark.createDataFrame([], SCHEMA), entries=300)


def plain_clusters(rows, k, rounds, width, scale, seed):
    kept = [(i, integers(v, scale, centroids.BOUND)) for i, v, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        new = []
        for j, c in enumerate(centres):
            mine = [v for (_, v), at in zip(kept, near) if at == j]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
        centres = new
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centres


@pytest.mark.parametrize("n, width, k, rounds", [(300, 4, 8, 10), (60, 3, 5, 6), (3, 4, 8, 10), (50, 4, 1, 3), (50, 4, 4, 0)])
def test_clusters_are_those_of_plain_rounds(spark, n, width, k, rounds):
    rows = rows_of(n, width, n + 1) + odd_rows(width) + [(None, [0.5] * width, 3, None, None, None, None), (1, [0.5] * (width + 1), 3, None, None, None, None)]
    rows += [rows[0], rows[0], rows[1], (3000, [], None, None, None, None, None), (3001, [1e300] * width, 5, None, None, None, None)]
    found, centres = centroids.cluster(table(spark, rows), k=k, rounds=rounds, width=width)
    want, plain = plain_clusters(rows, k, rounds, width, centroids.SCALE, centroids.SEED)
    got = centroids.with_inertia(found, centres).collect()
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
    assert centres.tolist() == plain
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    for rows in ([], odd_rows(64)):
        found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA))
        assert len(centres) == 0
        assert centroids.with_inertia(found, centres).collect() == []


def test_loosening_holds_in_the_sphere_and_is_less_than_the_drift():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(40):
        old = rng.normal(0, 100, (4, 5))
        new = old + rng.normal(0, 10, (4, 5)) * (rng.random((4, 1)) > 0.2)
        radius = rng.uniform(0, 150, 4)
        out = centroids.plane_loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(4):
            way = rng.normal(size=(500, 5))
            x = old[i] + way / np.sqrt((way**2).sum(axis=1))[:, None] * radius[i] * rng.random((500, 1)) ** 0.2
            for j in range(4):
                if i != j:
                    gain = np.sqrt(((x - old[j]) ** 2).sum(axis=1)) - np.sqrt(((x - new[j]) ** 2).sum(axis=1))
                    assert gain.max() <= out[i, j] + 1e-9
                    assert out[i, j] <= drift[j] + 1e-9
                    less += out[i, j] < 0.9 * drift[j]
    assert less > 50


def test_bounds_save_scans():
    rng = np.random.default_rng(6)
    x = (rng.normal(0, 20, (2000, 8)) + rng.integers(0, 8, (2000, 1)) * 300).astype(np.int64)
    now = centroids.motion(x[:8], x[:8], np.zeros(8))
    at, upper, lower = centroids.scan(x, now.centres)
    scanned = 0
    for _ in range(8):
        new = np.array([x[at == j].mean(axis=0) if (at == j).any() else now.centres[j] for j in range(8)]).astype(np.int64)
        radius = np.array([upper[at == j].max(initial=0) for j in range(8)])
        now = centroids.motion(now.centres, new, radius)
        at, upper, lower, n = centroids.advance(x, at, upper, lower, now)
        assert (at == common.squared_distances(x, now.centres).argmin(axis=1)).all()
        scanned += n
    assert scanned < 8 * 2000 / 2

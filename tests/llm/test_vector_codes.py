"""Codes of vectors against a plain fit that compares everything in every round."""

import hashlib
import random

import numpy as np
import pytest

from faultline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, _key string, code int, _error int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [
        (k, np.floor(np.array(v, np.float32).astype(float) * 4096).astype(int).tolist(), label)
        for k, v, label in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    least = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in least] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            for e, own in members.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    best = [[nearest(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    listed = ",".join(str(x) for book in books for c in book for x in c)
    sha = hashlib.sha256(listed.encode()).hexdigest()
    return [
        (k, "".join(f"{e:02x}" for _, e in b), err, by_label[label], sha)
        for (k, _, label), b, err in zip(kept, best, errors)
    ]


def coded(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return vector_codes.coded_vectors(df, **options)


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def some_rows(n, length, seed, grid=None):
    draw = random.Random(seed)
    value = lambda: draw.choice(grid) if grid else draw.gauss(0, 1)
    return [(draw.randrange(n), [value() for _ in range(length)], draw.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("n,length,grid", [(300, 16, None), (300, 8, [0.0, 0.5, 1.0]), (9, 24, None)])
def test_codes_by_plain_fit(spark, n, length, grid):
    rows = some_rows(n, length, n + length, grid)
    assert plain(coded(spark, rows).collect()) == plain(brute(rows))


def test_other_sizes(spark):
    rows = some_rows(120, 12, 5)
    got = coded(spark, rows, parts=3, entries=5, n_rounds=2).collect()
    assert plain(got) == plain(brute(rows, 3, 5, 2))


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_rows(40, 8, 1)
    rows += [(1, None, 1), (None, [0.5] * 8, 1), (None, [0.25] * 8, None), (3, [nan] * 8, 1)]
    rows += [(4, [1.0] * 7 + [inf], 2), (5, [None] + [1.0] * 7, 2), rows[0], rows[0], (6, [-0.0001] * 8, 1)]
    assert plain(coded(spark, rows).collect()) == plain(brute(rows))
    assert coded(spark, []).columns == coded(spark, rows[:3]).columns
    assert coded(spark, []).count() == coded(spark, [(1, None, 1), (2, [nan], 1)]).count() == 0
    assert plain(coded(spark, [(7, [], None)]).collect()) == plain(brute([(7, [], None)]))
    with pytest.raises(ValueError, match="8 parts"):
        coded(spark, [(1, [1.0] * 9, 1)])
    with pytest.raises(Exception, match="components expected"):
        coded(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])
    with pytest.raises(Exception, match="is beyond"):
        coded(spark, [(1, [1e30] * 8, 1)])


def test_bounds_spare_scans_and_change_nothing():
    draw = np.random.default_rng(0)
    x = draw.integers(-500, 500, (2000, 4)) + 4000 * draw.integers(0, 16, (2000, 1))
    books = [x[:16].astype(np.int64)]
    held, scans = None, []
    for _ in range(8):
        held, n = vector_codes.reassigned(x, np.stack(books), held, exact=False)
        scans.append(n)
        distances = ((x[:, None] - books[-1]) ** 2).sum(axis=2)
        assert (held.code == distances.argmin(axis=1)).all()
        book = books[-1].copy()
        for e in np.unique(held.code):
            book[e] = x[held.code == e].sum(axis=0) // (held.code == e).sum()
        books.append(book)
    assert scans[0] == 2000 and min(scans[1:]) < 200


def test_displacement_is_net():
    there = np.array([[0, 0], [10, 10]])
    away = np.array([[300, 400], [10, 10]])
    moved, others = vector_codes.net_displacements(np.stack([there, away, there]))
    assert moved.tolist() == [[0, 0], [500, 0], [0, 0]]
    assert others.tolist() == [[0, 0], [0, 500], [0, 0]]

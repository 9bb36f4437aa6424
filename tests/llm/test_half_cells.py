"""Hard negatives against all scores."""

import numpy as np
import pytest

from gradeweave.llm import half_cells as cells

SCHEMA = "vec_id long, label int, ints array<long>, rank string"


def by_force(rows, asks, n_positives=5, n_negatives=10, low=30, high=90):
    """Every anchor's positives and negatives, from all scores as Python's whole numbers."""
    one = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None for x in v):
            one[i] = min(one.get(i, (label, v)), (label, v))
    dims = [len(v) for _, v in one.values()]
    one = {i: x for i, x in one.items() if len(x[1]) == max(set(dims), key=dims.count)}
    out = []
    for a in filter(asks, one):
        score = {b: sum(x * y for x, y in zip(one[a][1], one[b][1], strict=True)) for b in one if b != a}
        ordered = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in ordered if one[b][0] == one[a][0]][:n_positives]:
            inside = [b for b in ordered if one[b][0] != one[a][0] and low * score[p] <= 100 * score[b] <= high * score[p]]
            out += [(a, p, r, b, score[p], score[b]) for r, b in enumerate(inside[:n_negatives], 1)]
    return sorted(out)


def found(spark, rows, asks="vec_id % 10 = 0", **options):
    df = spark.createDataFrame([(i, label, None if v is None else [None if x is None else int(x) for x in v], "x") for i, label, v in rows], SCHEMA)
    got = cells.hard_negatives(df, asks, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(seed, n, groups, d, noise, size=200):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    return [(i, int(rng.integers(0, 4)), np.floor(size * (centres[i % groups] + noise * rng.standard_normal(d))).astype(int).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed,noise,seeds,size", [(1, 0.1, 20, 200), (2, 1.0, 5, 200), (3, 0.3, 2048, 200), (4, 0.05, 30, 40_000_000)])
def test_negatives_are_those_of_all_scores(spark, monkeypatch, seed, noise, seeds, size):
    monkeypatch.setattr(cells, "SEEDS", seeds)
    monkeypatch.setattr(cells, "BLOCK", 40)
    monkeypatch.setattr(cells, "CELL", 4)
    monkeypatch.setattr(cells, "ASKED", 7)
    rows = vectors(seed, 400, 12, 9, noise, size)
    rows += [(1000 + i, rows[0][1] + i % 2, rows[0][2]) for i in range(100)]  # one vector with many copies: ties
    want = by_force(rows, lambda i: i % 10 == 0)
    assert want and found(spark, rows) == want


def test_odd_rows_and_other_windows(spark):
    rows = [
        (0, 1, [3, 4]), (10, 1, [3, 4]), (20, 2, [3, 3]), (20, 1, [5, 5]), (5, 1, [2, 2]), (5, 1, [2, 2]), (30, 1, [0, 0]), (6, 2, [1, 2]),
        (7, 2, [1, 2]), (None, 1, [3, 4]), (8, None, [3, 4]), (9, 1, None), (11, 1, [None, 4]), (12, 1, [1, 2, 3]), (13, 1, []), (40, 9, [-3, -4]), (14, 9, [3, 4]),
    ]
    for options in ({}, {"low": 0, "high": 100}, {"n_positives": 1, "n_negatives": 1, "low": 1, "high": 99}):
        want = by_force(rows, lambda i: i % 10 == 0, **options)
        assert want and found(spark, rows, **options) == want, options
    assert found(spark, []) == [] and found(spark, rows, "false") == [] and found(spark, [(0, 1, [7]), (1, 1, [7]), (2, 2, [5])]) == [(0, 1, 1, 2, 49, 35)]


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError):
        found(spark, [(0, 1, [1 << 40, 1]), (1, 1, [1 << 40, 1])])


def test_cells_are_visited_by_falling_bounds_that_hold():
    rng = np.random.default_rng(5)
    rows = np.floor(100 * rng.standard_normal((300, 8)))
    words = tuple(cells.fit_centres(half, 6) for half in (rows[:, :4], rows[:, 4:]))
    codes = [cells.nearest_centres(half, book, 1)[:, 0] for half, book in zip((rows[:, :4], rows[:, 4:]), words, strict=True)]
    radii = []
    for half, book, code in zip((rows[:, :4], rows[:, 4:]), words, codes, strict=True):
        far = np.linalg.norm(half - book[code], axis=1)
        radii.append(np.array([far[code == w].max(initial=0) for w in range(len(book))]))
    cell = codes[0] * 6 + codes[1]
    held = np.bincount(cell, minlength=36)
    first, own = cells.blocks_for(held, 25)
    books = cells.Codebooks(words, tuple(radii), held, first, own, len(np.unique(first[held > 0])))
    for anchor in rows[:20].astype(np.int64):
        seen = list(books.visits(anchor))
        assert sorted(c for _, c in seen) == np.flatnonzero(held).tolist()
        assert all(a >= b for (a, _), (b, _) in zip(seen, seen[1:]))
        for bound, c in seen:
            assert (rows[cell == c] @ anchor).max() <= bound
        met = books.certified(anchor, 3000)
        assert set(first[[c for b, c in seen if b >= 3000]].tolist()) <= set(met.tolist())


def test_crowded_cells_have_blocks_of_their_own():
    first, own = cells.blocks_for(np.array([3, 0, 100, 4, 5, 9, 1]), 10)
    assert own.tolist() == [0, 0, 10, 0, 0, 0, 0] and first[[0, 2, 3, 4, 5, 6]].tolist() == [0, 1, 11, 11, 12, 12]

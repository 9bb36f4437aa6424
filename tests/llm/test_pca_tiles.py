"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from gradeweave.llm import pca_tiles as tiles

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_force(rows, threshold):
    """vec_id, n_links, component_id and kept of each row, from all cosines."""
    sound = [v is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    sizes = [len(v) for (_, v), s in zip(rows, sound, strict=True) if s]
    most = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    sound = [s and len(v) == most for (_, v), s in zip(rows, sound, strict=True)]
    places = [k for k, s in enumerate(sound) if s]
    m = np.array([rows[k][1] for k in places], float).reshape(len(places), most)
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    near = np.zeros((len(rows), len(rows)), bool)
    if places:
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        near[np.ix_(places, places)] = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))
    while True:
        before = list(root)
        for k in range(len(rows)):
            for j in np.flatnonzero(near[k]):
                root[k] = min(root[k], root[j])
        if root == before:
            break
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root[k]] = min((x for x in (low.get(root[k]), i) if x is not None), default=None)
    return sorted(str((i, int(near[k].sum()), low[root[k]], i is None or i == low[root[k]])) for k, (i, _) in enumerate(rows))


def found(spark, rows, threshold=0.9):
    df = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], None) for i, v in rows], SCHEMA)
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in tiles.near_duplicates(df, threshold).collect())


def spread(rng, n, groups, d, noise):
    centres = rng.standard_normal((groups, d))
    return [(int(i), centres[i % groups] + noise * rng.standard_normal(d)) for i in rng.permutation(n)]


@pytest.mark.parametrize("noise,threshold,least,d", [(0.25, 0.9, 16, 20), (0.02, 0.9, 16, 20), (0.3, 0.75, 64, 9), (0.1, 0.99, 1024, 70)])
def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch, noise, threshold, least, d):
    monkeypatch.setattr(tiles, "LEAST_TILE", least)
    monkeypatch.setattr(tiles, "GUESTS", 2)
    rows = spread(np.random.default_rng(4), 330, 9, d, noise)
    assert found(spark, rows, threshold) == by_force(rows, threshold)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (9, v), (4, v), (4, v), (7, [2.0, 4.0, 6.0]), (5, [1e300, 2e300, 3e300]), (6, [1e-300, 2e-300, 3e-300]),
        (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, float("nan"), 1.0]), (8, [float("inf"), 1.0, 1.0]), (10, [None, 1.0, 1.0]),
        (11, [1.0, 2.0]), (12, []), (None, v), (13, [-1.0, -2.0, -3.0]), (14, [-0.0, 1.0, 0.0]), (15, [0.0, 1.0, 0.0]),
    ]
    assert found(spark, rows) == by_force(rows, 0.9)
    assert found(spark, []) == [] and found(spark, rows[6:11]) == by_force(rows[6:11], 0.9)
    with pytest.raises(ValueError):
        found(spark, rows, 0.0)


def test_extra_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [1.0, 0.0], 5, 6)], "vec_id int, embedding array<float>, node long, n_links int")
    got = tiles.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_threshold_holds_at_its_edge():
    """Cosines of exactly the threshold link, whatever the turn rounds."""
    rng = np.random.default_rng(2)
    given = rng.standard_normal((40, 16))
    a = tiles.Tile(given, np.ones(40, np.int64)).turn(tiles.Axes.fit(given, 4))
    for i, j in ((0, 1), (3, 9), (20, 21)):
        at = float(tiles.cosine(given[i:i + 1], given[j:j + 1])[0])
        if at > 0:
            assert tiles.linked(a, a, i, i + 1, at)[0, j] and not tiles.linked(a, a, i, i + 1, np.nextafter(at, 2))[0, j]


def test_tiles_are_skipped_and_taken_whole_only_when_sure(spark, monkeypatch):
    """Bounds on pairs of tiles against all cosines between them."""
    import pandas as pd

    rng = np.random.default_rng(8)
    rows = np.concatenate([c + s * rng.standard_normal((12, 10)) for c, s in zip(rng.standard_normal((30, 10)), rng.choice([0.01, 0.1, 0.5], 30), strict=True)])
    axes = tiles.Axes.fit(rows, 8)
    made = []
    for k in range(30):
        t = tiles.Tile(rows[12 * k:12 * k + 12], np.ones(12, np.int64)).turn(axes)
        centre = tiles.units(t.turned.mean(axis=0, keepdims=True))[0]
        lead = t.turned[:, :tiles.LEADING]
        made.append({"t": t, "box_low": lead.min(axis=0), "box_high": lead.max(axis=0), "tails": t.suffix[:, 1:tiles.LEADING + 1].max(axis=0),
                     "centre": centre, "spread": float(np.arccos(np.clip(t.turned @ centre, -1, 1)).max())})
    a, b = (pd.DataFrame([made[i] for i in at.ravel()]) for at in np.meshgrid(range(30), range(30)))
    may, sure = tiles.reach(a, b, 0.9)
    cosines = [(x.turned @ y.turned.T) for x, y in zip(a["t"], b["t"], strict=True)]
    assert all(m or (c < 0.9).all() for m, c in zip(may, cosines, strict=True)) and not may.all()
    assert all(not s or (c >= 0.9).all() for s, c in zip(sure, cosines, strict=True)) and sure.any()

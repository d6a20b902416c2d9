"""Bounds from landmarks: fewer pairs, the same neighbours."""

import numpy as np

from strideframe.operators.models import neighbours as knn


def plain(train, keys, test, k):
    exact = ((train[None] - test[:, None]) ** 2).sum(axis=2)
    return [np.lexsort((keys, row))[:k].tolist() for row in exact]


def test_bounds_lose_no_neighbour_and_save_pairs():
    rng = np.random.default_rng(2)
    train, test, keys = rng.normal(size=(4000, 6)), rng.normal(size=(300, 6)), rng.permutation(4000)
    train[::7] = train[0]  # equal rows
    test[:5] = train[0]
    for k in (1, 5):
        bounds = knn.upper_bounds(test, train[:500], k)
        exact = np.sort(((train[None] - test[:, None]) ** 2).sum(axis=2), axis=1)
        assert (bounds >= exact[:, k - 1]).all() and (exact <= bounds[:, None]).sum(axis=1)[5:].mean() < 400
        i, j, _ = knn.nearest_in_block(train, keys, test, k, bounds)
        assert [j[i == row].tolist() for row in range(len(test))] == plain(train, keys, test, k)
        cells = knn.reachable_cells(knn.distances(test, train[:64]), np.full(64, 0.5), np.full(64, 60), k, np.sqrt(bounds))
        loose = knn.reachable_cells(knn.distances(test, train[:64]), np.full(64, 0.5), np.full(64, 60), k)
        assert cells.sum() <= loose.sum() and not (cells & ~loose).any()
    assert np.isinf(knn.upper_bounds(test, train[:3], 5)).all()


def test_rows_far_from_the_origin_keep_their_order():
    rng = np.random.default_rng(3)
    train = 1e6 + rng.normal(size=(200, 3)) * 1e-3
    test = train[:20] + 1e-5
    i, j, _ = knn.nearest_in_block(train, np.arange(200), test, 2)
    assert [j[i == row].tolist() for row in range(20)] == plain(train, np.arange(200), test, 2)


def test_block_with_rows_that_are_no_numbers():
    train = np.array([[0.0], [np.nan], [2.0]])
    i, j, _ = knn.nearest_in_block(train, np.arange(3), np.array([[1.9], [np.nan]]), 1)
    assert i.tolist() == [0] and j.tolist() == [2]


def test_a_row_meets_few_cells_and_keeps_its_neighbours(spark):
    """Rows meet their own cell first; a tight bound leaves few others, so rows are not sent to most of the cells."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 3)), np.tile(rng.normal(size=(1, 3)), (300, 1))])
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key long, label int, features array<double>")
    train, test = df.filter("key % 4 <> 0"), df.filter("key % 4 = 0")
    keys = np.flatnonzero(np.arange(1200) % 4)
    for k in (1, 4, 40):
        got = {}
        for r in knn.nearest(train, test, "key", "label", k, pivots=32, block=50).collect():
            got.setdefault(r["key"], {})[r["place"]] = r["neighbour"]
        want = plain(x[keys], keys, x[::4], k)
        assert {q: [keys[j] for j in want[i]] for i, q in enumerate(range(0, 1200, 4))} == {q: [g[p] for p in sorted(g)] for q, g in got.items()}
    points = x[keys][:32]
    to, gaps = knn.distances(x, points), knn.distances(points, points)
    home = to.argmin(axis=1)
    radius = np.array([to[home == c, c].max(initial=0) for c in range(32)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    reach = np.sort(d, axis=1)[:, 2] + 1e-7
    ball = knn.reachable_cells(to, radius, np.bincount(home, minlength=32), 1, reach)
    both = ball & knn.crossed_cells(to, home, gaps, reach, (x**2).sum(axis=1) + 100)
    for i in range(1200):
        assert both[i, home[d[i] <= reach[i]]].all()
    assert both.sum() < 0.6 * ball.sum()
    assert knn.rows_of_block(6) == 1 << 16 and knn.rows_of_block(561) * 8 * 564 <= knn.BLOCK_BYTES

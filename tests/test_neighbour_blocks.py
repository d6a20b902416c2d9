"""Nearest rows of a block against plain sorting, ties included."""

import numpy as np

from strideframe.operators.models import neighbours as knn


def test_block_equals_sorting_with_ties(monkeypatch):
    monkeypatch.setattr(knn, "TILE_ROWS", 16, raising=False)
    monkeypatch.setattr(knn, "TILE_PAIRS", 64, raising=False)
    rng = np.random.default_rng(1)
    train = rng.integers(0, 3, (120, 3)).astype(float)  # most rows have equals
    test = np.concatenate([rng.integers(0, 3, (40, 3)), rng.normal(size=(30, 3))])
    keys = rng.permutation(120)
    for k in (1, 5, 200):
        i, j, distance = knn.nearest_in_block(train, keys, test, k)
        exact = ((train[None] - test[:, None]) ** 2).sum(axis=2)
        want = [np.lexsort((keys, row))[:k] for row in exact]
        assert i.tolist() == np.repeat(np.arange(len(test)), min(k, 120)).tolist()
        assert j.tolist() == np.concatenate(want).tolist()
        assert np.allclose(distance, exact[i, j])

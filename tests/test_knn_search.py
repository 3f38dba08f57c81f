"""The search inside a KNN task against plain numpy, and what it compares and holds."""

import numpy as np
import pytest

from corvid.operators import knn


def _fit(spark, x, labels=None, **kw):
    rows = [(i, [float(v) for v in r], int(i % 5)) for i, r in enumerate(x)]
    return knn.store_training(spark.createDataFrame(rows, "id long, v array<double>, l int").repartition(1),
                              features="v", label_col="l", train_id="id", **kw)


def _blocks(spark, fit, kk):
    return [knn._Block(r.file, kk) for r in spark.read.parquet(f"{fit.path}/pages").collect()]


def _search(blocks, q, kk, power, weights=None):
    near = knn._Nearest(q, kk, power, weights)
    for block in blocks:
        near.search(block, np.arange(len(q)))
    _, ids, _, dist = near.done
    return np.asarray(ids).reshape(len(q), kk), dist.reshape(len(q), kk)


def _brute(x, q, kk, power, weights=None):
    d = knn._distances(q, x, power, weights)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :kk]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("dim", [1, 3, 20])
def test_search_is_exact(spark, dim):
    rng = np.random.default_rng(dim)
    usual, grid = rng.normal(size=(1500, dim)), np.rint(rng.normal(size=(1500, dim)))
    uneven = rng.normal(size=(1500, dim)) * np.exp(4 * rng.normal(size=dim)) + 1000
    huge = rng.normal(size=(1500, dim)) * 1e-20
    huge[5] *= 1e45
    for x in (usual, grid, uneven, huge):
        blocks = _blocks(spark, _fit(spark, x, block_rows=600), 7)
        q = np.concatenate([x[:40], x[40:60] + 1e-7, rng.normal(size=(20, dim))])
        for power in (1.0, 2.0, 2.5, 3.0):
            for weights in (None, rng.random(dim) + 0.1):
                for b in blocks:
                    b.rough = None
                got, want = _search(blocks, q, 7, power, weights), _brute(x, q, 7, power, weights)
                assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize("power", [1.0, 2.0, 3.0])
def test_few_pairs_are_added_up_exactly(spark, monkeypatch, power):
    """All pairs were added up in double precision, feature by feature."""
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(6000, 32)), rng.normal(size=(100, 32))
    blocks, want = _blocks(spark, _fit(spark, x), 5), _brute(x, q, 5, power)
    exact, pairs, whole = knn._pair_distances, [], []
    monkeypatch.setattr(knn, "_pair_distances", lambda a, *rest: pairs.append(len(a)) or exact(a, *rest))
    monkeypatch.setattr(knn, "_distances", lambda *a: whole.append(1))
    got = _search(blocks, q, 5, power)
    assert (got[0] == want[0]).all() and not whole
    assert sum(pairs) < 0.02 * 100 * 6000


def test_few_leaves_are_compared(spark, monkeypatch):
    """with few features a row was compared with whole blocks."""
    rng = np.random.default_rng(2)
    x, q = rng.random((20_000, 2)), rng.random((3000, 2))
    blocks, want = _blocks(spark, _fit(spark, x), 3), _brute(x, q, 3, 2.0)
    exact, pairs = knn._distances, []
    monkeypatch.setattr(knn, "_distances", lambda a, b, *rest: pairs.append(len(a) * len(b)) or exact(a, b, *rest))
    got = _search(blocks, q, 3, 2.0)
    assert (got[0] == want[0]).all() and sum(pairs) < 0.2 * 3000 * 20_000


def test_ties_are_bounded(spark, monkeypatch):
    """every row tied with the last neighbour stayed in memory to the end."""
    x = np.repeat(np.arange(4.0), 3000)[:, None]
    blocks = _blocks(spark, _fit(spark, x, block_rows=5000), 3)
    assert max(len(b.x) for b in blocks) <= 4 * 3  # of rows with one vector the smallest keys
    q = np.repeat(np.arange(4.0), 50)[:, None]
    assert (_search(blocks, q, 3, 2.0)[0] == np.repeat(np.arange(4), 50)[:, None] * 3000 + np.arange(3)).all()
    # different vectors at one distance: corners of a cube, asked from its middle
    x = np.array([[(i >> j & 1) * 2.0 - 1 for j in range(13)] for i in range(1 << 13)])
    blocks, held = _blocks(spark, _fit(spark, x), 3), []
    add = knn._Nearest.add
    monkeypatch.setattr(knn._Nearest, "add", lambda self, *a: (add(self, *a), held.append(self.n_open)))
    assert (_search(blocks, np.zeros((400, 13)), 3, 2.0)[0] == np.arange(3)).all()
    assert max(held) <= 1 << 18

import hashlib

import numpy as np
import pytest

from corvid.llm import centroids


def plain(rows, k=16, rounds=3, dim=64, scale=64):
    """The same clustering with whole distances, in Python's integers."""
    kept = [(i, [int(np.floor(scale * v)) for v in x]) for i, x in rows
            if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cs = [x for _, x in named[:k]]
    if not cs:
        return []
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    put = lambda: [min((dist(x, c), j) for j, c in enumerate(cs)) for _, x in kept]
    for _ in range(rounds):
        at = put()
        for j in range(len(cs)):
            mine = [x for (_, x), (_, c) in zip(kept, at, strict=True) if c == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = put()
    by = {j: sum(d for d, c in at if c == j) for j in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((-1 if i is None else i, c, d, by[c], sum(by.values()), sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, x, 1, "a", 2.0) for i, x in rows], "vec_id long, embedding array<double>, cluster int, x string, distance double")
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in (tuple(r) for r in centroids.cluster(df, **kw).collect()))


def test_transform_keeps_distances():
    x = np.random.default_rng(1).integers(-50, 50, (20, 64))
    t = centroids.transform(x)
    assert ((t[:, None] - t[None]) ** 2).sum(axis=2).tolist() == (64 * ((x[:, None] - x[None]) ** 2).sum(axis=2)).tolist()
    assert (t[:, 0] == x.sum(axis=1)).all()  # the coarsest coefficient


def test_search_equals_whole_distances():
    rng = np.random.default_rng(2)
    for width, k in ((1, 3), (2, 1), (64, 16), (64, 2)):
        x, c = rng.integers(-3, 4, (300, width)), rng.integers(-3, 4, (k, width))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        best, got = centroids.nearest(centroids.transform(x), centroids.transform(c))
        assert best.tolist() == d.argmin(axis=1).tolist() and got.tolist() == d.min(axis=1).tolist()


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.2, 64) + (i % 5) / 4).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(6)] + [rows[3], rows[3], (None, rows[4][1])]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.5] * 63), (305, [float("nan")] + [0.0] * 63),
             (306, [float("inf")] + [0.0] * 63), (307, [float("-inf")] + [0.0] * 63), (308, [-0.0] * 64), (309, [-1e-9] * 64), (310, [1e6] * 64)]
    assert run(spark, rows) == plain(rows)


def test_few_vectors_none_and_other_sizes(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(None, [0.0] * 64)]) == []
    assert run(spark, [(7, [0.25] * 64)]) == plain([(7, [0.25] * 64)])
    same = [(i, [0.5] * 64) for i in range(30)]  # all equal: one cluster, the first; the others stay empty
    assert run(spark, same) == plain(same) and {r[1] for r in run(spark, same)} == {0}
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 5).tolist()) for i in range(60)]
    assert run(spark, rows, k=4, dim=5, scale=10, rounds=2) == plain(rows, k=4, dim=5, scale=10, rounds=2)
    with pytest.raises(Exception, match="too large|Overflow|too big"):
        run(spark, [(1, [1e300] * 64), (2, [0.0] * 64)])

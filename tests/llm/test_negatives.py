import math

import numpy as np
import pytest

from corvid.llm import negatives
from corvid.llm.shared import work_dir


def plain(rows, positives=5, take=3, low=50, high=95, every=50, scale=256):
    """All pairs."""
    kept = [(i, y, [math.floor(scale * v) for v in x]) for i, x, y in rows
            if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for i, y, x in kept:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(x, z, strict=True)), j, w) for j, w, z in kept if len(z) == len(x)]
        same = sorted((s, j) for s, j, w in score if w == y and j != i)[:positives]
        for p, j in same:
            good = sorted((s, n) for s, n, w in score if w != y and low * -p <= 100 * -s <= high * -p)[:take]
            out += [(i, j, k, n, -p, -s) for k, (s, n) in enumerate(good, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id long, embedding array<double>, label int, rank int, x string")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **kw).collect())


def vectors(n, dim, seed, step=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (4, dim))
    x = centres[rng.integers(0, 4, n)] + rng.normal(0, 0.1, (n, dim))
    return [(i, (v if step is None else np.round(v / step) * step).tolist(), int(i * 7 % 3)) for i, v in enumerate(x)]


def test_equals_all_pairs_in_small_and_large_blocks(spark):
    rows = vectors(400, 16, 1)
    assert run(spark, rows, every=20) == plain(rows, every=20)
    assert run(spark, rows, every=20, block_rows=37, chunk_rows=3) == plain(rows, every=20)


def test_ties_and_repeated_rows(spark):
    rows = vectors(300, 3, 2, step=0.25)  # many equal scores
    rows += rows[:60] + [(1000 + 50 * i, [0.0, 0.0, 0.0], i % 2) for i in range(3)]
    assert run(spark, rows, block_rows=50) == plain(rows)


def test_odd_rows(spark):
    rows = vectors(120, 4, 3)
    rows += [(None, [1.0] * 4, 1), (500, None, 1), (550, [1.0] * 4, None), (600, [None, 1.0, 1.0, 1.0], 2), (650, [float("nan")] * 4, 0),
             (700, [float("inf")] * 4, 0), (750, [], 1), (751, [], 1), (752, [], 2), (800, [0.5] * 3, 1), (801, [0.5] * 3, 1), (802, [0.4] * 3, 2),
             (850, [2e6] * 4, 5), (851, [2e6] * 4, 5), (852, [1.7e6] * 4, 6)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, block_rows=7, chunk_rows=2) == plain(rows)
    with pytest.raises(Exception, match="too large"):  # a score of more than 64 bits
        run(spark, [(50, [1e7] * 4, 1), (51, [1e7] * 4, 1), (52, [8e6] * 4, 2)])
    assert run(spark, []) == [] and run(spark, [(50, [1.0], 1)]) == []


def test_scan_stops_early_and_skips_no_tie():
    """The lists are left as soon as no row can count any more."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(90, 100, (50, 8)), rng.integers(-100, 0, (5000, 8))])
    order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
    block = negatives.Lists.__new__(negatives.Lists)
    block.ids, block.x, block.lists, block.most, block.kept = np.arange(len(x)), x, order, 100, {}
    best, met = negatives.Best(5), []
    block.scan(np.full(8, 3), 3, best.floor, lambda i, s: (met.extend(i.tolist()), best.offer(i, s)))
    want = sorted(range(len(x)), key=lambda i: (-3 * int(x[i].sum()), i))[:5]
    assert best.ids.tolist() == want and len(met) < 1000


def test_one_label_holds_a_third(spark):
    rows = [(i, x, 0 if i % 3 else y) for i, x, y in vectors(300, 8, 6)]
    assert run(spark, rows, block_rows=32) == plain(rows)
    folder = work_dir(spark, "blocks")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    negatives.store_lists(negatives.taking_part(df), folder, 256, 32)
    sizes = [len(r.ids) // 8 for r in spark.read.parquet(f"{folder}/blocks").select("ids").collect()]
    assert sum(sizes) == 300 and max(sizes) <= 32

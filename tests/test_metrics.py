import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from corvid.operators import metrics
from corvid.operators.scan import prefix_sums


def _scores(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.3), (1, 0.3), (0, 0.1), (1, 0.8), (0, None)]
    return spark.createDataFrame(rows, "label int, score double")


def test_auc_matches_evaluator(spark):
    df = _scores(spark)
    got = metrics.auc(df, "label", "score").first().auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    ref = ev.evaluate(df.dropna().withColumn("label", F.col("label").cast("double")))
    assert got == pytest.approx(ref, abs=1e-12)


def test_auc_edge_cases(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.5)], "label int, score double")
    assert metrics.auc(one, "label", "score").first().auc is None
    perfect = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.2)], "label int, score double")
    assert metrics.auc(perfect, "label", "score").first().auc == 1.0


def test_roc_points(spark):
    pts = metrics.roc_points(_scores(spark), "label", "score").orderBy(F.desc("threshold")).collect()
    assert [p.threshold for p in pts] == [0.9, 0.8, 0.7, 0.3, 0.1]
    assert (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)
    assert (pts[0].fpr, pts[0].tpr) == (1 / 3, 0.25)


def test_confusion_sums_to_n(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "a int, p int")
    cm = metrics.confusion_matrix(df, "a", "p").orderBy("a").collect()
    assert [(r.a, r.pred_0, r.pred_1, r.pred_2) for r in cm] == [(0, 1, 1, 0), (1, 0, 2, 0), (2, 1, 0, 0)]


def test_value_shares(spark):
    df = spark.createDataFrame([(True,), (True,), (False,)], "s boolean")
    got = {r.s: r.share for r in metrics.value_shares(df, "s").collect()}
    assert got == {True: 2 / 3, False: 1 / 3}


def test_kde_matches_numpy(spark):
    x = np.array([1.0, 2.0, 2.5, 4.0, 7.0, 7.5, 9.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = metrics.kde_grid(df, "x", points=50).orderBy("j").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    rng = x.max() - x.min()
    grid = np.linspace(x.min() - rng / 2, x.max() + rng / 2, 50)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(got.density.to_numpy(), dens, atol=1e-12)


def test_prefix_sums_any_bucket_count(spark):
    rng = np.random.default_rng(0)
    vals = rng.permutation(200).astype(float)
    df = spark.createDataFrame([(float(v), int(v) % 7) for v in vals], "o double, w long")
    ref = None
    for b in (1, 3, 64):
        got = {r.o: r.cum_w for r in prefix_sums(df, "o", ["w"], n_buckets=b).collect()}
        if ref is None:
            ref = got
            srt = sorted(got)
            run = 0
            for o in srt:
                run += int(o) % 7
                assert got[o] == run
        assert got == ref


def test_kde_narrow_bandwidth_keeps_every_term(spark):
    # two tight clusters far apart: most grid points are out of every value's reach
    x = np.r_[np.zeros(50), np.full(50, 1000.0)] + np.linspace(0, 1e-3, 100)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = metrics.kde_grid(df, "x", points=1000).orderBy("j").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    rng = x.max() - x.min()
    grid = np.linspace(x.min() - rng / 2, x.max() + rng / 2, 1000)
    z = (grid[:, None] - x[None, :]) / h
    dens = np.exp(-0.5 * z ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(got.density.to_numpy(), dens, rtol=1e-9, atol=1e-15)


def _pruned_reference(scores, labels):
    """Collinear-point pruning written out with numpy (no library ROC at hand)."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    distinct = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[distinct]
    fps = (1 + distinct) - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    return s[distinct][keep], fps[keep] / fps[-1], tps[keep] / tps[-1]


def test_roc_pruning_matches_reference(spark):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 40, 300).astype(float)
    labels = (rng.random(300) < 0.4).astype(int)
    df = spark.createDataFrame([(int(l), float(sc)) for l, sc in zip(labels, scores)], "label int, score double")
    got = metrics.roc_points(df, "label", "score", drop_intermediate=True, n_buckets=5).orderBy(
        F.desc("threshold")).toPandas()
    th, fpr, tpr = _pruned_reference(scores, labels)
    assert list(got.threshold) == list(th)
    assert np.allclose(got.fpr, fpr) and np.allclose(got.tpr, tpr)
    full = metrics.roc_points(df, "label", "score").count()
    assert len(got) < full
    origin = metrics.roc_points(df, "label", "score", with_origin=True).filter(F.col("threshold").isNull()).first()
    assert (origin.fpr, origin.tpr) == (0.0, 0.0)


def test_confusion_counts_every_row(spark):
    rows = [(0, 0), (0, None), (None, 1), (1, 7), (1, 1), (None, None)]
    df = spark.createDataFrame(rows, "a int, p int")
    cm = {r.a: (r.pred_0, r.pred_1, r.pred_other, r.pred_missing) for r in metrics.confusion_matrix(df, "a", "p", labels=[0, 1]).collect()}
    assert cm == {0: (1, 0, 0, 1), 1: (0, 1, 1, 0), 7: (0, 0, 0, 0), None: (0, 1, 0, 1)}
    assert sum(map(sum, cm.values())) == len(rows)
    cells = {(r.a, r.p): r.n for r in metrics.confusion_cells(df, "a", "p").collect()}
    assert cells == {k: 1 for k in rows}


def test_auc_with_more_pairs_than_a_long_holds(spark):
    sc = spark.createDataFrame([(0.2, 1_000_000_000, 3_500_000_000), (0.8, 3_000_000_000, 500_000_000)], "score double, pos long, neg long")
    p, n = 4e9, 4e9
    want = (1e9 * 3.5e9 * 0.5 + 3e9 * (3.5e9 + 0.25e9)) / (p * n)
    assert metrics.auc_of_counts(sc).first().auc == pytest.approx(want)


def test_value_shares_by_group_with_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1)], "g string, v int")
    got = {(r.g, r.v): r.share for r in metrics.value_shares(df, "v", by=["g"]).collect()}
    assert got == {("a", 1): 2 / 3, ("a", 2): 1 / 3, (None, 1): 1.0}


def test_pruned_roc_is_the_same_for_any_ranges(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(int(rng.random() < 0.3), float(s)) for s in rng.integers(0, 60, 400)], "label int, score double")
    out = [sorted(map(tuple, metrics.roc_points(df, "label", "score", drop_intermediate=True, n_buckets=b).collect())) for b in (None, 1, 7, 40)]
    assert all(o == out[0] for o in out)

"""Model evaluation on any (label, prediction/score) table: value shares
(A4), counts (A6, A7), confusion matrix (A9), ROC points (A10), AUC (A11) and
a Gaussian kernel density on a grid (A12).  Only small aggregates and
scalars reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.encode import MOST_COLUMNS, category_list
from corvid.operators.scan import prefix_sums
from corvid.session import materialize, spread


def value_shares(df: DataFrame, col: str, by: Sequence[str] = (), share_col: str = "share") -> DataFrame:
    """A4: frequency of every value as a share of the rows (within ``by``).  The
    total is a one-row sum of the counts (with ``by``, one row per group joined
    back), so no task holds all distinct values."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.withColumn(share_col, F.col("n") / counts.agg(F.sum("n")).scalar())
    total = counts.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.sum("n").alias("_total"))
    cond = None
    for c in by:
        one = counts[c].eqNullSafe(total[f"_by_{c}"])
        cond = one if cond is None else cond & one
    out = counts.join(total, cond)
    return out.select(*by, col, "n", (F.col("n") / F.col("_total")).alias(share_col))


def confusion_cells(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A9 as a table: (actual, predicted, n) for every pair that occurs; a missing
    label or prediction is a value of its own, so the counts add up to all rows."""
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence | None = None,
                     prefix: str = "pred_", most: int = MOST_COLUMNS) -> DataFrame:
    """A9 as a view of ``confusion_cells``: one row per actual label (a missing one
    included), one count column per label, and ``other`` and ``missing`` columns
    for predictions outside the labels and for none (empty cells 0; labels seen
    only as predictions still get a row).  The cells add up to the rows.  Without ``labels``
    more than ``most`` different ones are an error: use ``confusion_cells``."""
    counts = materialize(confusion_cells(df, actual, predicted))
    if labels is None:
        both = counts.select(F.col(actual).alias("_l")).union(counts.select(F.col(predicted).alias("_l")))
        labels = category_list(both, "_l", most)
    labels = list(labels)
    rows = counts.unionByName(counts.where(F.col(predicted).isNotNull()).select(
        F.col(predicted).cast(counts.schema[actual].dataType).alias(actual), F.lit(None).cast(counts.schema[predicted].dataType).alias(predicted),
        F.lit(0).cast("long").alias("n")))
    cell = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(prefix + name)
    known = F.col(predicted).isin(labels)
    return rows.groupBy(actual).agg(*[cell(F.col(predicted) == F.lit(v), str(v)) for v in labels],
                                    cell(F.col(predicted).isNotNull() & ~known, "other"), cell(F.col(predicted).isNull(), "missing"))


def _score_counts(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(score, pos, neg) per distinct score, written once: the quantile cut,
    the totals and both prefix-sum branches all read it."""
    valid = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    pos = (F.col(label) == F.lit(positive)).cast("long")
    return materialize(valid.groupBy(F.col(score).alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(F.lit(1) - pos).alias("neg")))


def roc_points(df: DataFrame, label: str, score: str, positive=1, n_buckets: int | None = None,
               drop_intermediate: bool = False, with_origin: bool = False) -> DataFrame:
    """A10: (threshold, fpr, tpr) at every distinct score, highest first.

    By default all points are kept.  ``drop_intermediate`` drops the points
    whose false and true positive counts both lie on a straight line with
    their neighbours (zero second difference), keeping the first and last --
    the usual pruning of collinear points.  The neighbours are those in the
    same range of scores, and at its ends the border rows of the next ranges.
    ``with_origin`` adds the (0, 0) start point with a NULL threshold."""
    sc = _score_counts(df, label, score, positive)
    cum = prefix_sums(sc, "score", ["pos", "neg"], ascending=False, n_buckets=n_buckets, keep_bucket="_bk")
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    p_tot, n_tot = tot["P"] or 0, tot["N"] or 0
    pts = cum.select(F.col("score").alias("threshold"), "_bk", F.col("cum_pos").alias("_tp"), F.col("cum_neg").alias("_fp"))
    if drop_intermediate:
        here = Window.partitionBy("_bk").orderBy(F.col("threshold").desc())
        ends = pts.groupBy("_bk").agg(*[f(c, "threshold").alias(f"_{side}{c}") for c in ("_tp", "_fp")
                                        for side, f in (("first", F.max_by), ("last", F.min_by))])
        order = Window.orderBy("_bk")  # one row per range
        ends = ends.select("_bk", *[F.lag(f"_last{c}").over(order).alias(f"_prev{c}") for c in ("_tp", "_fp")],
                           *[F.lead(f"_first{c}").over(order).alias(f"_next{c}") for c in ("_tp", "_fp")])
        pts = pts.withColumns({f"_b{c}": F.lag(c).over(here) for c in ("_tp", "_fp")}
                              | {f"_a{c}": F.lead(c).over(here) for c in ("_tp", "_fp")}).join(F.broadcast(ends), "_bk")
        before = {c: F.coalesce(f"_b{c}", f"_prev{c}") for c in ("_tp", "_fp")}
        after = {c: F.coalesce(f"_a{c}", f"_next{c}") for c in ("_tp", "_fp")}
        bend = F.lit(False)
        for c in ("_tp", "_fp"):
            bend = bend | before[c].isNull() | after[c].isNull() | ((before[c] - 2 * F.col(c) + after[c]) != 0)
        pts = pts.filter(bend).select("threshold", "_tp", "_fp")
    pts = pts.select("threshold", "_tp", "_fp")
    if with_origin:
        origin = sc.limit(1).select(F.lit(None).cast(sc.schema["score"].dataType).alias("threshold"),
                                    F.lit(0).cast("long").alias("_tp"), F.lit(0).cast("long").alias("_fp"))
        pts = origin.unionByName(pts)
    return pts.select("threshold",
                      F.try_divide(F.col("_fp").cast("double"), F.lit(float(n_tot))).alias("fpr"),
                      F.try_divide(F.col("_tp").cast("double"), F.lit(float(p_tot))).alias("tpr"))


def auc(df: DataFrame, label: str, score: str, positive=1, n_buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half (rank-sum form).
    One row, NULL when only one class is present."""
    sc = _score_counts(df, label, score, positive)
    return auc_of_counts(sc, n_buckets)


def auc_of_counts(sc: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """A11 from (score, pos, neg) rows with distinct scores.  Products are taken as
    doubles: positives times negatives does not fit a 64-bit integer for long."""
    cum = prefix_sums(sc, "score", ["neg"], ascending=True, inclusive=False, n_buckets=n_buckets)
    part = F.col("pos").cast("double") * (F.col("cum_neg") + F.col("neg") * 0.5)
    agg = cum.agg(F.sum(part).alias("s"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                             F.col("s") / (F.col("P").cast("double") * F.col("N").cast("double"))).alias("auc"))


def kde_grid(df: DataFrame, col: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density on ``points`` equally spaced values over
    [min - range/2, max + range/2]; bandwidth std(ddof=1) * n^(-1/5).

    Equal values are counted first; every distinct value adds its kernel, times its
    count, to every grid point, none is cut off.  A task adds up the kernels of its
    values in one array and sends ``points`` sums."""
    s = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"),
               F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    n, sd, lo, hi = s["n"], s["sd"], s["lo"], s["hi"]
    if not n or sd is None or sd == 0:
        raise ValueError("kde needs at least two distinct values")
    sd, lo, hi = float(sd), float(lo), float(hi)
    h = sd * n ** (-0.2)
    g0 = lo - 0.5 * (hi - lo)
    step = ((hi + 0.5 * (hi - lo)) - g0) / (points - 1)

    def add(batches):
        import numpy as np
        import pyarrow as pa

        grid, sums = g0 + np.arange(points) * step, np.zeros(points)
        for b in batches:
            x, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for at in range(0, len(x), 1024):
                z = (grid[None, :] - x[at:at + 1024, None]) / h
                sums += n[at:at + 1024].astype(np.float64) @ np.exp(-0.5 * z * z)
        yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(points), pa.int32()), "s": pa.array(sums)})

    x = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    x = spread(x, float(n) * points, n)
    sums = x.mapInArrow(add, "j int, s double").groupBy("j").agg(F.sum("s").alias("_s"))
    norm = n * h * math.sqrt(2 * math.pi)
    return sums.select("j", (F.lit(g0) + F.col("j") * F.lit(step)).alias("x"), (F.col("_s") / F.lit(norm)).alias("density"))

"""Ordered prefix sums and last-known values without a window over a whole key or table.

Rows are range-partitioned by the order column and stored once with the
number of their range; sums run inside each range, the totals of the ranges
(one row each) give the offsets, and one join adds them.  The number of ranges
follows the data: Spark samples the column, and merges small ranges.  Used
by ROC points and AUC, and (last-known values) by forward fill and gap days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.session import materialize

UNB = Window.unboundedPreceding


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], ascending: bool = True,
                inclusive: bool = True, n_buckets: int | None = None, prefix: str = "cum_",
                keep_bucket: str | None = None) -> DataFrame:
    """Add ``prefix + c``: the sum of ``c`` over all rows before (and with
    ``inclusive``, at) this row in ``order_col`` order.  ``order_col`` must be
    unique (aggregate to distinct values first).  ``n_buckets`` fixes the number
    of ranges; ``keep_bucket`` names a column for the range, which rises in the
    order asked for."""
    ranged = df.repartitionByRange(order_col) if n_buckets is None else df.repartitionByRange(n_buckets, order_col)
    d = materialize(ranged.withColumn("_range", F.spark_partition_id()))
    d = d.withColumn("_range", F.col("_range") if ascending else -F.col("_range"))
    order = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    frame = (UNB, 0) if inclusive else (UNB, -1)
    w_in = Window.partitionBy("_range").orderBy(order).rowsBetween(*frame)
    totals = d.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sum_cols])
    w_before = Window.orderBy("_range").rowsBetween(UNB, -1)  # one row per range
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(w_before), F.lit(0)).alias(f"_off_{c}")
                                        for c in sum_cols])
    d = d.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(w_in), F.lit(0)) for c in sum_cols})
    d = d.join(F.broadcast(offsets), "_range")
    d = d.withColumns({prefix + c: F.col(f"_in_{c}") + F.col(f"_off_{c}") for c in sum_cols})
    if keep_bucket:
        d = d.withColumn(keep_bucket, F.col("_range"))
    return d.drop("_range", *[f"_in_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols])


def last_known(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], values: dict[str, Column],
               ascending: bool = True, inclusive: bool = True) -> DataFrame:
    """Add for each of ``values`` (name -> expression) its last non-missing value up to this row
    (without ``inclusive``: before it) among the rows of the key, in ``order_cols`` order.

    The rows are range-partitioned by (keys, order) and stored once, so a key with very many rows
    lies in several ranges; windows run over the rows of a key inside one range.  Only the first
    and the last key of a range can share it with others: their last values, two rows for each
    range, are scanned in range order and handed on to the ranges that follow.  Missing keys are
    keys as any other."""
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    by = [*keys, *order_cols]
    d = df.withColumns({f"_val_{n}": e for n, e in values.items()})
    d = materialize(d.repartitionByRange(*[F.col(c) for c in by]).withColumn("_range", F.spark_partition_id()))
    if not ascending:
        d = d.withColumn("_range", -F.col("_range"))
    arrow = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    order = [arrow(c) for c in order_cols]
    w = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(UNB, 0 if inclusive else -1)
    local = d.withColumns({f"_loc_{n}": F.last(f"_val_{n}", True).over(w) for n in values}).withColumn("_key", key)
    # rows of the keys at the two ends of each range, with their last value
    ends = d.groupBy("_range").agg(F.min(key).alias("_a"), F.max(key).alias("_z"))  # one row per range
    edge = d.withColumn("_key", key).join(F.broadcast(ends), "_range").where(F.col("_key").eqNullSafe(F.col("_a")) | F.col("_key").eqNullSafe(F.col("_z")))
    at = F.struct(*[F.col(c) for c in order_cols])
    pick = F.max_by if ascending else F.min_by
    edge = edge.groupBy("_range", "_key").agg(*[pick(f"_val_{n}", F.when(F.col(f"_val_{n}").isNotNull(), at)).alias(f"_val_{n}") for n in values])
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(UNB, -1)  # at most one row per range
    carry = edge.select(F.col("_range").alias("_r"), F.col("_key").alias("_k"), *[F.last(f"_val_{n}", True).over(before).alias(f"_car_{n}") for n in values])
    out = local.join(F.broadcast(carry), (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    new = [F.coalesce(f"_loc_{n}", f"_car_{n}").alias(n) for n in values]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *new)

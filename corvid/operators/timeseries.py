"""Irregular series made daily, forward fill, as-of join, gap days
(A1, W1, W2, W3, J3).

Hot keys: the as-of join, the gap days and the daily fill depend on (key, day)
only, so the rows are first reduced to distinct (key, day) -- partial
aggregation absorbs a key with very many rows -- the windows run over a key's
days, and the result is joined back to the rows, where Spark can split a
skewed key.  ``ffill``, which works on any order, can take an optional
``segment`` column expression (e.g. the month of the day) that is constant on
contiguous runs of the order: rows are then windowed per (key, segment), and a
small per-(key, segment) summary carries the last value across segment
borders.  Results are identical with and without segments, NULL keys
included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.scan import last_known
from corvid.session import materialize

UNB = Window.unboundedPreceding


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition on column pairs, missing values equal."""
    cond = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        cond = one if cond is None else cond & one
    return cond


def _ordered(cols: Sequence[str], ascending: bool) -> list[Column]:
    return [F.col(c).asc() if ascending else F.col(c).desc() for c in cols]


def daily_first(df: DataFrame, keys: Sequence[str], day: str, order_col: str,
                value_cols: Sequence[str]) -> DataFrame:
    """A1: per (keys, day), the first non-missing value of every column in
    ``order_col`` order (each column on its own)."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in value_cols]
    return df.groupBy(*keys, day).agg(*aggs)


def daily_grid(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """One row per key and calendar day from the key's first to its last
    observation, with the observed columns left-joined (gaps are NULL)."""
    span = df.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    grid = span.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("_g_day"))
    out = grid.join(df, _null_safe(grid, df, [(f"_g_{k}", k) for k in keys] + [("_g_day", day)]), "left")
    rest = [c for c in df.columns if c not in (*keys, day)]
    return out.select(*[F.col(f"_g_{k}").alias(k) for k in keys], F.col("_g_day").alias(day), *rest)


def daily_filled(df: DataFrame, keys: Sequence[str], day: str, value_cols: Sequence[str]) -> DataFrame:
    """W1 + W2 in one pass: one row per key and calendar day from the key's first to
    its last observation, with the last known value of every column (each column on
    its own).  ``df`` holds one row per (keys, day).  Only the observed days are
    windowed; each then stands for the days up to the next one, so there is no grid
    to join or store."""
    w = Window.partitionBy(*keys).orderBy(day)
    so_far = w.rowsBetween(UNB, 0)
    obs = df.where(F.col(day).isNotNull()).select(
        *keys, day, F.lead(day).over(w).alias("_next"), *[F.last(c, True).over(so_far).alias(c) for c in value_cols])
    last = F.coalesce(F.date_sub("_next", 1), F.col(day))
    return obs.select(*keys, F.explode(F.sequence(F.col(day), last, F.expr("INTERVAL 1 DAY"))).alias(day), *value_cols)


def latest_filled(df: DataFrame, keys: Sequence[str], day: str, value_cols: Sequence[str]) -> DataFrame:
    """The last row of each key in ``daily_filled``: its last observed day and the last
    known value of every column, from one aggregate of the observed days."""
    return df.where(F.col(day).isNotNull()).groupBy(*keys).agg(
        F.max(day).alias(day), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(day))).alias(c) for c in value_cols])


def segment_carry(df: DataFrame, keys: Sequence[str], seg: str, order_cols: Sequence[str],
                  value_cols: Sequence[str], ascending: bool = True) -> DataFrame:
    """Per (keys, seg): the last non-missing value of each column over the
    earlier segments of the same keys (``ascending=False``: the later ones).
    Works on a summary with one row per (keys, seg)."""
    ords = F.struct(*order_cols)
    pick = F.max_by if ascending else F.min_by
    summ = df.groupBy(*keys, seg).agg(
        *[pick(c, F.when(F.col(c).isNotNull(), ords)).alias(c) for c in value_cols])
    w = Window.partitionBy(*keys).orderBy(F.col(seg).asc() if ascending else F.col(seg).desc())
    w = w.rowsBetween(UNB, -1)
    return summ.select(*keys, seg, *[F.last(c, True).over(w).alias(f"_carry_{c}") for c in value_cols])


def ffill(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value_cols: Sequence[str],
          segment: Column | None = None, ascending: bool = True,
          out_cols: dict[str, str] | None = None) -> DataFrame:
    """Forward fill, each column on its own, within each key, in
    ``order_cols`` order (``ascending=False`` fills backwards).  ``out_cols``
    writes the filled value of ``c`` to ``out_cols[c]`` instead of ``c``.

    Without a ``segment`` the rows are scanned in ranges of (key, order), so one key may
    hold all rows (``scan.last_known``)."""
    out_cols = out_cols or {}
    target = {c: out_cols.get(c, c) for c in value_cols}
    if segment is None:
        out = last_known(df, keys, order_cols, {target[c]: F.col(c) for c in value_cols}, ascending)
        return out.select(*df.columns, *[t for t in target.values() if t not in df.columns])  # input column order kept
    d = df.withColumn("_seg", segment)
    w = Window.partitionBy(*keys, "_seg").orderBy(*_ordered(order_cols, ascending)).rowsBetween(UNB, 0)
    local = d.withColumns({f"_loc_{c}": F.last(c, True).over(w) for c in value_cols})
    carry = segment_carry(d, keys, "_seg", order_cols, value_cols, ascending)
    carry = carry.select(*[F.col(c).alias(f"_c_{c}") for c in (*keys, "_seg")], *[f"_carry_{c}" for c in value_cols])
    out = local.join(carry, _null_safe(local, carry, [(c, f"_c_{c}") for c in (*keys, "_seg")]), "left")
    out = out.withColumns({target[c]: F.coalesce(f"_loc_{c}", f"_carry_{c}") for c in value_cols})
    new = [t for t in target.values() if t not in df.columns]
    return out.select(*df.columns, *new)  # input column order kept


def ffill_across_keys(df: DataFrame, key: str, order_cols: Sequence[str], value_cols: Sequence[str],
                      segment: Column | None = None, key_buckets: int | None = None,
                      observed: DataFrame | None = None) -> DataFrame:
    """W2 parity option: a fill over the whole table in (key, order) order, so a
    key's leading gap takes the previous key's last value.

    Done as a per-key fill plus one carry value per key.  The carry runs over
    the per-key summary in two levels: keys are cut into order-preserving
    buckets (range partitions of the summary, any orderable key type; their
    number follows the data unless ``key_buckets`` fixes it), a window inside
    each bucket, then a carry across the bucket summaries -- so no step puts all
    rows, or all keys, in one partition.  ``observed``: the table that ``df`` was
    filled from; ``df`` is then filled per key already."""
    per_key = ffill(df, [key], order_cols, value_cols, segment) if observed is None else df
    source = df if observed is None else observed
    ords = F.struct(*order_cols)
    last_of_key = source.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), ords)).alias(c) for c in value_cols])
    # range partition i holds smaller keys than partition i + 1; stored once so
    # both readers below see the same buckets
    ranged = last_of_key.repartitionByRange(key) if key_buckets is None else last_of_key.repartitionByRange(key_buckets, key)
    last_of_key = materialize(ranged.withColumn("_kb", F.spark_partition_id()))
    w_in = Window.partitionBy("_kb").orderBy(key).rowsBetween(UNB, -1)
    inner = last_of_key.select(key, "_kb", *[F.last(c, True).over(w_in).alias(f"_in_{c}") for c in value_cols])
    across = segment_carry(last_of_key, [], "_kb", [key], value_cols)
    carry = inner.join(across, "_kb", "left").select(
        F.col(key).alias("_key"), *[F.coalesce(f"_in_{c}", f"_carry_{c}").alias(f"_kc_{c}") for c in value_cols])
    out = per_key.join(carry, per_key[key].eqNullSafe(carry["_key"]), "left")
    out = out.withColumns({c: F.coalesce(c, f"_kc_{c}") for c in value_cols})
    return out.select(*df.columns)


def asof_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_day: str,
              right_day: str, value_cols: Sequence[str], bounded: bool = True, how: str = "inner") -> DataFrame:
    """For each left row, the last known right value of every column (each
    column on its own) on or before the left day, same day inclusive.

    ``bounded``: only left rows between the key's first and last right day get
    values (the net effect of a daily grid + forward fill + equi-join); with
    ``how='inner'`` the others are dropped, with ``how='left'`` they are kept
    with NULLs.  The right side should hold one row per (key, day) --
    ``daily_first`` makes it so.  No row is multiplied."""
    return asof_join_many(left, left_key, left_day, [(right, right_key, right_day, value_cols)],
                          bounded=bounded, how=how)


def asof_join_many(left: DataFrame, left_key: str, left_day: str,
                   rights: Sequence[tuple[DataFrame, str, str, Sequence[str]]], bounded: bool = True,
                   how: str = "inner") -> DataFrame:
    """J3 against several right tables on the same key at once.

    ``rights`` holds ``(table, key, day, value_cols)``; value column names must
    be new and distinct.  With ``how='inner'`` a left row must lie inside the
    day range of every right table.

    Plan: the left rows are reduced to their distinct (key, day), united with
    the right rows and windowed per key -- forwards for the last value on or
    before the day, backwards for the next right day (the upper bound) -- so a
    task windows at most the days of a key, not its rows.  The result is joined
    back to the left rows on (key, day)."""
    l_cols = left.columns
    n = len(rights)
    all_vals = [c for _, _, _, vc in rights for c in vc]
    clash = set(l_cols) & set(all_vals)
    if clash or len(set(all_vals)) != len(all_vals):
        raise ValueError(f"value columns must be new and distinct: {sorted(clash) or all_vals}")
    u = left.select(F.col(left_key).alias("_k"), F.col(left_day).alias("_d")).distinct().withColumn("_side", F.lit(n))
    fwd, raw = [], []
    for i, (r, rk, rd, vc) in enumerate(rights):
        part = r.select(F.col(rk).alias("_k"), F.col(rd).alias("_d"), F.lit(i).alias("_side"),
                        *vc, F.col(rd).alias(f"_rday{i}"), F.col(rd).alias(f"_rraw{i}"))
        u = u.unionByName(part, allowMissingColumns=True)
        fwd += [*vc, f"_rday{i}"]
        raw.append(f"_rraw{i}")
    # same day: right rows sort before left rows in both directions
    u = u.withColumn("_bside", F.lit(n) - F.col("_side"))
    wf = Window.partitionBy("_k").orderBy("_d", "_side").rowsBetween(UNB, 0)
    wb = Window.partitionBy("_k").orderBy(F.col("_d").desc(), F.col("_bside").desc()).rowsBetween(UNB, 0)
    x = u.withColumns({c: F.last(c, True).over(wf) for c in fwd})
    if bounded:
        x = x.withColumns({f"_next{i}": F.last(c, True).over(wb) for i, c in enumerate(raw)})
    inside = [F.col(f"_rday{i}").isNotNull() for i in range(n)]
    if bounded:
        inside = [c & F.col(f"_next{i}").isNotNull() for i, c in enumerate(inside)]
    days = x.filter(F.col("_side") == n)
    if how == "inner":
        for c in inside:
            days = days.filter(c)
    else:
        for i, (_, _, _, vc) in enumerate(rights):
            days = days.withColumns({c: F.when(inside[i], F.col(c)) for c in vc})
    days = days.select("_k", "_d", *all_vals)
    cond = _null_safe(left, days, [(left_key, "_k"), (left_day, "_d")])
    return left.join(days, cond, "inner" if how == "inner" else "left").select(*[left[c] for c in l_cols], *all_vals)


def gap_days(df: DataFrame, keys: Sequence[str], date_col: str, order_cols: Sequence[str],
             lo: int = 0, hi: int = 30, fill: int = 30, out_col: str = "rest_days") -> DataFrame:
    """Days since the key's previous row (in ``order_cols`` order), clipped
    to [lo, hi]; the first row of a key (or a missing date) gets ``fill``.

    With ``order_cols`` beginning with ``date_col`` only the first row of a (key,
    day) lies behind an earlier day, and the others follow a row of the same
    day: the days of a key are windowed, not its rows, and joined back (rows
    equal in all ``order_cols`` count as the same row).  In any other order the
    rows are scanned in ranges of (key, order)."""
    from corvid.functions import clip

    if order_cols[0] != date_col:
        d = last_known(df, keys, order_cols, {"_prev": F.struct(date_col)}, inclusive=False)
        gap = clip(F.datediff(F.col(date_col), F.col("_prev")[date_col]), lo, hi)
        return d.withColumn(out_col, F.coalesce(gap, F.lit(fill)).cast("int")).select(*df.columns, out_col)
    order = F.struct(*[F.col(c) for c in order_cols])
    days = df.where(F.col(date_col).isNotNull()).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(date_col).alias("_day")).agg(
        F.min(order).alias("_first"))
    w = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_day")
    days = days.withColumn("_prev", F.lag("_day").over(w))
    out = df.join(days, _null_safe(df, days, [(k, f"_k_{k}") for k in keys] + [(date_col, "_day")]), "left")
    first = order.eqNullSafe(F.col("_first"))
    gap = F.when(first, F.datediff(F.col(date_col), F.col("_prev"))).otherwise(F.when(F.col("_day").isNotNull(), F.lit(0)))
    return out.withColumn(out_col, F.coalesce(clip(gap, lo, hi), F.lit(fill)).cast("int")).select(*df.columns, out_col)

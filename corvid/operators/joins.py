"""Equi-joins with different key names and suffixes (J1, J2), key lookups
(J5), pairs inside bounded groups (J6) and neighbour-slot pairing (J10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
          how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"),
          null_safe: bool = True) -> DataFrame:
    """Join on differently named keys; both key columns are kept, and
    other columns present on both sides get the suffixes.  A key with the same
    name on both sides is one column, which also holds the keys that only the
    right side has (``right`` and ``outer`` joins).  Missing keys match each
    other, as in pandas; ``null_safe=False`` gives the SQL rule."""
    lcols, rcols = list(left.columns), list(right.columns)
    shared = set(lcols) & set(rcols)
    same_keys = [a for a, b in zip(left_on, right_on) if a == b]
    inner_only = how.lower().replace("_", "").startswith(("leftsemi", "semi", "leftanti", "anti"))

    def lname(c):
        return c + suffixes[0] if c in shared and c not in same_keys and not inner_only else c

    def rname(c):
        return f"_right_{c}" if c in same_keys else c + suffixes[1] if c in shared else c

    lt = left.select(*[F.col(f"`{c}`").alias(lname(c)) for c in lcols])
    rt = right.select(*[F.col(f"`{c}`").alias(rname(c)) for c in rcols])
    cond = None
    for a, b in zip(left_on, right_on):
        lc, rc = lt[lname(a)], rt[rname(b)]
        one = lc.eqNullSafe(rc) if null_safe else lc == rc
        cond = one if cond is None else cond & one
    out = lt.join(rt, cond, how)
    if inner_only:
        return out
    names = [lname(c) for c in lcols] + [rname(c) for c in rcols if c not in same_keys]
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.col(f"`_right_{c}`")).alias(c) if c in same_keys else F.col(f"`{c}`")
                        for c in names])


def lookup(df: DataFrame, key_col: str, table: DataFrame, table_key: str,
           fields: Sequence[str], suffix: str = "", unknown: str = "null") -> DataFrame:
    """Attach fields of the row with the same key.  A key that ``table``
    does not hold gives NULLs, or with ``unknown="error"`` stops the query; a key
    that it holds more than once always does (no row is multiplied)."""
    if unknown not in ("null", "error"):
        raise ValueError("unknown must be 'null' or 'error'")
    t = table.groupBy(F.col(table_key).alias("_lk")).agg(
        F.count(F.lit(1)).alias("_lk_rows"), *[F.first(f).alias(f"_lk_{f}") for f in fields])
    out = df.join(t, df[key_col] == t["_lk"], "left")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("(missing)"))
    stop = [(F.col("_lk_rows") > 1, "lookup: the table holds this key twice: ")]
    if unknown == "error":
        stop.append((F.col("_lk_rows").isNull(), "lookup: unknown key: "))

    def checked(c):
        for cond, text in stop:
            c = F.when(cond, F.raise_error(F.concat(F.lit(text), key)).cast(t.schema[c_name].dataType)).otherwise(c)
        return c

    cols = []
    for f in fields:
        c_name = f"_lk_{f}"
        cols.append(checked(F.col(c_name)).alias(f + suffix))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *cols)


def pairs_in_groups(df: DataFrame, group_cols: Sequence[str], order_col: str,
                    keep: Sequence[str], max_group_size: int,
                    suffixes: tuple[str, str] = ("_home", "_away")) -> DataFrame:
    """Unordered pairs inside each group, the earlier row first.  A group
    of ``size`` rows makes size*(size-1)/2 pairs, so the caller states how large
    a group may be; a larger one stops the query instead of making its pairs."""
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_size"))
    too_large = F.raise_error(F.format_string(f"pairs_in_groups: a group has %s rows (> {max_group_size})", "_size")).cast("boolean")
    ok = sizes.where(F.when(F.col("_size") > max_group_size, too_large).otherwise(F.lit(True)))
    a = df.join(ok.select(*group_cols), list(group_cols), "left_semi").select(
        *group_cols, *[F.col(c).alias(c + suffixes[0]) for c in [order_col, *keep]])
    b = df.select(*group_cols, *[F.col(c).alias(c + suffixes[1]) for c in [order_col, *keep]])
    return a.join(b, list(group_cols)).filter(F.col(order_col + suffixes[0]) < F.col(order_col + suffixes[1]))


def pair_neighbour_slots(df: DataFrame, group_cols: Sequence[str], slot_col: str,
                         fields: Sequence[str], suffixes: tuple[str, str] = ("_home", "_away")) -> DataFrame:
    """Slots 2i and 2i+1 become one row for pair i (no join)."""
    pair = F.floor(F.col(slot_col) / 2).cast("long").alias("pair")
    home = F.col(slot_col) % 2 == 0
    aggs = []
    for f in fields:
        aggs.append(F.max(F.when(home, F.col(f))).alias(f + suffixes[0]))
        aggs.append(F.max(F.when(~home, F.col(f))).alias(f + suffixes[1]))
    return df.groupBy(*group_cols, pair).agg(*aggs)

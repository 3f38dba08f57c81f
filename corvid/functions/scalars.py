"""Scalar column functions (F1-F12, P10, P14).  All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def false_if_null(cond: Column) -> Column:
    """P10: a comparison with a missing operand counts as false (``NaN > 0``)."""
    return F.coalesce(cond, F.lit(False))


def not_equal_null_safe(col, value) -> Column:
    """P10: ``missing != 'x'`` is true, as with NaN in pandas."""
    return ~_c(col).eqNullSafe(F.lit(value))


def clip(col, lo=None, hi=None) -> Column:
    """bound to [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    c = _c(col)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def days_between(later, earlier) -> Column:
    """whole days of a date difference."""
    return F.datediff(_c(later), _c(earlier))


def to_day(col, tolerant: bool = False) -> Column:
    """Text or timestamp to a date; bad text raises (ANSI) unless
    ``tolerant``, which gives NULL."""
    return F.try_to_date(_c(col)) if tolerant else F.to_date(_c(col))


def decimal_odds(p) -> Column:
    """F8: 1/p, NULL instead of an error when p = 0."""
    return F.try_divide(F.lit(1.0), _c(p))


def keep_if(flag, value, otherwise: str = "") -> Column:
    """The value where the flag holds, else a filler."""
    return F.when(false_if_null(_c(flag)), _c(value)).otherwise(F.lit(otherwise))


def half(col) -> Column:
    """integer halving (slot pairing)."""
    return F.floor(_c(col) / 2).cast("long")


def tiered_points(p, lo: float = 0.0, hi: float = 0.76) -> tuple[Column, Column]:
    """(home points, away points) from the home win probability.

    p <= lo: away gets 3; lo < p < hi: one point each; p >= hi: home gets 3.
    Defaults are the reference's cuts (0.38 - 0.38 and 0.38 + 0.38)."""
    pc = _c(p)
    home = F.when(pc <= lo, 0).when(pc >= hi, 3).when(pc > lo, 1).otherwise(0)
    away = F.when(pc <= lo, 3).when(pc >= hi, 0).when(pc > lo, 1).otherwise(0)
    return home.cast("int"), away.cast("int")


def matchup_label(home_name, p, away_name) -> Column:
    """``'home(1/p) vs. away(1/(1-p))'`` with two decimals."""
    pc = _c(p)
    return F.format_string("%s(%.2f) vs. %s(%.2f)", _c(home_name), decimal_odds(pc),
                           _c(away_name), decimal_odds(F.lit(1.0) - pc))

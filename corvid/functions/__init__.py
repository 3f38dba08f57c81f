from corvid.functions.scalars import (
    clip, days_between, decimal_odds, false_if_null, half, keep_if, matchup_label,
    not_equal_null_safe, tiered_points, to_day,
)

__all__ = [
    "clip", "days_between", "decimal_odds", "false_if_null", "half", "keep_if",
    "matchup_label", "not_equal_null_safe", "tiered_points", "to_day",
]

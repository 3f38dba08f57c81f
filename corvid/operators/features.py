"""The match feature table of the reference's Flow A, composed from the
operators: daily-first ratings (A1), as-of lookups for both sides (J3, J2
suffixes), differences and means (P11), null-safe flags (P10), rest days
(W3), kept-or-Other participant names (P14, P4) and one-hot columns (P15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions import false_if_null, keep_if, not_equal_null_safe
from corvid.operators import clean, encode, timeseries as ts


def match_features(matches: DataFrame, ratings: DataFrame, *, match_id: str = "match_id",
                   date_col: str = "date", home_col: str = "home_team", away_col: str = "away_team",
                   home_score: str = "home_score", away_score: str = "away_score",
                   tournament_col: str = "tournament", rating_key: str = "country_full",
                   rating_day: str = "rank_date", rating_order: str = "rating_row",
                   rating_cols: Sequence[str] = ("rank", "weighted_points"),
                   participants: DataFrame | None = None, participant_col: str = "team",
                   no_stake: str = "Friendly", other: str = "Other", flag_col: str = "wc_participant",
                   categories: Sequence[str] | None = None, max_rest: int = 30, one_hot_prefix: str = "") -> DataFrame:
    """One row per match that has both teams' ratings in range, with
    ``rank_difference, average_rank, point_difference, score_difference,
    is_won, is_stake, rest_days`` and, given ``participants``, a
    ``flag_col`` column (the team, or ``other``) plus one 0/1 column per value
    (of ``categories``, or of the data).  A match of the kind ``no_stake`` has
    nothing at stake."""
    rank, points = rating_cols[0], rating_cols[1]
    daily = ts.daily_first(ratings, [rating_key], rating_day, rating_order, list(rating_cols))
    m = matches
    for side, key in (("_home", home_col), ("_away", away_col)):
        right = daily.select(F.col(rating_key).alias("_rk"), F.col(rating_day).alias("_rd"),
                             *[F.col(c).alias(c + side) for c in rating_cols])
        m = ts.asof_join(m, right, key, "_rk", date_col, "_rd", [c + side for c in rating_cols])
    m = m.withColumns({
        "rank_difference": F.col(rank + "_home") - F.col(rank + "_away"),
        "average_rank": (F.col(rank + "_home") + F.col(rank + "_away")) / 2,
        "point_difference": F.col(points + "_home") - F.col(points + "_away"),
        "score_difference": F.col(home_score) - F.col(away_score),
    })
    m = m.withColumns({
        "is_won": false_if_null(F.col("score_difference") > 0),  # a draw counts as lost
        "is_stake": not_equal_null_safe(tournament_col, no_stake),
    })
    m = ts.gap_days(m, [home_col], date_col, [date_col, match_id], 0, max_rest, max_rest, "rest_days")
    if participants is not None:
        m = clean.member_flag(m, home_col, participants, participant_col, "_is_participant")
        m = m.withColumn(flag_col, keep_if("_is_participant", home_col, "")).drop("_is_participant")
        m = clean.replace_values(m, {"": other}, subset=[flag_col])
        m = encode.one_hot(m, flag_col, categories, prefix=one_hot_prefix)
    return m

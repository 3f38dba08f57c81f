import datetime as dt

from pyspark.sql import functions as F

from corvid.operators.clean import drop_all_missing, replace_values
from corvid.operators.features import match_features


def d(s):
    return dt.date.fromisoformat(s)


def test_match_feature_table(spark):
    rankings = spark.createDataFrame([
        (1, "A", d("2018-01-01"), 10, 100.0), (2, "A", d("2018-01-05"), None, None),
        (3, "A", d("2018-01-05"), 12, 90.0), (4, "A", d("2018-01-10"), 11, 95.0),
        (5, "B", d("2018-01-01"), 20, 50.0), (6, "B", d("2018-01-08"), 21, 45.0),
        (7, "C", d("2018-01-03"), 30, 10.0),   # one row only
    ], "rating_row int, country_full string, rank_date date, rank int, weighted_points double")
    matches = spark.createDataFrame([
        (1, d("2018-01-05"), "A", "B", 2, 1, "Cup"),        # on a ranking day (A: first non-NULL of the day)
        (2, d("2018-01-07"), "A", "B", 1, 1, "Friendly"),   # between days, draw
        (3, d("2017-12-31"), "A", "B", 3, 0, "Cup"),        # before the first ranking -> dropped
        (4, d("2018-01-09"), "A", "B", None, 2, None),      # after B's last ranking -> dropped
        (5, d("2018-01-08"), "B", "A", None, 1, None),      # NULL score, NULL tournament
        (6, d("2018-01-06"), "A", "X", 1, 0, "Cup"),        # team without ranking -> dropped
        (7, d("2018-01-03"), "C", "A", 0, 2, "Cup"),
    ], "match_id int, date date, home_team string, away_team string, home_score int, away_score int, "
       "tournament string")
    teams = spark.createDataFrame([("A",), ("C",)], "team string")
    out = {r.match_id: r for r in match_features(matches, rankings, participants=teams).collect()}
    assert set(out) == {1, 2, 5, 7}
    r1 = out[1]
    assert (r1.rank_home, r1.rank_away, r1.rank_difference, r1.average_rank) == (12, 20, -8, 16.0)
    assert r1.point_difference == 40.0 and r1.is_won and r1.is_stake
    r2 = out[2]
    assert (r2.rank_home, r2.rank_away) == (12, 20) and r2.is_won is False and r2.is_stake is False
    r5 = out[5]
    assert (r5.rank_home, r5.rank_away) == (21, 12)
    assert r5.is_won is False and r5.is_stake is True   # NaN > 0 is False, NaN != 'Friendly' is True
    assert r5.wc_participant == "Other" and (r5.A, r5.C, r5.Other) == (0, 0, 1)
    assert out[7].wc_participant == "C" and (out[7].A, out[7].C) == (0, 1)
    # rest days per home team, in date order: A plays on 01-05 (first) then 01-07
    assert out[1].rest_days == 30 and out[2].rest_days == 2 and out[7].rest_days == 30


def test_world_cup_cleaning(spark):
    wc = spark.createDataFrame([
        ("IRAN", "B", "Spain"), ("Costarica", "E", "Brazil"), (None, None, None),
        ("Porugal", "B", "IRAN"), ("Columbia", "H", "Japan"), ("Korea", "F", "Mexico"),
    ], "Team string, Group string, first string")
    # The reference's team-name fixes.
    fixes = {"IRAN": "Iran", "Costarica": "Costa Rica", "Porugal": "Portugal",
             "Columbia": "Colombia", "Korea": "Korea Republic"}
    out = replace_values(drop_all_missing(wc), fixes).collect()
    assert len(out) == 5
    names = {r.Team for r in out}
    assert names == {"Iran", "Costa Rica", "Portugal", "Colombia", "Korea Republic"}
    assert [r.first for r in out if r.Team == "Portugal"] == ["Iran"]  # every string column

from pyspark.sql import functions as F

from corvid.functions import (clip, decimal_odds, false_if_null, half, keep_if, matchup_label,
                              not_equal_null_safe, tiered_points)


def test_tiered_points_cuts(spark):
    df = spark.createDataFrame([(0.0,), (0.38,), (0.76,), (0.8,), (1.0,), (None,)], "p double")
    h, a = tiered_points("p")
    rows = df.select("p", h.alias("h"), a.alias("a")).collect()
    got = {r.p: (r.h, r.a) for r in rows}
    assert got[0.0] == (0, 3)      # p <= lo: away wins
    assert got[0.38] == (1, 1)     # draw band
    assert got[0.76] == (3, 0)     # p >= hi: home wins
    assert got[0.8] == (3, 0)
    assert got[1.0] == (3, 0)
    assert got[None] == (0, 0)


def test_odds_and_label(spark):
    df = spark.createDataFrame([("AAA", 0.8, "BBB"), ("CCC", 1.0, "DDD")], "h string, p double, a string")
    out = df.select(decimal_odds("p").alias("o"), decimal_odds(F.lit(1.0) - F.col("p")).alias("o2"),
                    matchup_label("h", "p", "a").alias("label")).collect()
    assert out[0].label == "AAA(1.25) vs. BBB(5.00)"
    assert out[1].o == 1.0 and out[1].o2 is None  # no division error


def test_null_semantics(spark):
    df = spark.createDataFrame([(None, None), (2.0, "Friendly"), (-1.0, "Cup")], "x double, t string")
    r = df.select(false_if_null(F.col("x") > 0).alias("pos"), not_equal_null_safe("t", "Friendly").alias("stake"),
                  clip("x", 0, 1).alias("c"), keep_if(F.col("x") > 0, "t").alias("k")).collect()
    assert [x.pos for x in r] == [False, True, False]
    assert [x.stake for x in r] == [True, False, True]
    assert [x.c for x in r] == [None, 1.0, 0.0]
    assert [x.k for x in r] == ["", "Friendly", ""]


def test_half(spark):
    df = spark.range(6).select(half("id").alias("h"))
    assert [r.h for r in df.collect()] == [0, 0, 1, 1, 2, 2]


def test_dates(spark):
    import datetime as dt

    import pytest
    from pyspark.errors import PySparkException

    from corvid.functions import days_between, to_day
    df = spark.createDataFrame([("2018-06-14", "2018-06-01"), ("bad", "2018-06-01")], "a string, b string")
    rows = df.select(to_day("a", tolerant=True).alias("d"),
                     days_between(to_day("a", tolerant=True), to_day("b")).alias("n")).collect()
    assert rows[0].d == dt.date(2018, 6, 14) and rows[0].n == 13
    assert rows[1].d is None and rows[1].n is None
    with pytest.raises(PySparkException):
        df.select(to_day("a")).collect()  # strict parse: bad text raises

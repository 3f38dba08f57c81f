import pytest
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from corvid.operators import timeseries as ts


def d(s):
    return dt.date.fromisoformat(s)


def _rankings(spark):
    rows = [
        # country A: leading NULL rank, gap of days, two rows on one day (first has a NULL)
        ("A", d("2018-01-01"), 1, None, None), ("A", d("2018-01-04"), 2, 5, 50.0),
        ("A", d("2018-01-04"), 3, 6, None), ("A", d("2018-01-06"), 4, 7, 70.0),
        # country B: first observation NULL (shows the cross-key fill), ends early
        ("B", d("2018-01-01"), 5, None, None), ("B", d("2018-01-03"), 6, 9, 90.0),
        # country C: one row
        ("C", d("2018-01-02"), 7, 11, 110.0),
    ]
    return spark.createDataFrame(rows, "country string, day date, ord int, rank int, points double")


def test_daily_first_per_column(spark):
    out = ts.daily_first(_rankings(spark), ["country"], "day", "ord", ["rank", "points"])
    row = out.filter((F.col("country") == "A") & (F.col("day") == d("2018-01-04"))).first()
    assert row["rank"] == 5 and row["points"] == 50.0


def test_grid_and_fill(spark):
    daily = ts.daily_first(_rankings(spark), ["country"], "day", "ord", ["rank", "points"])
    grid = ts.daily_grid(daily, ["country"], "day")
    assert grid.filter(F.col("country") == "A").count() == 6  # Jan 1..6
    filled = ts.ffill(grid, ["country"], ["day"], ["rank", "points"])
    a = {r.day: (r["rank"], r.points) for r in filled.filter(F.col("country") == "A").collect()}
    assert a[d("2018-01-01")] == (None, None)  # leading gap stays NULL per key
    assert a[d("2018-01-05")] == (5, 50.0)
    # segments must be contiguous runs of the order: 2-day blocks
    seg = ts.ffill(grid, ["country"], ["day"], ["rank", "points"], segment=F.floor(F.dayofmonth("day") / 2))
    assert sorted(seg.collect()) == sorted(filled.collect())


def test_across_keys_matches_table_wide_fill(spark):
    daily = ts.daily_first(_rankings(spark), ["country"], "day", "ord", ["rank", "points"])
    grid = ts.daily_grid(daily, ["country"], "day").withColumn("ck", F.ascii("country").cast("long"))
    got = ts.ffill_across_keys(grid, "ck", ["day"], ["rank", "points"], key_buckets=3).toPandas()
    by_name = ts.ffill_across_keys(grid, "country", ["day"], ["rank", "points"], key_buckets=2).toPandas()
    assert by_name.sort_values(["ck", "day"])["rank"].fillna(-1).tolist() == \
        got.sort_values(["ck", "day"])["rank"].fillna(-1).tolist()  # string keys work too
    pdf = grid.toPandas().sort_values(["ck", "day"])
    pdf[["rank", "points"]] = pdf[["rank", "points"]].ffill()
    got = got.sort_values(["ck", "day"])
    assert got["rank"].fillna(-1).tolist() == pdf["rank"].fillna(-1).tolist()
    # B's leading NULL took A's last value
    b1 = got[(got.country == "B") & (got.day == d("2018-01-01"))].iloc[0]
    assert b1["rank"] == 7


def test_asof_equals_grid_fill_join(spark):
    right = ts.daily_first(_rankings(spark), ["country"], "day", "ord", ["rank", "points"])
    matches = spark.createDataFrame(
        [(1, "A", d("2018-01-04")), (2, "A", d("2018-01-05")), (3, "A", d("2017-12-31")),
         (4, "A", d("2018-01-07")), (5, "Z", d("2018-01-02")), (6, "C", d("2018-01-02")),
         (7, "B", d("2018-01-02"))],
        "mid int, team string, mday date")
    r = right.withColumnsRenamed({"country": "rc", "day": "rd"})
    asof = ts.asof_join(matches, r, "team", "rc", "mday", "rd", ["rank", "points"])
    grid = ts.ffill(ts.daily_grid(right, ["country"], "day"), ["country"], ["day"], ["rank", "points"])
    ref = matches.join(grid, (matches.team == grid.country) & (matches.mday == grid.day)).select(
        "mid", "team", "mday", "rank", "points")
    assert sorted(asof.collect()) == sorted(ref.collect())
    assert {r.mid for r in asof.collect()} == {1, 2, 6, 7}  # before first / after last / unknown dropped


def test_gap_days(spark):
    rows = [("T", d("2018-01-01"), 1), ("T", d("2018-01-01"), 2), ("T", d("2018-01-06"), 3),
            ("T", d("2018-02-05"), 4), ("T", d("2018-03-08"), 5), ("U", d("2018-01-01"), 6)]
    df = spark.createDataFrame(rows, "team string, day date, ord int")
    out = {r.ord: r.rest_days for r in ts.gap_days(df, ["team"], "day", ["day", "ord"]).collect()}
    assert out == {1: 30, 2: 0, 3: 5, 4: 30, 5: 30, 6: 30}
    by_window = {r.ord: r.rest_days for r in ts.gap_days(df.withColumn("d2", F.col("day")), ["team"], "day", ["d2", "ord"]).collect()}
    assert by_window == out
    # current-row order, not date order: a negative gap clips to 0
    back = {r.ord: r.rest_days for r in ts.gap_days(df, ["team"], "day", ["ord"]).collect()}
    assert back[3] == 5
    rev = spark.createDataFrame([("T", d("2018-01-10"), 1), ("T", d("2018-01-01"), 2)], "team string, day date, ord int")
    assert {r.ord: r.rest_days for r in ts.gap_days(rev, ["team"], "day", ["ord"]).collect()} == {1: 30, 2: 0}


def test_rest_day_fill_after_clip(spark):
    df = spark.createDataFrame([("T", None, 1), ("T", d("2018-01-05"), 2)], "team string, day date, ord int")
    out = {r.ord: r.rest_days for r in ts.gap_days(df, ["team"], "day", ["ord"]).collect()}
    assert out == {1: 30, 2: 30}


def test_pandas_reference_for_fill(spark):
    # ffill per key equals pandas groupby ffill
    pdf = pd.DataFrame({"k": [1, 1, 1, 2, 2], "o": [1, 2, 3, 1, 2], "v": [None, 1.0, None, 2.0, None]})
    df = spark.createDataFrame(pdf)
    got = ts.ffill(df, ["k"], ["o"], ["v"]).toPandas().sort_values(["k", "o"])
    exp = pdf.copy()
    exp["v"] = exp.groupby("k")["v"].ffill()
    assert got["v"].fillna(-1).tolist() == exp["v"].fillna(-1).tolist()


def test_asof_many_left_keeps_rows(spark):
    r1 = spark.createDataFrame([("A", d("2018-01-02"), 1.0), ("A", d("2018-01-05"), 2.0)], "k string, day date, a double")
    r2 = spark.createDataFrame([("A", d("2018-01-01"), 10.0), ("A", d("2018-01-03"), 30.0)], "k string, day date, b double")
    left = spark.createDataFrame([(1, "A", d("2018-01-01")), (2, "A", d("2018-01-03")), (3, "A", d("2018-01-04")),
                                  (4, "B", d("2018-01-03"))], "id int, k string, day date")
    rights = [(r1.withColumnsRenamed({"k": "k1", "day": "d1"}), "k1", "d1", ["a"]),
              (r2.withColumnsRenamed({"k": "k2", "day": "d2"}), "k2", "d2", ["b"])]
    got = {r.id: (r.a, r.b) for r in ts.asof_join_many(left, "k", "day", rights, how="left").collect()}
    # a: range 01-02..01-05; b: range 01-01..01-03
    assert got == {1: (None, 10.0), 2: (1.0, 30.0), 3: (1.0, None), 4: (None, None)}
    inner = {r.id for r in ts.asof_join_many(left, "k", "day", rights).collect()}
    assert inner == {2}


def test_daily_filled_equals_grid_and_fill(spark):
    daily = ts.daily_first(_rankings(spark), ["country"], "day", "ord", ["rank", "points"])
    ref = ts.ffill(ts.daily_grid(daily, ["country"], "day"), ["country"], ["day"], ["rank", "points"])
    got = ts.daily_filled(daily, ["country"], "day", ["rank", "points"])
    assert sorted(got.select(*ref.columns).collect(), key=str) == sorted(ref.collect(), key=str)
    last = {r.country: (r.day, r["rank"], r.points) for r in ts.latest_filled(daily, ["country"], "day", ["rank", "points"]).collect()}
    assert last == {"A": (d("2018-01-06"), 7, 70.0), "B": (d("2018-01-03"), 9, 90.0), "C": (d("2018-01-02"), 11, 110.0)}


def test_null_keys_keep_their_values(spark):
    rows = [(None, d("2018-01-01"), 1.0), (None, d("2018-02-03"), None), ("A", d("2018-01-01"), 2.0), ("A", d("2018-02-03"), None)]
    df = spark.createDataFrame(rows, "k string, day date, v double")
    plain = ts.ffill(df, ["k"], ["day"], ["v"])
    seg = ts.ffill(df, ["k"], ["day"], ["v"], segment=F.month("day"))
    assert sorted(plain.collect(), key=str) == sorted(seg.collect(), key=str)
    assert {(r.k, r.v) for r in seg.collect()} == {(None, 1.0), ("A", 2.0)}
    right = df.where("v is not null").withColumnsRenamed({"k": "rk", "day": "rd"})
    asof = ts.asof_join(df.drop("v"), right, "k", "rk", "day", "rd", ["v"], bounded=False)
    assert {(r.k, r.v) for r in asof.collect()} == {(None, 1.0), ("A", 2.0)}
    gaps = ts.gap_days(df, ["k"], "day", ["day", "v"], 0, 60, 60)
    assert sorted(r.rest_days for r in gaps.collect()) == [33, 33, 60, 60]


def test_gap_days_missing_dates_and_equal_days(spark):
    rows = [("T", None, 1), ("T", d("2018-01-05"), 2), ("T", d("2018-01-05"), 3), ("T", d("2018-01-08"), 4)]
    df = spark.createDataFrame(rows, "team string, day date, ord int")
    out = {r.ord: r.rest_days for r in ts.gap_days(df, ["team"], "day", ["day", "ord"]).collect()}
    assert out == {1: 30, 2: 30, 3: 0, 4: 3}


@pytest.fixture
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges are not merged
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


def test_one_key_is_scanned_in_ranges(spark, many_ranges):
    """A key that holds all rows lies in several ranges; fill and lag equal the plain windows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from corvid.operators.scan import last_known
    rows = spark.range(0, 20_000, 1, 4).select(
        F.when(F.col("id") % 500 == 3, None).when(F.col("id") % 9 == 0, F.lit("small")).otherwise(F.lit("all")).alias("k"),
        (F.xxhash64("id") % 1_000_003).alias("o"), "id", F.when(F.col("id") % 997 == 0, F.col("id")).alias("v"))
    for ascending in (True, False):
        order = [(F.col(c).asc() if ascending else F.col(c).desc()) for c in ("o", "id")]
        w = Window.partitionBy("k").orderBy(*order)
        for inclusive in (True, False):
            got = last_known(rows, ["k"], ["o", "id"], {"x": F.col("v"), "p": F.struct("v")}, ascending, inclusive)
            want = rows.select("*", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)).alias("x"),
                               F.last(F.struct("v"), True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)).alias("p"))
            a, b = ([(r.id, r.x, r.p) for r in d.orderBy("id").collect()] for d in (got, want))
            assert a == b
    spread = rows.repartitionByRange("k", "o", "id").groupBy(F.spark_partition_id().alias("part")).agg(F.count_if(F.col("k") == "all").alias("n"))
    assert max(r.n for r in spread.collect()) < 0.6 * 17_700
    assert last_known(rows.limit(0), ["k"], ["o"], {"x": F.col("v")}).count() == 0
    assert last_known(rows, [], ["id"], {"x": F.col("v")}).where("x <> id - id % 997").count() == 0

"""Plan-shape and skew checks behind the scale claims."""

import datetime as dt
import math

from pyspark.sql import functions as F

from corvid.operators import timeseries as ts
from corvid.operators.split import exact_split, split_parts


def _hot_events(spark):
    # key 0 holds a third of the rows, spread over 90 days
    base = dt.date(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else 1 + i % 50
        day = base + dt.timedelta(days=(i * 7) % 90)
        val = None if i % 5 == 0 else float(i)
        rows.append((i, key, day, val))
    return spark.createDataFrame(rows, "id long, k long, day date, v double")


def test_hot_key_segmented_fill_equals_single_window(spark):
    df = _hot_events(spark)
    plain = ts.ffill(df, ["k"], ["day", "id"], ["v"])
    seg = ts.ffill(df, ["k"], ["day", "id"], ["v"], segment=F.date_trunc("week", "day"))
    assert sorted(plain.collect()) == sorted(seg.collect())
    plan = seg._jdf.queryExecution().executedPlan().toString()
    assert "_seg" in plan and "hashpartitioning(k" in plan


def test_hot_key_asof_and_gap_days(spark):
    df = _hot_events(spark)
    right = ts.daily_first(df.filter(F.col("id") % 2 == 0), ["k"], "day", "id", ["v"])
    right = right.withColumnsRenamed({"k": "rk", "day": "rd"})
    left = df.filter(F.col("id") % 2 == 1).select("id", "k", "day")
    got = ts.asof_join(left, right, "k", "rk", "day", "rd", ["v"])
    grid = ts.ffill(ts.daily_grid(right, ["rk"], "rd"), ["rk"], ["rd"], ["v"])
    ref = left.join(grid, (left.k == grid.rk) & (left.day == grid.rd)).select("id", "k", "day", "v")
    assert sorted(got.collect()) == sorted(ref.collect())
    gaps = ts.gap_days(df, ["k"], "day", ["day", "id"])
    ref = df.withColumn("_o", F.col("day")).select("*")
    ref = ts.gap_days(ref, ["k"], "day", ["_o", "id"]).drop("_o")  # the window over all rows
    assert sorted(gaps.collect()) == sorted(ref.collect())
    # the windows stand on distinct (key, day): an aggregate lies between the rows and each window
    for out in (got, gaps):
        plan = out._jdf.queryExecution().executedPlan().toString()
        window = plan[plan.index("Window"):]
        assert "Aggregate" in window


def test_split_is_a_projection(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    out = exact_split(df, "key", 0.25, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert out.filter("is_test").count() == math.ceil(0.25 * 5000)


def test_split_edges(spark):
    df = spark.range(10).withColumnRenamed("id", "key")
    assert exact_split(df, "key", 0.0).filter("is_test").count() == 0
    assert exact_split(df, "key", 1.0).filter("is_test").count() == 10
    parts = split_parts(df, "key", 0.3)
    assert (parts.n_train, parts.n_test) == (7, 3)
    assert parts[1].count() == 3

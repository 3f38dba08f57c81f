import hashlib
import math

from corvid.operators.split import exact_split, split_parts


def _brute(ids, share, seed):
    order = sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return set(order[: math.ceil(share * len(ids))])


def test_exact_split_matches_brute_force(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    for share, seed in [(0.25, 0), (0.2, 42), (0.5, 7)]:
        got = {r.key for r in exact_split(df, "key", share, seed).filter("is_test").collect()}
        assert got == _brute(range(1000), share, seed)


def test_bucket_refinement_does_not_change_rows(spark):
    df = spark.range(20000).withColumnRenamed("id", "key")
    a = {r.key for r in exact_split(df, "key", 0.3, 1).filter("is_test").collect()}
    # ~5 rows per 3-digit bucket > 2: the cut bucket is refined by two more digits
    b = {r.key for r in exact_split(df, "key", 0.3, 1, rows_per_bucket=2).filter("is_test").collect()}
    assert a == b == _brute(range(20000), 0.3, 1)


def test_parts_disjoint_and_complete(spark):
    df = spark.range(101).withColumnRenamed("id", "key")
    train, test = split_parts(df, "key", 0.25, 0)
    tr = {r.key for r in train.collect()}
    te = {r.key for r in test.collect()}
    assert not (tr & te) and len(tr | te) == 101 and len(te) == math.ceil(0.25 * 101)

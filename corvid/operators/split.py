"""L1: exact, seeded, repeatable train/test split.

Rows are ordered by ``md5('<seed>:<key>')``; the first ``ceil(share * n)``
are the test part -- the same rows as ``row_number() OVER (ORDER BY md5(...))``
in any SQL engine.  The order is never materialised: two small jobs find the
hash value at the cut,

1. row counts per 3-hex-digit hash prefix (4096 rows; their sum is n) locate
   the bucket that holds the cut and how many of its rows are still needed --
   a bucket still above ``rows_per_bucket`` rows is refined by two more
   digits (counts of its sub-buckets only);
2. only that bucket is ranked to read the cut hash;

and the split itself is then a plain projection ``md5(...) <= cut``: no
shuffle, no join, nothing to lose when an executor dies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_order(key_col: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))


def test_size(n: int, share: float) -> int:
    # float product on purpose: same count as the reference's ceil(share * n)
    return int(math.ceil(share * n))


def bucket_counts(df: DataFrame, key_col: str, seed: int, prefix: str = "", digits: int = 3) -> list[tuple[str, int]]:
    """Row counts per hash prefix (``prefix`` + ``digits`` more hex digits),
    sorted; at most 16**digits rows reach the driver."""
    h = hash_order(key_col, seed)
    d = df.select(h.alias("h"))
    if prefix:
        d = d.where(F.substring("h", 1, len(prefix)) == prefix)
    b = F.substring("h", 1, len(prefix) + digits).alias("b")
    return sorted((r[0], r[1]) for r in d.groupBy(b).count().collect())


def cut_hash(df: DataFrame, key_col: str, n_test: int, seed: int,
             counts: list[tuple[str, int]] | None = None, rows_per_bucket: int = 100_000) -> str | None:
    """The largest hash among the ``n_test`` smallest (None when n_test = 0).
    The bucket holding the cut is refined (counts of its sub-buckets) until
    it has at most ``rows_per_bucket`` rows, then ranked."""
    if n_test <= 0:
        return None
    counts = bucket_counts(df, key_col, seed) if counts is None else counts
    h = hash_order(key_col, seed)
    need = n_test
    while True:
        seen = 0
        for b, c in counts:
            if seen + c >= need:
                break
            seen += c
        else:
            return (counts[-1][0] if counts else "") + "g"  # n_test >= n: above every hash
        need -= seen
        if c <= rows_per_bucket or len(b) >= 32:
            rows = df.select(h.alias("h")).where(F.substring("h", 1, len(b)) == b)
            return rows.orderBy("h").limit(need).agg(F.max("h")).first()[0]
        counts = bucket_counts(df, key_col, seed, prefix=b, digits=2)


def exact_split(df: DataFrame, key_col: str, test_share: float = 0.25, seed: int = 0,
                flag_col: str = "is_test", rows_per_bucket: int = 100_000) -> DataFrame:
    """Add a boolean ``flag_col``: true for the test part.  ``key_col`` must be unique."""
    counts = bucket_counts(df, key_col, seed)  # their sum is the row count
    n = sum(c for _, c in counts)
    cut = cut_hash(df, key_col, test_size(n, test_share), seed, counts, rows_per_bucket)
    flag = F.lit(False) if cut is None else hash_order(key_col, seed) <= F.lit(cut)
    return df.withColumn(flag_col, flag)


class Parts(tuple):
    """(train, test) with the part sizes known from the split itself."""

    n_train: int
    n_test: int


def split_parts(df: DataFrame, key_col: str, test_share: float = 0.25, seed: int = 0) -> Parts:
    """(train, test) from ``exact_split``; ``.n_train`` / ``.n_test`` hold the sizes."""
    counts = bucket_counts(df, key_col, seed)
    n = sum(c for _, c in counts)
    n_test = test_size(n, test_share)
    cut = cut_hash(df, key_col, n_test, seed, counts)
    test_flag = F.lit(False) if cut is None else hash_order(key_col, seed) <= F.lit(cut)
    parts = Parts((df.filter(~test_flag), df.filter(test_flag)))
    parts.n_test = min(n_test, n)
    parts.n_train = n - parts.n_test
    return parts

"""Projection and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def replace_values(df: DataFrame, mapping: Mapping[str, str], subset: Sequence[str] | None = None) -> DataFrame:
    """Whole-cell replacement by a small dictionary in every string
    column (or ``subset``); exact match, never substrings."""
    cols = subset or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not mapping or not cols:
        return df
    return df.replace(dict(mapping), subset=list(cols))


def replace_by_table(df: DataFrame, col: str, mapping: DataFrame, from_col: str = "old",
                     to_col: str = "new") -> DataFrame:
    """P3 for a large dictionary held as a table: left join on the value and
    keep the replacement where one exists.  The join strategy is left to AQE
    (a broadcast only when the mapping is measured small)."""
    m = mapping.select(F.col(from_col).alias("_old"), F.col(to_col).alias("_new")).dropDuplicates(["_old"])
    out = df.join(m, df[col] == m["_old"], "left")
    return out.withColumn(col, F.coalesce("_new", col)).drop("_old", "_new")


def drop_all_missing(df: DataFrame) -> DataFrame:
    """P5: drop the rows in which every column is missing."""
    return df.na.drop(how="all")


def keep_members(df: DataFrame, col: str, members: DataFrame, member_col: str) -> DataFrame:
    """P9/J7 as a filter: rows whose value occurs in another table (semi-join)."""
    keys = members.select(F.col(member_col).alias("_member"))
    return df.join(keys, df[col] == keys["_member"], "left_semi")


def member_flag(df: DataFrame, col: str, members: DataFrame, member_col: str,
                flag_col: str = "is_member") -> DataFrame:
    """P9 as a flag column: left join on the distinct member keys."""
    keys = members.select(F.col(member_col).alias("_member")).distinct()
    out = df.join(keys, df[col] == keys["_member"], "left")
    return out.withColumn(flag_col, F.col("_member").isNotNull()).drop("_member")


def misclassified(df: DataFrame, prediction_col: str = "prediction", label_col: str = "label") -> DataFrame:
    """Rows whose prediction differs from the label."""
    return df.filter(~F.col(prediction_col).eqNullSafe(F.col(label_col)))


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """O2: the first ``n`` rows in an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)

"""One-hot indicator columns (P15) and degree-2 polynomial terms (L2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.sources.csv import dense_row_number


#: Categories that a wide form may have, one column each; beyond it the long forms are meant.
MOST_COLUMNS = 10_000


def category_list(df: DataFrame, col: str, most: int = MOST_COLUMNS) -> list:
    """Sorted distinct values of a column, for a wide form.  More than ``most`` are an
    error, found before anything more reaches the driver."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"column {col} has more than {most} categories; use category_index and one_hot_cells")
    return sorted(r[0] for r in found)


def category_index(df: DataFrame, col: str) -> DataFrame:
    """P15 as a table: ``(category, index)``, numbered from 0 in sorted order, whatever their number.
    Missing values are no category."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("category")).distinct()
    ranged = values.repartitionByRange("category").sortWithinPartitions("category")
    return dense_row_number(ranged, "index")


def one_hot_cells(df: DataFrame, key: str, col: str, index: DataFrame | None = None) -> DataFrame:
    """P15 in long form: ``(key, category, index, size)`` with one row for every 1 of the indicator
    columns; rows with a missing value have none.  ``size`` is the number of categories, so
    (index, size) is the sparse vector of the row.  The index is joined, not collected."""
    index = category_index(df, col) if index is None else index
    size = index.agg(F.count(F.lit(1)).alias("size"))
    cells = df.select(F.col(key), F.col(col).alias("category")).join(index, "category")
    return cells.select(key, "category", "index", size.scalar().alias("size"))


def one_hot(df: DataFrame, col: str, categories: Sequence | None = None, prefix: str = "", most: int = MOST_COLUMNS) -> DataFrame:
    """One 0/1 column per category, named ``prefix + value``, appended in
    sorted order; a missing value gives all zeros.  Without given ``categories`` more than
    ``most`` are an error (``one_hot_cells`` has no such limit)."""
    cats = sorted(categories) if categories is not None else category_list(df, col, most)
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("int")
                           for v in cats})


def poly2_terms(cols: Sequence[str | Column], names: Sequence[str] | None = None,
                include_bias: bool = True) -> list[tuple[str, Column]]:
    """L2: degree-2 polynomial terms in the conventional order: bias, the
    inputs, then every product ``x_i * x_j`` with i <= j."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    names = list(names) if names is not None else [str(c) for c in cols]
    terms: list[tuple[str, Column]] = [("1", F.lit(1.0))] if include_bias else []
    terms += [(n, c.cast("double")) for n, c in zip(names, cs)]
    for i in range(len(cs)):
        for j in range(i, len(cs)):
            terms.append((f"{names[i]}*{names[j]}", cs[i].cast("double") * cs[j].cast("double")))
    return terms

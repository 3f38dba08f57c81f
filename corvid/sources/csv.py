"""CSV source and sink.

pandas-style reading turns a set of text tokens into missing values; Spark's
reader keeps them as text, so ``normalise_missing`` maps them to NULL.
Header names may hold newlines (S2): read with ``multiLine`` and rename."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from corvid.session import shared_folder

# Tokens read as missing (the common pandas default set).
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                  "nan", "null"]

# From narrow to wide; a column gets the first that fits.
INFERRED_TYPES = ("bigint", "double", "boolean", "date", "timestamp")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Collapse whitespace (including embedded newlines) in column names."""
    mapping = {c: re.sub(r"\s+", " ", c).strip() for c in df.columns}
    changed = {k: v for k, v in mapping.items() if k != v}
    return df.withColumnsRenamed(changed) if changed else df


def normalise_missing(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Turn missing-value tokens in string columns into NULL.  Only whole cells
    count: a token with blanks around it is text."""
    tokens = MISSING_TOKENS if tokens is None else tokens
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            c = F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def infer_types(df: DataFrame, types: Sequence[str] = INFERRED_TYPES) -> DataFrame:
    """Give each text column the first of ``types`` that all its values cast to
    (a column without values stays text).  One aggregate over the table; the
    driver gets one row of flags."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not text:
        return df
    flags = []
    for i, c in enumerate(text):
        col = F.col(f"`{c}`")
        flags.append(F.count(col).alias(f"n{i}"))
        flags += [F.coalesce(F.bool_and(col.isNull() | col.try_cast(t).isNotNull()), F.lit(False)).alias(f"{t}{i}") for t in types]
    row = df.agg(*flags).first()
    chosen = {c: next((t for t in types if row[f"n{i}"] and row[f"{t}{i}"]), "string") for i, c in enumerate(text)}
    return df.select(*[F.col(f"`{c}`").cast(chosen.get(c, df.schema[c].dataType)).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             multiline: bool = False, clean_names: bool = True,
             missing_tokens: list[str] | None = None) -> DataFrame:
    """Header CSV scan.  Values are read as text and missing tokens become NULL;
    then each column is cast to its type in ``schema``, or without one to the
    narrowest type that fits all its values (so ``NA`` in a numeric column is
    NULL and the column is numeric)."""
    reader = (spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    raw = reader.csv(path)  # all strings
    raw = clean_column_names(raw) if clean_names else raw
    if schema is None:
        return infer_types(normalise_missing(raw, missing_tokens))
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if len(raw.columns) != len(schema.fields):
        raise ValueError(f"expected {len(schema.fields)} columns, file has {len(raw.columns)}")
    raw = raw.toDF(*[f.name for f in schema.fields])
    raw = normalise_missing(raw, missing_tokens)
    return raw.select(*[_cast(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])


def _cast(c: Column, dtype) -> Column:
    if isinstance(dtype, StringType):
        return c
    if dtype.simpleString() == "date":
        return F.to_date(c)
    return c.cast(dtype)


def dense_row_number(df: DataFrame, col: str = "row_id") -> DataFrame:
    """A dense 0..n-1 row number in input order, without a global sort or a
    single partition.

    The rows are written once, each with its partition and its place in it, so the
    counts and the numbers come from the same rows whatever made them: a plan that
    is run twice may deal its rows differently (range partitioning samples anew).
    What is read back is joined with one offset per written partition."""
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    part, off = "_part", "_place"
    while part in df.columns or off in df.columns:
        part, off = part + "_", off + "_"
    placed = df.withColumn(off, place).withColumn(part, F.shiftright(F.col(off), 33)).withColumn(off, F.col(off).bitwiseAND((1 << 33) - 1))
    path = shared_folder(spark, "rows")
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part, F.coalesce(before, F.lit(0)).alias("start"))
    numbered = rows.join(F.broadcast(offsets.withColumnRenamed("start", f"{off}0")), part)  # one row per task that wrote
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns if c != col], (F.col(f"{off}0") + F.col(off)).alias(col))


def write_labels(df: DataFrame, path: str, row_id: str = "row_id", label: str = "label",
                 single_file: bool = False) -> None:
    """Prediction sink (S5): header CSV with ``row_id,label``; the path is
    overwritten.  The result is a directory of part files; ``single_file``
    (small results only) coalesces to one part."""
    out = df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"))
    if single_file:
        out = out.coalesce(1).sortWithinPartitions("row_id")
    out.write.mode("overwrite").option("header", True).csv(path)

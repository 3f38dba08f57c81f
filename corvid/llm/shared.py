"""Shared folder, stored tables and small helpers for the tasks."""

from __future__ import annotations

import sys
import uuid
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.session import ensure_checkpoint_dir


#: Rows that go to a Python task at once: texts may be long, and a batch is held as a whole.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run, inside the folder that all machines share."""
    small_batches(spark)
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a Parquet row group of a stored table: a writer holds one in memory, and every core has a writer.
ROW_GROUP = 16 << 20


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there: the
    lineage ends, and a lost executor costs a re-read, not a recomputation."""
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(file system, path) of a folder or file, from inside a task."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class WholeFile:
    """Output file that appears under its name only when it is complete: a task
    that is repeated or runs twice replaces it by the same content."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def worker_memory(name: str, make):
    """An object that a Python worker keeps for further tasks (tokenizer, its cache), until it is
    given a task of another stage (see ``giving_back``)."""
    kept = sys.__dict__.setdefault("_corvid_llm_worker_memory", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def give_back() -> None:
    """Return the memory that this worker has freed to the machine: the allocators would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def giving_back(run, keeps: str | None = None):
    """A task function that gives back its memory in the end: workers live on for tasks of other stages.
    Of what earlier tasks left in the worker's memory only objects whose names begin with ``keeps`` stay."""

    def task(batches):
        kept = sys.__dict__.get("_corvid_llm_worker_memory", {})
        for name in [n for n in kept if keeps is None or not n.startswith(keeps)]:
            del kept[name]
        yield from run(batches)
        give_back()

    return task


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so extra columns of the input
    never clash with the ones an operator adds."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


SKETCH_BITS = 26


def may_hold(keys: DataFrame, key: str):
    """A test (column -> boolean column) that is true for every value of ``keys.key`` and for few
    others, from a bitmap of fixed size (8 MB): rows that fail it need not be shuffled to a
    join with ``keys``.  With very many keys it lets more rows through, never fewer."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SKETCH_BITS))
    words = keys.select(slot(F.col(key)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    import numpy as np

    table = np.zeros(1 << (SKETCH_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return lambda c: test(slot(c))

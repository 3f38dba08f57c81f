"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

An index lives in a shared folder, one sub-folder per generation:

* ``postings``: (doc_id, a, b), one row for each document and distinct long line key.  The
  documents of every insertion have their own folder; a deletion writes what is left anew;
* ``refs``: (shard, a, b, n, top), the exact table: documents that hold the key and the
  largest doc_id among them.  (a, b) are the two halves of a 128-bit hash of the key;
* ``filters``: one cuckoo filter for each shard over the keys of ``refs``.

``insert`` asks the filters first: keys that a filter does not know are new and go
straight into ``refs``, and only the others are joined with the exact table.  ``delete``
takes the documents' postings away, recounts the keys they held, and deletes keys without
a reference left from the filters, so insert followed by delete restores the same state.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import pick, stored

# The white space that is stripped from a line's ends.
SPACE = " \t\n\x0b\x0c\r"

REFS = "shard int, a long, b long, n long, top long"
FILTERS = "shard int, slots binary"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; two buckets for each key (partial-key cuckoo
    hashing).  Keys are 64-bit hashes.  Grows by a rebuild from all keys when it is full."""

    SLOTS, KICKS = 4, 500

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, self.SLOTS)
        self.mask = np.uint64(len(self.slots) - 1)

    @classmethod
    def empty(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.8)))))
        return cls(np.zeros(buckets * cls.SLOTS, np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        made = cls.empty(len(keys))
        while not made.insert(keys):
            made = cls(np.zeros(2 * made.slots.size, np.uint16))
        return made

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = keys & self.mask
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        return (bucket ^ (np.asarray(prints, np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return ((self.slots[a] == prints[:, None]) | (self.slots[b] == prints[:, None])).any(axis=1)

    def _fill(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found none."""
        left = np.arange(len(prints))
        while len(left):
            bucket, one = np.unique(buckets[left], return_index=True)  # one for each bucket at a time
            free = self.slots[bucket] == 0
            room = free.any(axis=1)
            if not room.any():
                break
            self.slots[bucket[room], free[room].argmax(axis=1)] = prints[left[one[room]]]
            left = np.delete(left, one[room])
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """False when a key found no place; the filter is then to be rebuilt larger."""
        prints, a, b = self._places(keys)
        left = self._fill(prints, a)
        left = left[self._fill(prints[left], b[left])]
        rng = np.random.default_rng(len(keys))
        for f, bucket in zip(prints[left].tolist(), b[left].tolist(), strict=True):  # both buckets are full
            for _ in range(self.KICKS):
                k = rng.integers(self.SLOTS)
                f, self.slots[bucket, k] = int(self.slots[bucket, k]), f
                bucket = int(self._other(np.uint64(bucket), f))
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = f
                    break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray):
        prints, a, b = self._places(keys)
        for f, i, j in zip(prints.tolist(), a.tolist(), b.tolist(), strict=True):
            for bucket in (i, j):
                at = np.flatnonzero(self.slots[bucket] == f)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


def _key(line: str, least: int):
    """The line's key as bytes, or None for a key with fewer than ``least`` code points."""
    line = line.strip(SPACE)
    return line.encode().lower() if len(line) >= least else None


def _hash(key: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(key, digest_size=16).digest()


def postings(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, a, b): the distinct keys of each document, made in one pass without a shuffle."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            ids, counts, keys = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                own = {_hash(k) for line in text.split("\n") if (k := _key(line, least)) is not None}
                counts.append(len(own))
                keys += own
            ab = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["doc_id", "a", "b"])

    return docs.mapInArrow(split, "doc_id long, a long, b long")


KEYS_PER_SHARD = 1 << 18


def _shards(keys: int) -> int:
    """A power of two, so that a shard has ``KEYS_PER_SHARD`` keys or fewer, as far as hashes deal evenly."""
    return 1 << max(0, (max(1, keys) - 1) // KEYS_PER_SHARD).bit_length()


class LineIndex:
    """``min_chars``: shorter keys are never counted.  ``n_shards``: shards of the filters; by
    default as many as the keys of a generation need, since a task holds a shard."""

    def __init__(self, spark: SparkSession, folder: str, n_shards: int | None = None, min_chars: int = 40):
        self.spark, self.folder, self.n_shards, self.min_chars = spark, folder, n_shards, min_chars
        self.generation, self.shards = 0, n_shards or 1
        self.posted: list[str] = []  # folders of postings

    def _table(self, name: str) -> DataFrame:
        schema = {"postings": "doc_id long, a long, b long", "refs": REFS, "filters": FILTERS}[name]
        paths = self.posted if name == "postings" else [f"{self.folder}/{self.generation}/{name}"]
        if self.generation == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    @staticmethod
    def _shard(n: int):
        return F.pmod("a", F.lit(n)).cast("int").alias("shard")

    @staticmethod
    def _counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))

    def _probe(self, counted: DataFrame) -> DataFrame:
        """``counted`` with a column ``known``: what the shard's filter says of the key.  A shard's new
        keys are dealt to pieces where they are many; each piece gets the filter."""
        pieces = _shards(-(-counted.count() // self.shards))
        new = counted.select(self._shard(self.shards), F.pmod("b", F.lit(pieces)).cast("int").alias("piece"), "a", "b", "n", "top")
        filters = self._table("filters").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

        def probe(key, new, old):
            new["known"] = CuckooFilter.load(old["slots"].iloc[0]).contains(new["a"].to_numpy() ^ new["b"].to_numpy()) if len(old) else False
            return new.drop(columns=["shard", "piece"])

        by = ["shard", "piece"]
        return new.groupBy(*by).cogroup(filters.groupBy(*by)).applyInPandas(probe, "a long, b long, n long, top long, known boolean")

    def _filters(self, refs: DataFrame) -> DataFrame:
        def build(key, rows):
            import pandas as pd

            return pd.DataFrame({"shard": [key[0]], "slots": [CuckooFilter.of((rows["a"] ^ rows["b"]).to_numpy()).dump()]})

        return refs.select("shard", "a", "b").groupBy("shard").applyInPandas(build, FILTERS)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents (doc_id, text); every row counts as a document of its own."""
        to = f"{self.folder}/{self.generation + 1}"
        docs = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        new = stored(postings(docs, self.min_chars), f"{to}/postings")
        counted = stored(self._counted(new), f"{to}/counted")
        if self.generation:
            probed = stored(self._probe(counted), f"{to}/probed")
            known = probed.where("known").select("a", "b", F.col("n").alias("n2"), F.col("top").alias("top2"))
            merged = self._table("refs").join(known, ["a", "b"], "full").select(
                "a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("top", "top2").alias("top"))
            # keys that the filter does not know are in no earlier generation
            counted = stored(merged.unionByName(probed.where("not known").drop("known")), f"{to}/merged")
        self.shards = self.n_shards or _shards(counted.count())
        refs = stored(counted.select(self._shard(self.shards), "a", "b", "n", "top"), f"{to}/refs")
        stored(self._filters(refs), f"{to}/filters")
        self.generation += 1
        self.posted.append(f"{to}/postings")
        return self

    def insert_in_parts(self, docs: DataFrame, parts: int) -> LineIndex:
        """Add all documents in ``parts`` generations, dealt by the hash of their ids: what a
        generation has in common with those before it goes through the filters."""
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
        for k in range(parts):
            self.insert(docs.where(part == k))
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents away again (column doc_id; unknown ids are ignored)."""
        to = f"{self.folder}/{self.generation + 1}"
        gone = pick(doc_ids, doc_id="doc_id").distinct()
        old, refs = self._table("postings"), self._table("refs")
        same = old["doc_id"].eqNullSafe(gone["doc_id"])
        left = stored(old.join(gone, same, "left_anti"), f"{to}/postings")
        touched = stored(old.join(gone, same, "left_semi").select("a", "b").distinct(), f"{to}/touched")
        again = self._counted(left.join(touched, ["a", "b"], "left_semi")).select(self._shard(self.shards), "a", "b", "n", "top")
        kept = stored(refs.join(touched, ["a", "b"], "left_anti").select("shard", "a", "b", "n", "top").unionByName(again), f"{to}/refs")
        empty = touched.join(kept, ["a", "b"], "left_anti").withColumn("shard", self._shard(self.shards))

        def drop(key, keys, old):
            import pandas as pd

            if not len(old):
                return pd.DataFrame({"shard": [], "slots": []})
            filt = CuckooFilter.load(old["slots"][0])
            filt.delete((keys["a"] ^ keys["b"]).to_numpy(np.int64))
            return pd.DataFrame({"shard": [key[0]], "slots": [filt.dump()]})

        stored(empty.groupBy("shard").cogroup(self._table("filters").groupBy("shard")).applyInPandas(drop, FILTERS), f"{to}/filters")
        self.generation += 1
        self.posted = [f"{to}/postings"]
        return self

    def clean(self, docs: DataFrame, min_docs: int) -> DataFrame:
        """Drop the lines whose key ``min_docs`` documents or more hold, but for those in the
        largest doc_id that holds it: (doc_id, n_lines, n_dropped, text).

        A null or empty text is one empty line.  A null doc_id is smaller than any other.
        Rows with the same doc_id lose the same keys.  Other columns are ignored.
        """
        common = self._table("refs").where(F.col("n") >= min_docs).select("a", "b", "top")
        drop = self._table("postings").join(common, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
        keys = drop.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("keys")).withColumnRenamed("doc_id", "id")
        docs = pick(docs, doc_id="doc_id", text="text")
        docs = docs.join(keys, docs["doc_id"].eqNullSafe(keys["id"]), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "keys")
        least = self.min_chars

        def cut(batches):
            import pyarrow as pa

            for batch in batches:
                n, dropped, texts = [], [], []
                for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    lines = text.split("\n")
                    kept = lines
                    if keys:
                        out = {np.array([k["a"], k["b"]], "<i8").tobytes() for k in keys}
                        kept = [x for x in lines if (k := _key(x, least)) is None or _hash(k) not in out]
                    n.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())],
                                                 ["doc_id", "n_lines", "n_dropped", "text"])

        return docs.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, text string")

"""Centroid clustering of integer vectors by progressive search in the Walsh-Hadamard transform.

The transform H of 2 ** m components has H H' = 2 ** m, so 2 ** m times the squared distance of
two vectors is the sum of the squared differences of their coefficients.  Coefficients are
put in order of their sign changes, coarse to fine, and the sums run over them in that
order.  A centroid whose sum has passed the whole distance of another one is strictly worse
and goes; those that stay are finished on all coefficients.  All numbers are integers, so
the assignment, its ties and the centroids are exact.

A round sends each task the centroids and gets one row for each cluster and component; the
vectors themselves are never moved.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corvid.llm.shared import pick, stored, work_dir

#: Components below this have all sums in 64 bits; vectors with larger ones go with Python's integers.
SMALL = 1 << 24


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows of ``x`` (a power of two wide), in order of their sign changes."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x[:, _by_sign_changes(width)]


def _by_sign_changes(width: int) -> np.ndarray:
    signs = np.ones((1, 1), np.int64)
    while len(signs) < width:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of ``centroids``, the smaller one of equals; squared distance) of
    the rows of ``x``; both are transformed."""
    n, width = x.shape
    everyone = np.arange(n)
    total = np.zeros((n, len(centroids)), x.dtype)
    alive = np.ones(total.shape, bool)
    bound = None
    lo, hi = 0, 1
    while lo < width:
        for c in range(len(centroids)):
            rows = np.flatnonzero(alive[:, c])
            d = x[rows, lo:hi] - centroids[c, lo:hi]
            total[rows, c] += (d * d).sum(axis=1)
        if hi in (4, 16) or bound is None and hi == width:
            # the one that is ahead is finished: nothing above its distance can win
            ahead = np.where(alive, total, total.max(initial=0) + 1).argmin(axis=1)
            d = x[:, hi:] - centroids[ahead, hi:]
            whole = total[everyone, ahead] + (d * d).sum(axis=1)
            bound = whole if bound is None else np.minimum(bound, whole)
        if bound is not None:
            alive &= total <= bound[:, None]
        lo, hi = hi, 2 * hi
    total = np.where(alive, total, total.max(initial=0) + 1)
    best = total.argmin(axis=1)
    return best, total[everyone, best] // width


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; as Python integers where they are too large for sums in 64 bits."""
    q = np.floor(flat * float(scale))
    if len(q) == 0 or np.abs(q).max() < SMALL:
        return q.astype(np.int64)
    if not np.abs(q).max() < 2.0**62:
        raise OverflowError("a component is too large for a 64-bit integer")
    return np.array([int(v) for v in q], object)


def kept_vectors(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors with ``dim`` components, none of them missing or not finite."""
    rows = pick(vectors, vec_id=id_col, x=vector_col).withColumn("x", F.col("x").cast("array<double>"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("x").isNotNull() & (F.size("x") == dim) & ~bad)


def _searcher(centroids: list[list[int]], dim: int, scale: int, rows: int = 8192):
    """batch -> (Arrow batch, integer vectors, cluster, distance) for parts of an Arrow batch (vec_id, x)."""
    width = 1 << max(dim - 1, 0).bit_length()
    padded = lambda x: np.concatenate([x, np.zeros((len(x), width - dim), x.dtype)], axis=1)
    c = np.array(centroids, object).reshape(len(centroids), dim)
    few = transform(padded(c.astype(np.int64))) if all(abs(v) < SMALL for v in c.ravel()) else None

    def search(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                x = integers(part.column(1).flatten().to_numpy(zero_copy_only=False), scale).reshape(part.num_rows, dim)
                if x.dtype == object or few is None:
                    best, d = nearest(transform(padded(x.astype(object))), transform(padded(c)))
                else:
                    best, d = nearest(transform(padded(x)), few)
                yield part, x, best, d

    return search


def _totals(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> DataFrame:
    """(cluster, pos, total, n): componentwise sums and sizes of the clusters around ``centroids``."""
    search = _searcher(centroids, dim, scale)

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        sums: dict[int, list] = {}
        for _, x, best, _ in search(batches):
            for c in np.unique(best).tolist():
                mine = x[best == c]
                now = sums.setdefault(c, [[0] * dim, 0])
                now[0] = [s + int(v) for s, v in zip(now[0], mine.sum(axis=0), strict=True)]
                now[1] += len(mine)
        out = [(c, j, Decimal(v), n) for c, (total, n) in sums.items() for j, v in enumerate(total)]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["cluster", "pos", "total", "n"])

    parts = rows.mapInArrow(run, "cluster int, pos int, total decimal(38,0), n long")
    return parts.groupBy("cluster", "pos").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))


def _assigned(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> DataFrame:
    search = _searcher(centroids, dim, scale)
    schema = StructType([rows.schema["vec_id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def run(batches):
        import pyarrow as pa

        for part, _, best, d in search(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(d.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1,
            id_col: str = "vec_id", vector_col: str = "embedding", folder: str | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row of
    ``vectors`` with ``dim`` components, none missing or not finite; other rows take no part.

    Components become floor(scale * x).  The first centroids are the ``k`` vectors (all, if fewer) with
    the smallest sha256 of ``seed:vec_id``, in that order; rows with equal ids go by their
    components, and a row without an id is clustered but never a first centroid.  Each round puts
    every vector to the nearest centroid (ties: the smaller number) and every centroid that has
    vectors to the floor of their mean; then all are assigned once more.  A repeated row counts
    as often as it occurs.  An empty table, or one without an id, gives no row.  A distance or
    component too large for 64 bits is an error."""
    rows = kept_vectors(vectors, dim, id_col, vector_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    centroids = [integers(np.array(r["x"], np.float64), scale).tolist() for r in first]
    if not centroids:
        rows = rows.limit(0)
        rounds = 0
    for _ in range(rounds):
        for r in _totals(rows, centroids, dim, scale).collect():
            centroids[r["cluster"]][r["pos"]] = int(r["total"]) // r["n"]
    spark = vectors.sparkSession
    found = stored(_assigned(rows, centroids, dim, scale), f"{folder or work_dir(spark, 'clusters')}/assigned")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

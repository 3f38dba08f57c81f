"""K1-K9: exact k-nearest-neighbour classification as Spark jobs.

``store_training`` writes the training rows once, sorted by the feature that
varies most, as blocks of bounded size in the shared folder, and next to them a
directory of two levels: pages with the bounding boxes of neighbouring blocks,
and the boxes of the pages.  The query rows stay where they are: inside
``mapInArrow`` a task takes a bounded chunk of them and opens the pages and
blocks that can hold a neighbour, nearest box first, until the next box is farther
away than the k-th neighbour of every row.  So nothing is broadcast, the driver
holds three numbers, no side is shuffled, and the training set is never copied
per query block.  With one feature, or few, the boxes leave only the blocks
around a row's value, and within a block only the leaves around it.

With many features a block is first compared in float32 or integers (``_Rough``), with a
bound on the rounding; only pairs that may be neighbours are added up exactly.  Of rows with
one and the same vector only the ``k`` smallest keys are compared, and a task holds no more
than about ``k`` pairs a row, so ties cost neither time nor memory.

numpy computes the distances, and the neighbours of a row, or only its vote,
leave the task together.  Distance ties are broken by the training key, vote ties by
the smallest label (``mode(..., deterministic=True)``)."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from corvid.session import materialize, shared_folder, spread

METRICS = ("euclidean", "manhattan", "minkowski")

#: Rows of a leaf, the neighbouring rows of a block that share a box.
LEAF_ROWS = 128
#: With more features than these the boxes of leaves exclude next to nothing.
FEW_FEATURES = 8

# The task functions below run in Python workers: ship them by value, so the
# executors need numpy/pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feature_vector(df: DataFrame, features: str | Sequence[str]) -> F.Column:
    """One ``array<double>`` from an array column or a list of numeric columns."""
    if isinstance(features, str):
        dtype = df.schema[features].dataType
        if isinstance(dtype, ArrayType):
            return F.transform(F.col(features), lambda x: x.cast("double"))
        features = [features]
    return F.array(*[F.col(c).cast("double") for c in features])


def _power(metric: str, p: float) -> float:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return {"euclidean": 2.0, "manhattan": 1.0}.get(metric, float(p))


def _vectors(column, dim: int):
    """(matrix, usable) of an Arrow list column: a row is usable when it has ``dim``
    finite or infinite values, none missing."""
    out, ok = np.full((len(column), dim), np.nan), np.zeros(len(column), bool)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), -1)
    full = np.flatnonzero(sizes == dim)
    if len(full):
        flat = column.take(full.tolist()).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[full] = flat.reshape(len(full), dim)
        ok[full] = ~np.isnan(out[full]).any(axis=1)
    return out, ok


def _terms(diff: np.ndarray, power: float) -> np.ndarray:
    if power == 2.0:
        return diff * diff
    return np.abs(diff) if power == 1.0 else np.abs(diff) ** power


def _distances(q: np.ndarray, r: np.ndarray, power: float, weights) -> np.ndarray:
    """Summed one feature at a time, so the order of addition is fixed."""
    acc = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        term = _terms(q[:, j][:, None] - r[:, j][None, :], power)
        acc += term if weights is None else term * weights[j]
    return acc


def _box_distances(lo: np.ndarray, hi: np.ndarray, box_lo: np.ndarray, box_hi: np.ndarray, power: float, weights) -> np.ndarray:
    """Least distance of the rows in [lo, hi] to each box, added up as ``_distances`` does, so
    that rounding never makes it larger than the distance of a row in the box."""
    acc = np.zeros((len(lo), len(box_lo)))
    for j in range(lo.shape[1]):
        gap = np.fmax(np.fmax(box_lo[:, j][None, :] - hi[:, j][:, None], lo[:, j][:, None] - box_hi[:, j][None, :]), 0)
        term = _terms(gap, power)
        acc += term if weights is None else term * weights[j]
    return acc


def _pair_distances(q: np.ndarray, r: np.ndarray, power: float, weights) -> np.ndarray:
    """The distance of each row of ``q`` to the same row of ``r``, added up as ``_distances`` does."""
    acc = np.zeros(len(q))
    for j in range(q.shape[1]):
        term = _terms(q[:, j] - r[:, j], power)
        acc += term if weights is None else term * weights[j]
    return acc


def _sortable(ids) -> np.ndarray:
    x = ids.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def _kd_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which every ``leaf`` rows from the first lie close together:
    halves along the widest feature, down to single leaves."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            continue
        part = x[order[lo:hi]]
        with np.errstate(invalid="ignore"):
            width = part.max(axis=0) - part.min(axis=0)
        half = -(-(hi - lo) // (2 * leaf)) * leaf
        if width.max() != 0:
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, int(width.argmax())], half)]
            todo += [(lo, lo + half), (lo + half, hi)]
    return order


def _rank_in_run(starts: np.ndarray) -> np.ndarray:
    """Position of each row in its run; ``starts`` marks the first rows."""
    begin = np.flatnonzero(starts)
    return np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))


class _Block:
    """A stored block in a task: the first ``kk`` rows of each vector."""

    def __init__(self, uri: str, kk: int):
        import pyarrow as pa

        self.x, self.ids, self.labels, copy = _read_block(uri)
        if (copy >= kk).any():
            use = np.flatnonzero(copy < kk)
            self.x, self.ids, self.labels = self.x[use], self.ids.take(pa.array(use)), self.labels.take(pa.array(use))
        self.key_ranks, self.rough = None, None
        if 0 < self.x.shape[1] <= FEW_FEATURES:
            starts = np.arange(0, len(self.x), LEAF_ROWS)
            self.leaf_lo, self.leaf_hi = (f.reduceat(self.x, starts, axis=0) for f in (np.minimum, np.maximum))

    def key_rank(self) -> np.ndarray:
        if self.key_ranks is None:
            self.key_ranks = np.empty(len(self.x), np.int64)
            self.key_ranks[np.argsort(_sortable(self.ids), kind="stable")] = np.arange(len(self.x))
        return self.key_ranks


class _Rough:
    """Distances to the rows of a block up to a known error, several times faster than the exact ones.

    Vectors are taken from the block's mean, features scaled by their weights, in float32.
    Euclidean distances are one matrix product.  For the other metrics a cheaper lower bound
    goes first: Manhattan distances of 16-bit integers (values outside the usual range of
    a feature are moved to its ends, which brings no two closer than they are apart), and
    for a power above 2 the power mean of the Euclidean distance."""

    def __init__(self, x: np.ndarray, power: float, weights):
        self.x, self.power, self.dim, self.weights = x, power, x.shape[1], weights
        with np.errstate(all="ignore"):
            scale = 1.0 if weights is None else np.asarray(weights) ** (1.0 / power)
            self.scale, self.shift = scale, x.mean(axis=0) * scale
            z = x * scale - self.shift
            size = self.sizes(z).max()
        self.usable = power in (1.0, 2.0, 3.0, 4.0) and bool(np.isfinite(z).all()) and size < 1e30
        if not self.usable:
            return
        z32 = z.astype(np.float32)
        self.size, self.columns = size, np.ascontiguousarray(z32.T)
        if power >= 2:
            square = np.einsum("ij,ij->i", z, z)
            self.norm = float(np.sqrt(square.max()))
            self.product = np.concatenate([self.columns, square.astype(np.float32)[None]])
        if power > 2:
            self.rows = z32
        self.step = 0.0
        if power == 1 and self.dim <= 256:
            self.low, high = np.quantile(z, [0.001, 0.999], axis=0)
            levels = min(1023, 65535 // self.dim)
            self.high, self.step = high, float((high - self.low).max()) / levels
            self.codes = np.ascontiguousarray(self.coded(z).T) if self.step > 0 else None

    def coded(self, z):
        return np.rint((np.clip(z, self.low, self.high) - self.low) / self.step).astype(np.int16)

    def sizes(self, z):
        """Sum of the powers of each row's values."""
        return sum(np.abs(z[:, j]) ** self.power for j in range(self.dim))

    def query(self, x: np.ndarray):
        """Some query rows as this block's rows are; None where float32 does not hold them."""
        if not self.usable:
            return None
        with np.errstate(all="ignore"):
            z = x * self.scale - self.shift
            size = self.sizes(z)
        if not (np.isfinite(z).all() and size.max() < 1e30):
            return None
        q = {"z": z.astype(np.float32)}
        # rounding of the values, the terms and the sum, twice over
        q["error"] = 2.0 ** (self.power - 1) * (size + self.size) * (2 * self.dim + 64) * 2.0 ** -23 + 1e-36 * self.dim
        if self.power >= 2:
            q["square"] = np.einsum("ij,ij->i", z, z)
            q["product"] = np.concatenate([-2 * q["z"], np.ones((len(z), 1), np.float32)], axis=1)
            q["square_error"] = (np.sqrt(q["square"]) + self.norm) ** 2 * (2 * self.dim + 64) * 2.0 ** -23 + 1e-36 * self.dim
        if self.step > 0:
            q["codes"] = self.coded(z)
        return q

    @staticmethod
    def above(limit):
        """The limit in float32, never below it."""
        return np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]

    def lower_bound(self, q, some: slice, columns: slice, kth):
        """Which pairs the cheaper bound leaves; None without one."""
        if self.step > 0:
            r, z = self.codes[:, columns], q["codes"][some]
            mask = np.empty((len(z), r.shape[1]), bool)
            limit = np.minimum(np.floor(kth * (1 + 1e-9) / self.step) + self.dim + 2, 65535).astype(np.uint16)
            for lo in range(0, len(z), 8):
                part = np.ascontiguousarray(z[lo:lo + 8].T)[:, :, None]
                total, term = np.zeros((part.shape[1], r.shape[1]), np.int16), np.empty((part.shape[1], r.shape[1]), np.int16)
                for j in range(self.dim):
                    np.subtract(part[j], r[j], out=term)
                    np.abs(term, out=term)
                    np.add(total, term, out=total)
                np.less_equal(total.view(np.uint16), limit[lo:lo + 8, None], out=mask[lo:lo + 8])
            return mask
        if self.power > 2:
            square = kth ** (2 / self.power) * self.dim ** (1 - 2 / self.power) * (1 + 1e-9)
            return q["product"][some] @ self.product[:, columns] <= self.above(square + q["square_error"][some] - q["square"][some])
        return None

    def distances(self, q, some: slice, columns: slice):
        """(distances, error, what the distances lack): of all pairs."""
        if self.power == 2:
            return q["product"][some] @ self.product[:, columns], q["square_error"][some], q["square"][some]
        r, z = self.columns[:, columns], q["z"][some]
        out = np.zeros((len(z), r.shape[1]), np.float32)
        for lo in range(0, len(z), 8):
            part, total = np.ascontiguousarray(z[lo:lo + 8].T)[:, :, None], out[lo:lo + 8]
            for j in range(self.dim):
                total += self.powers(np.abs(part[j] - r[j]))
        return out, q["error"][some], 0.0

    def powers(self, d):
        return d if self.power == 1 else d * d * d if self.power == 3 else np.square(d * d)

    def may_be_near(self, q, lo: int, a, b, kth):
        """Of the pairs left by the bound, those whose float32 distance is near."""
        keep = []
        for i in range(0, len(a), 8192):
            x, y = a[i:i + 8192], b[i:i + 8192]
            d = self.powers(np.abs(q["z"][lo + x] - self.rows[y])).sum(axis=1)
            keep.append(d <= (kth[x] + q["error"][lo + x]) * (1 + 1e-6))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return a[keep], b[keep]


class _Nearest:
    """The ``kk`` nearest rows found so far of each row of a chunk."""

    def __init__(self, x: np.ndarray, kk: int, power: float, weights):
        self.x, self.kk, self.power, self.weights = x, kk, power, weights
        self.kth, self.best = np.full(len(x), np.inf), np.full((len(x), kk), np.inf)
        self.open, self.n_open, self.done = [], 0, None
        self.room = max(1 << 18, 2 * len(x) * kk)  # pairs held before they are thinned

    def within(self, dist: np.ndarray, limit: np.ndarray, error):
        """(row, column) of the distances that may be among the nearest; ties at the limit stay in."""
        mask = dist <= limit
        if np.count_nonzero(mask) > 2 * self.kk * len(dist) and dist.shape[1] > self.kk:
            top = np.partition(dist, self.kk - 1, axis=1)[:, self.kk - 1].astype(np.float64)
            top = top if error is None else _Rough.above(top + 2 * error)[:, 0]
            mask = dist <= np.fmin(limit, top[:, None])
        a, b = np.divmod(np.flatnonzero(mask.ravel()), dist.shape[1])
        return a, b

    def search(self, block: _Block, rows: np.ndarray) -> None:
        """Compare some rows of the chunk with a block."""
        if 0 < self.x.shape[1] <= FEW_FEATURES:
            self.search_leaves(block, rows)
        else:
            self.search_whole(block, rows)
        self.close(block)

    def search_leaves(self, block: _Block, rows: np.ndarray) -> None:
        rows = rows[_kd_order(self.x[rows], 64)]
        inside = np.arange(LEAF_ROWS)
        for lo in range(0, len(rows), 64):
            some = rows[lo:lo + 64]
            x = self.x[some]
            d = _box_distances(x.min(axis=0)[None], x.max(axis=0)[None], block.leaf_lo, block.leaf_hi, self.power, self.weights)[0]
            leaves = np.flatnonzero(d <= self.kth[some].max())
            leaves = leaves[np.argsort(d[leaves], kind="stable")]
            i, step = 0, 1
            while i < len(leaves):
                end = min(i + step, int(np.searchsorted(d[leaves], self.kth[some].max(), side="right")))
                if end <= i:
                    break
                at = (leaves[i:end, None] * LEAF_ROWS + inside).ravel()
                at = at[at < len(block.x)]
                dist = _distances(x, block.x[at], self.power, self.weights)
                a, b = self.within(dist, self.kth[some][:, None], None)
                self.add(block, some[a], at[b], dist[a, b])
                i, step = end, min(2 * step, 16)

    def search_whole(self, block: _Block, rows: np.ndarray) -> None:
        if block.rough is None:
            block.rough = _Rough(block.x, self.power, self.weights)
        rough, n = block.rough, len(block.x)
        q = rough.query(self.x[rows])
        wide = 8192 if self.power == 1 else 4096
        cuts = [0, *range(min(n, 1024), n, wide), n]  # a first narrow part sets the limits
        for lo in range(0, len(rows), 512):
            part, some = slice(lo, lo + 512), rows[lo:lo + 512]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                kth, columns = self.kth[some], slice(begin, end)
                if q is None:
                    dist = _distances(self.x[some], block.x[columns], self.power, self.weights)
                    a, b = self.within(dist, kth[:, None], None)
                    self.add(block, some[a], begin + b, dist[a, b])
                    continue
                mask = rough.lower_bound(q, part, columns, kth) if np.isfinite(kth).all() else None
                if mask is not None and np.count_nonzero(mask) * 6 < mask.size:
                    a, b = np.divmod(np.flatnonzero(mask.ravel()), end - begin)
                    if self.power > 2:
                        a, b = rough.may_be_near(q, lo, a, b + begin, kth)
                        b = b - begin
                else:
                    dist, error, lacks = rough.distances(q, part, columns)
                    a, b = self.within(dist, rough.above(kth + error - lacks), error)
                for i in range(0, len(a), 1 << 17):
                    at, to = some[a[i:i + (1 << 17)]], begin + b[i:i + (1 << 17)]
                    dist = _pair_distances(self.x[at], block.x[to], self.power, self.weights)
                    near = np.flatnonzero(dist <= self.kth[at])
                    self.add(block, at[near], to[near], dist[near])

    def add(self, block: _Block, row, at, dist) -> None:
        """Pairs of the chunk's and the block's rows: they set the limits for the next."""
        if not len(row):
            return
        self.open.append((row, at, dist))
        self.n_open += len(row)
        order = np.lexsort((dist, row))
        row, dist = row[order], dist[order]
        starts = np.concatenate([[True], row[1:] != row[:-1]])
        rank, slot = _rank_in_run(starts), np.cumsum(starts) - 1
        rows, first = row[starts], rank < self.kk
        new = np.full((len(rows), min(self.kk, int(rank.max()) + 1)), np.inf)
        new[slot[first], rank[first]] = dist[first]
        merged = np.sort(np.concatenate([self.best[rows], new], axis=1), axis=1)[:, :self.kk]
        self.best[rows], self.kth[rows] = merged, merged[:, -1]
        if self.n_open > self.room:
            self.thin(block)

    def first(self, row, dist, keys):
        """Positions of the first ``kk`` pairs of each row by distance and key, in that order, and their ranks."""
        near = np.flatnonzero(dist <= self.kth[row])
        near = near[np.lexsort((keys[near], dist[near], row[near]))]
        row = row[near]
        rank = _rank_in_run(np.concatenate([[True], row[1:] != row[:-1]])[:len(row)])
        return near[rank < self.kk], rank[rank < self.kk] + 1

    def thin(self, block: _Block) -> None:
        row, at, dist = (np.concatenate([p[c] for p in self.open]) for c in range(3))
        keep, _ = self.first(row, dist, block.key_rank()[at])
        self.open, self.n_open = [(row[keep], at[keep], dist[keep])], len(keep)

    def close(self, block: _Block) -> None:
        """Replace the open pairs by their keys and labels; at most ``kk`` pairs a row stay."""
        import pyarrow as pa

        if not self.n_open:
            return
        self.thin(block)
        (row, at, dist), = self.open
        self.open, self.n_open = [], 0
        at = pa.array(at)
        found = [(row, block.ids.take(at), block.labels.take(at), dist), *([self.done] if self.done else [])]
        row, dist = (np.concatenate([f[c] for f in found]) for c in (0, 3))
        ids, labels = (pa.concat_arrays([f[c] for f in found]) for c in (1, 2))
        keep, self.rank = self.first(row, dist, _sortable(ids))
        self.done = row[keep], ids.take(pa.array(keep)), labels.take(pa.array(keep)), dist[keep]


def _open(uri: str):
    """(file system, path) of a file or folder that all machines share."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), unquote(urlparse(uri).path) if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def _read_block(uri: str):
    """(vectors, keys, labels, number among the rows of the same vector) of a stored block."""
    import pyarrow.parquet as pq

    where, path = _open(uri)
    with where.open_input_file(path) as f:
        row = pq.read_table(f, columns=["n", "ids", "labels", "xs", "copies"])
    n = row["n"][0].as_py()
    x = np.frombuffer(row["xs"][0].as_py(), np.float64).reshape(n, -1)
    return x, *(row[c].combine_chunks().flatten() for c in ("ids", "labels")), row["copies"].combine_chunks().flatten().to_numpy()


def _read_boxes(uri: str, dim: int):
    """(files, least corners, greatest corners) of a page of the directory, or of its top folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = _open(uri)
    found = where.get_file_info(path)
    names = [path] if found.is_file else sorted(i.path for i in where.get_file_info(fs.FileSelector(path)) if i.path.endswith(".parquet"))
    files, lo, hi = [], [], []
    for name in names:
        with where.open_input_file(name) as f:
            rows = pq.read_table(f, columns=["file", "lo", "hi"])
        files += rows["file"].to_pylist()
        lo += rows["lo"].to_pylist()
        hi += rows["hi"].to_pylist()
    return files, *(np.array(v, np.float64).reshape(len(v), dim) for v in (lo, hi))


@dataclass
class TrainingBlocks:
    """Training rows stored by ``store_training``: where they are and what they hold."""

    path: str
    n: int
    dim: int
    order: int
    features: str | Sequence[str]
    id_type: DataType
    label_type: DataType


def store_training(train: DataFrame, *, features: str | Sequence[str], label_col: str, train_id: str,
                   block_bytes: int = 16 << 20, block_rows: int | None = None,
                   page_blocks: int = 1024) -> TrainingBlocks:
    """Write the training rows as blocks, once for any number of predictions.

    Rows without a full feature vector are left out: they are at no distance from
    anything.  The directory is made by Spark from the blocks' boxes: ``path/pages``
    holds up to ``page_blocks`` neighbouring blocks a file, ``path/top`` a row for each
    page.  The driver gets the number of rows, the dimension and the sort feature."""
    spark = train.sparkSession
    r = train.select(F.col(train_id).alias("_rid"), F.col(label_col).alias("_rlab"), feature_vector(train, features).alias("_x"))
    r = r.where(F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    if isinstance(features, str) and isinstance(train.schema[features].dataType, ArrayType):
        dim = r.agg(F.max(F.size("_x"))).first()[0] or 0
    else:
        dim = 1 if isinstance(features, str) else len(features)
    r = r.where(F.size("_x") == dim)
    spreads = r.agg(*[F.var_pop(F.col("_x")[j]).alias(f"v{j}") for j in range(dim)]).first() if dim > 1 else [0]
    order = max(range(dim), key=lambda j: spreads[j] or 0.0) if dim else 0
    rows_per_block = block_rows or max(1_000, block_bytes // (8 * (dim + 4)))
    id_type, label_type = train.schema[train_id].dataType, train.schema[label_col].dataType
    schema = StructType([StructField("n", IntegerType()), StructField("ids", ArrayType(id_type)), StructField("labels", ArrayType(label_type)),
                         *StructType.fromDDL("xs binary, copies array<int>, lo array<double>, hi array<double>").fields])

    def pack(batches):
        import pyarrow as pa

        def block(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            x = _vectors(table["_x"].combine_chunks(), dim)[0]
            copies = np.zeros(len(x), np.int64)
            if dim:  # rows of one vector follow each other, by key
                bits = x.view(np.int64)
                starts = np.concatenate([[True], (bits[1:] != bits[:-1]).any(axis=1)])
                copies = _rank_in_run(starts)
            if 0 < dim <= FEW_FEATURES:
                place = np.empty(np.count_nonzero(starts), np.int64)
                place[_kd_order(x[starts], LEAF_ROWS)] = np.arange(len(place))
                at = np.argsort(place[np.cumsum(starts) - 1], kind="stable")
                x, copies, table = x[at], copies[at], table.take(pa.array(at)).combine_chunks()
            one = [pa.array([0, len(x)], pa.int32())]
            return pa.RecordBatch.from_arrays([
                pa.array([len(x)], pa.int32()), pa.ListArray.from_arrays(*one, table["_rid"].combine_chunks()),
                pa.ListArray.from_arrays(*one, table["_rlab"].combine_chunks()), pa.array([x.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(*one, pa.array(copies, pa.int32())),
                pa.array([x.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([x.max(axis=0).tolist()], pa.list_(pa.float64()))],
                ["n", "ids", "labels", "xs", "copies", "lo", "hi"])

        waiting, n = [], 0
        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, rows_per_block - n)
                waiting.append(b.slice(0, take))
                b, n = b.slice(take), n + take
                if n == rows_per_block:
                    yield block(waiting)
                    waiting, n = [], 0
        if n:
            yield block(waiting)

    path = shared_folder(spark, "training")
    if dim:
        r = r.repartitionByRange(F.col("_x")[order], F.xxhash64("_rid")).sortWithinPartitions(F.col("_x")[order], "_x", F.col("_rid").asc_nulls_last())
    r.mapInArrow(pack, schema).write.option("maxRecordsPerFile", 1).parquet(f"{path}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks").select(F.input_file_name().alias("file"), "n", "lo", "hi")
    n, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    if dim:
        by = [F.col("lo")[order], F.col("file")]
        blocks = blocks.repartitionByRange(max(1, -(-count // page_blocks)), *by).sortWithinPartitions(*by)
    blocks.select("file", "lo", "hi").write.option("maxRecordsPerFile", page_blocks).parquet(f"{path}/pages")
    pages = spark.read.parquet(f"{path}/pages").groupBy(F.input_file_name().alias("file"))
    corner = lambda f, c: F.array(*[f(F.col(c)[j]) for j in range(dim)]) if dim else F.array().cast("array<double>")
    pages.agg(corner(F.min, "lo").alias("lo"), corner(F.max, "hi").alias("hi")).write.parquet(f"{path}/top")
    return TrainingBlocks(path, n, dim, order, features, id_type, label_type)


def knn_neighbors(train: DataFrame | TrainingBlocks, test: DataFrame, *, features: str | Sequence[str] | None = None,
                  label_col: str | None = None, train_id: str | None = None, test_id: str, k: int,
                  metric: str = "euclidean", p: float = 2.0,
                  weights: Sequence[float] | None = None, keep_cols: Sequence[str] = (),
                  allow_fewer: bool = False, missing: str = "null", block_rows: int | None = None,
                  n_test: int | None = None, chunk_rows: int = 4096, votes: Sequence[int] | None = None) -> DataFrame:
    """The ``k`` nearest training rows of every test row.

    Returns ``test_id, neighbor_id, neighbor_label, distance, rank`` plus the
    ``keep_cols`` of the test row, the rows of one test row together.  ``train`` is a table or stored blocks.  ``k``
    larger than the training rows raises ``ValueError`` (K5) unless
    ``allow_fewer``, which then gives all rows.  A test row without a full
    feature vector gets one row with a NULL neighbour (``missing="error"`` stops
    the query).  ``n_test``, where known, lets a small table with heavy work be
    dealt over all cores.  With ``votes`` the task keeps the neighbours to itself and gives
    ``test_id, k, prediction`` for each of these numbers of neighbours (see ``knn_predict``)."""
    power = _power(metric, p)
    if missing not in ("null", "error"):
        raise ValueError("missing must be 'null' or 'error'")
    blocks = train if isinstance(train, TrainingBlocks) else store_training(
        train, features=features, label_col=label_col, train_id=train_id, block_rows=block_rows)
    if blocks.n == 0:
        raise ValueError("empty training set")
    if k > blocks.n and not allow_fewer:
        raise ValueError(f"k={k} is larger than the {blocks.n} training rows")
    w = None if weights is None else np.asarray(weights, dtype=np.float64)
    features = blocks.features if features is None else features
    dim, kk, order, top = blocks.dim, min(k, blocks.n), blocks.order, f"{blocks.path}/top"

    found = [StructField("neighbor_id", blocks.id_type), StructField("neighbor_label", blocks.label_type),
             StructField("distance", DoubleType()), StructField("rank", IntegerType())]
    voted = [StructField("k", IntegerType()), StructField("prediction", blocks.label_type)]
    schema = StructType([StructField(test_id, test.schema[test_id].dataType), *[test.schema[c] for c in keep_cols], *(voted if votes else found)])
    q = test.select(F.col(test_id).alias("_qid"), feature_vector(test, features).alias("_x"), *[F.col(c).alias(f"_keep_{c}") for c in keep_cols])
    if n_test is not None:
        q = spread(q, float(n_test) * blocks.n * max(dim, 1), n_test)
    if dim:
        q = q.sortWithinPartitions(F.col("_x")[order])  # rows of a chunk lie close together

    def search(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kept: dict[str, tuple] = {}
        page_files, page_lo, page_hi = None, None, None

        def load(file, read, *args):
            """One of the few files in memory."""
            if file not in kept:
                while len(kept) >= 8:
                    kept.pop(next(iter(kept)))
                kept[file] = read(file, *args)
            return kept[file]

        def nearest(x):
            """(row, key, label, distance, rank) of the kk nearest of each row, in order."""
            nonlocal page_files, page_lo, page_hi
            if page_files is None:
                page_files, page_lo, page_hi = _read_boxes(top, dim)
            near_by = _Nearest(x, kk, power, w)
            low, high = x.min(axis=0)[None], x.max(axis=0)[None]
            # pages and blocks by the distance of their boxes from the chunk's box; a page is replaced by its blocks
            near = _box_distances(low, high, page_lo, page_hi, power, w)[0]
            todo = [(d, 0, f, None, None) for d, f in zip(near.tolist(), page_files, strict=True)]
            heapq.heapify(todo)
            while todo:
                d, is_block, file, lo_corner, hi_corner = heapq.heappop(todo)
                if d > near_by.kth.max():
                    break
                if not is_block:
                    names, box_lo, box_hi = load(file, _read_boxes, dim)
                    near = _box_distances(low, high, box_lo, box_hi, power, w)[0]
                    for i in np.flatnonzero(near <= near_by.kth.max()).tolist():
                        heapq.heappush(todo, (float(near[i]), 1, names[i], tuple(box_lo[i]), tuple(box_hi[i])))
                    continue
                box = (np.array(c, np.float64).reshape(1, dim) for c in (lo_corner, hi_corner))
                rows = np.flatnonzero(_box_distances(x, x, *box, power, w)[:, 0] <= near_by.kth)
                if len(rows):
                    near_by.search(load(file, _Block, kk), rows)
            row, ids, labels, dist = near_by.done or (np.empty(0, np.int64), pa.nulls(0).cast(id_kind), pa.nulls(0).cast(label_kind), np.empty(0))
            return row, ids, labels, dist, near_by.rank if near_by.done else np.empty(0, np.int64)

        def ballot(part, row, labels, rank):
            """For each number of voters a prediction for every row of the part, NULL without neighbours."""
            names_of = sorted(pc.unique(labels.drop_null()).to_pylist(), key=lambda v: (v != v, v))
            code = {v if v == v else None: i for i, v in enumerate(names_of)}
            mine = labels.to_pylist()
            codes = np.array([-1 if v is None else code[v if v == v else None] for v in mine], np.int64)
            choice = pa.array(names_of, label_kind)
            for voters in votes:
                use = np.flatnonzero((rank <= voters) & (codes >= 0))
                pair, n = np.unique(row[use] * max(1, len(names_of)) + codes[use], return_counts=True)
                who, what = pair // max(1, len(names_of)), pair % max(1, len(names_of))
                at = np.lexsort((what, -n, who))  # most votes, then the smallest label
                first = at[np.flatnonzero(np.concatenate([[True], who[at][1:] != who[at][:-1]]))] if len(at) else at
                won = np.full(part.num_rows, -1, np.int64)
                won[who[first]] = what[first]
                yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(i) for i in range(2, part.num_columns)],
                                                  pa.array(np.full(part.num_rows, voters), pa.int32()),
                                                  choice.take(pa.array(won, mask=won < 0))], names)

        for b in batches:
            for lo in range(0, b.num_rows, chunk_rows):
                part = b.slice(lo, chunk_rows)
                x, ok = _vectors(part.column(1), dim)
                if votes:
                    if missing == "error" and not ok.all():
                        raise ValueError("a test row has no full feature vector")
                    row, labels, rank = np.empty(0, np.int64), pa.nulls(0).cast(label_kind), np.empty(0, np.int64)
                    if ok.any():
                        good = np.flatnonzero(ok)
                        row, _, labels, _, rank = nearest(x[good])
                        row = good[row]
                    yield from ballot(part, row, labels, rank)
                    continue
                out = []
                if not ok.all():
                    if missing == "error":
                        raise ValueError("a test row has no full feature vector")
                    bad = np.flatnonzero(~ok)
                    none = pa.nulls(len(bad))
                    out.append((bad, None, None, none.cast(pa.float64()), pa.array(np.ones(len(bad)), pa.int32(), safe=False)))
                if ok.any():
                    good = np.flatnonzero(ok)
                    row, ids, labels, dist, rank = nearest(x[good])
                    dist = {2.0: np.sqrt, 1.0: lambda d: d}.get(power, lambda d: d ** (1.0 / power))(dist)
                    out.append((good[row], ids, labels, pa.array(dist), pa.array(rank, pa.int32())))
                for row, ids, labels, dist, rank in out:
                    at = pa.array(row)
                    keys, values = (c if c is not None else pa.nulls(len(row)).cast(t) for c, t in ((ids, id_kind), (labels, label_kind)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), *[part.column(i).take(at) for i in range(2, part.num_columns)],
                                                      keys, values, dist, rank], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind, label_kind = to_arrow_type(blocks.id_type), to_arrow_type(blocks.label_type)
    names = schema.names
    return q.mapInArrow(search, schema)


def knn_vote(neighbors: DataFrame, test_id: str, k: int | None = None,
             keep_cols: Sequence[str] = (), prediction_col: str = "prediction") -> DataFrame:
    """K3: majority label of the first ``k`` neighbours, ties to the smallest label;
    NULL for a row without neighbours."""
    nb = neighbors if k is None else neighbors.filter(F.col("rank") <= k)
    return nb.groupBy(test_id).agg(
        F.mode("neighbor_label", True).alias(prediction_col),
        *[F.any_value(c).alias(c) for c in keep_cols])


def knn_vote_many(neighbors: DataFrame, test_id: str, ks: Sequence[int],
                  keep_cols: Sequence[str] = ()) -> DataFrame:
    """K6: one vote per k from a single neighbour search at ``max(ks)``."""
    ks_col = F.array(*[F.lit(int(x)) for x in sorted(set(ks))])
    nb = neighbors.withColumn("k", F.explode(ks_col)).filter(F.col("rank") <= F.col("k"))
    return nb.groupBy(test_id, "k").agg(
        F.mode("neighbor_label", True).alias("prediction"),
        *[F.any_value(c).alias(c) for c in keep_cols])


def knn_predict(train: DataFrame | TrainingBlocks, test: DataFrame, *, test_id: str, k: int = 5,
                keep_cols: Sequence[str] = (), **kw) -> DataFrame:
    """K1-K4: fit (= hold the training rows) and predict in one plan; the other
    arguments are those of ``knn_neighbors``.  The neighbours of a row are found in one
    task and vote there, so nothing is shuffled: one prediction for each test row, also
    for rows with equal ids; ties go to the smallest label, rows without neighbours get NULL."""
    out = knn_neighbors(train, test, test_id=test_id, k=k, keep_cols=keep_cols, votes=[k], **kw)
    return out.select(test_id, "prediction", *keep_cols)


def knn_predict_many(train: DataFrame | TrainingBlocks, test: DataFrame, *, test_id: str, ks: Sequence[int],
                     keep_cols: Sequence[str] = (), **kw) -> DataFrame:
    """K6: ``test_id, k, prediction`` for every k from a single search at ``max(ks)``."""
    out = knn_neighbors(train, test, test_id=test_id, k=max(ks), keep_cols=keep_cols, votes=sorted(set(ks)), **kw)
    return out.select(test_id, "k", "prediction", *keep_cols)


def accuracy(df: DataFrame, prediction_col: str = "prediction", label_col: str = "label",
             by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = F.col(prediction_col).eqNullSafe(F.col(label_col)).cast("double")
    agg = F.avg(hit).alias("accuracy")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def knn_score(train: DataFrame | TrainingBlocks, test: DataFrame, *, score_label: str | None = None, **kw) -> DataFrame:
    """K7: accuracy of a KNN fitted on ``train`` over the labels in the test rows'
    column ``score_label`` (by default the training label's name): true labels, or
    predictions of the same or another fit."""
    label = score_label or kw["label_col"]
    pred = knn_predict(train, test.withColumnRenamed(label, "_actual"), keep_cols=["_actual"], **kw)
    return accuracy(pred, "prediction", "_actual")


def pseudo_label_refit(train: DataFrame | TrainingBlocks, test: DataFrame, *, features, label_col: str,
                       train_id: str, test_id: str, k: int = 5, **kw) -> DataFrame:
    """K8: predict the test rows, refit on them with the predicted labels and
    predict them again.  Returns ``test_id, pseudo_label, refit_prediction``."""
    first = knn_predict(train, test, features=features, label_col=label_col, train_id=train_id,
                        test_id=test_id, k=k, **kw)
    # the relabelled rows are both sides of the second search: store them once
    relabelled = materialize(test.join(first.withColumnRenamed("prediction", "pseudo_label"), test_id))
    second = knn_predict(relabelled, relabelled, features=features, label_col="pseudo_label",
                         train_id=test_id, test_id=test_id, k=k, keep_cols=["pseudo_label"], **kw)
    return second.select(test_id, "pseudo_label", F.col("prediction").alias("refit_prediction"))

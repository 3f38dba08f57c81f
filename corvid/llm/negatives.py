"""Hard negatives by the threshold algorithm over sorted lists.

The rows are stored once as blocks of bounded size, each of one label, with the row numbers
of every dimension in order of that component; a table of the blocks (label, file, greatest
and least value by dimension) stands next to them.  Tasks take bounded chunks of anchors and read
the blocks that can hold something better than what they have.

In a block an anchor goes down the lists of all its dimensions at once, from the top where its
own component is positive and from the bottom where it is negative.  Rows met for the first
time are scored exactly.  The scalar product of the anchor with the values reached is the most that a
row not met yet can score; when it falls strictly below the last place that still
counts, the block is done.  For the positives that place is the fifth best score of the
anchor's label; for the negatives each positive has a window of scores, and the place is the
third best in the window, or the window's lower end while fewer are found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import filesystem, pick, stored, work_dir

BLOCK = "label int, dim int, top array<long>, low array<long>, ids binary, x binary, lists binary"


def scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as 64-bit integers."""
    q = np.floor(flat * float(scale))
    if len(q) and not np.abs(q).max() < 2.0**62:
        raise OverflowError("a component is too large for a 64-bit integer")
    return q.astype(np.int64)


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x): rows with an id, a label and a vector without missing or not finite components."""
    rows = pick(vectors, vec_id=id_col, label=label_col, x=vector_col).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)


def store_lists(rows: DataFrame, folder: str, scale: int, block_rows: int) -> None:
    """Write the blocks of ``rows`` (vec_id, label, x) and the table of them.  Rows are dealt by ranges
    of (label, vector length, hash), so a label with very many rows is spread over tasks."""

    def pack(batches):
        import pyarrow as pa

        def block(key, parts):
            label, dim = key
            ids = np.concatenate([i for i, _ in parts])
            x = np.concatenate([v for _, v in parts])
            order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16 if len(x) <= 1 << 16 else np.uint32)
            return pa.RecordBatch.from_arrays([
                pa.array([label], pa.int32()), pa.array([dim], pa.int32()), pa.array([x.max(axis=0).tolist()], pa.list_(pa.int64())),
                pa.array([x.min(axis=0).tolist()], pa.list_(pa.int64())),
                *(pa.array([v], pa.binary()) for v in (ids.tobytes(), x.tobytes(), np.ascontiguousarray(order).tobytes()))],
                ["label", "dim", "top", "low", "ids", "x", "lists"])

        key, parts, n = None, [], 0
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy()
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = scaled(b.column(2).flatten().to_numpy(zero_copy_only=False), scale)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (sizes[1:] != sizes[:-1]), [True]])) if len(ids) else []
            for lo, end in zip(cuts[:-1], cuts[1:], strict=True):
                if (labels[lo], sizes[lo]) != key and n:
                    yield block(key, parts)
                    parts, n = [], 0
                key = (labels[lo], sizes[lo])
                while lo < end:
                    hi = min(end, lo + block_rows - n)
                    parts.append((ids[lo:hi], x[begin[lo]:begin[hi]].reshape(hi - lo, sizes[lo])))
                    n, lo = n + hi - lo, hi
                    if n == block_rows:
                        yield block(key, parts)
                        parts, n = [], 0
        if n:
            yield block(key, parts)

    dealt = rows.withColumn("dim", F.size("x")).repartitionByRange("label", "dim", F.xxhash64("vec_id"))
    dealt = dealt.sortWithinPartitions("label", "dim", "vec_id").select("vec_id", "label", "x")
    dealt.mapInArrow(pack, BLOCK).write.option("maxRecordsPerFile", 1).parquet(f"{folder}/blocks")
    blocks = rows.sparkSession.read.schema(BLOCK).parquet(f"{folder}/blocks")
    blocks.select("label", "dim", "top", "low", F.input_file_name().alias("file")).write.parquet(f"{folder}/table")


def _table(folder: str):
    """Rows (label, dim, top, low, file) of the table of blocks, some at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    where, path = filesystem(f"{folder}/table")
    for f in sorted(i.path for i in where.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".parquet")):
        with where.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(1024):
                yield from batch.to_pylist()


class Lists:
    """A block in memory."""

    def __init__(self, file: str, dim: int):
        import pyarrow.parquet as pq

        where, path = filesystem(file)
        with where.open_input_file(path) as f:
            row = pq.read_table(f, columns=["ids", "x", "lists"]).to_pylist()[0]
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(row["x"], np.int64).reshape(n, dim)
        self.lists = np.frombuffer(row["lists"], np.uint16 if n <= 1 << 16 else np.uint32).reshape(dim, n)
        self.most = int(np.abs(self.x).max(initial=0))
        self.kept: dict = {}

    def exact(self, a_most: int):
        """The vectors in a type in which all scores are exact."""
        kind = exact_kind(self.x.shape[1] * a_most * self.most)
        if kind not in self.kept:
            self.kept[kind] = self.x.astype(kind)
        return self.kept[kind], kind

    def scan(self, anchor: np.ndarray, a_most: int, need, take, step: int = 64) -> None:
        """Give the rows of the block and their scores to ``take(ids, scores)`` in the order in which the
        lists show them, until no other row can score ``need()``."""
        x, kind = self.exact(a_most)
        a, n = anchor.astype(kind), len(x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down):  # every row scores 0
            take(self.ids, np.zeros(n, np.int64))
            return
        seen, whole, lo = np.zeros(n, bool), None, 0
        while True:
            hi = min(n, max(step, 2 * lo))
            met = np.zeros(n, bool)
            met[self.lists[up, n - hi:n - lo].ravel()] = True
            met[self.lists[down, lo:hi].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            if len(new):
                if whole is None and len(new) > n // 8:
                    whole = x @ a  # cheaper than looking them up one by one
                take(self.ids[new], (x[new] @ a if whole is None else whole[new]).astype(kind if kind is object else np.int64))
            left = a[up] @ x[self.lists[up, n - hi], up] + a[down] @ x[self.lists[down, hi - 1], down]
            if hi == n or left < need() or seen.all():
                return
            lo = hi


def exact_kind(most: int):
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


class Best:
    """The ``k`` best of the (id, score) offered, scores down, then ids up, between two scores."""

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self):
        """A score strictly below this changes nothing."""
        return self.scores[-1] if len(self.ids) == self.k else self.low if self.low is not None else -float("inf")

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor()
        if self.high is not None:
            good &= scores <= self.high
        at = np.flatnonzero(good)
        if not len(at):
            return
        ids, scores = ids[at], scores[at]
        if len(at) > 4 * self.k and scores.dtype != object:
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[-self.k])
            ids, scores = ids[at], scores[at]
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        at = sorted(range(len(ids)), key=lambda i: (-int(scores[i]), int(ids[i])))[: self.k]
        self.ids, self.scores = ids[at], scores[at]


def mine(rows: DataFrame, anchors: DataFrame, folder: str, positives: int, negatives: int, low: int, high: int,
         scale: int, chunk_rows: int) -> DataFrame:
    """The negatives of ``anchors`` (vec_id, label, x) out of the blocks in ``folder``."""

    def search(batches):
        import pyarrow as pa

        def visit(chunk, of_label, holders):
            """Every anchor of the chunk goes through the blocks of its own (or of any other) label."""
            for row in _table(folder):
                dim, block = row["dim"], None
                top, least = np.array(row["top"], np.int64), np.array(row["low"], np.int64)
                most = max(np.abs(top).max(initial=0), np.abs(least).max(initial=0))
                for c in chunk:
                    if len(c["x"]) != dim or (c["label"] == row["label"]) != of_label or not c[holders]:
                        continue
                    kind = exact_kind(dim * c["most"] * int(most))
                    a = c["x"].astype(kind)
                    reach = np.maximum(a * top.astype(kind), a * least.astype(kind)).sum()
                    need = lambda c=c: min(h.floor() for h in c[holders])
                    if reach < need():
                        continue
                    block = block or Lists(row["file"], dim)

                    def take(ids, scores, c=c):
                        other = ids != c["id"]
                        for h in c[holders]:
                            h.offer(ids[other], scores[other])

                    block.scan(c["x"], c["most"], need, take)

        for b in batches:
            for lo in range(0, b.num_rows, chunk_rows):
                chunk = []
                for key, label, x in zip(*(v.to_pylist() for v in b.slice(lo, chunk_rows).columns), strict=True):
                    x = scaled(np.array(x, np.float64), scale)
                    chunk.append({"id": key, "label": label, "x": x, "most": int(np.abs(x).max(initial=0)), "same": [Best(positives)], "windows": []})
                visit(chunk, True, "same")
                for c in chunk:
                    # low * p <= 100 * s <= high * p, both ends as integers
                    ends = [(-(-low * int(p) // 100), high * int(p) // 100) for p in c["same"][0].scores]
                    c["all"] = [Best(negatives, *e) if e[0] <= e[1] else None for e in ends]
                    c["windows"] = [w for w in c["all"] if w]
                visit(chunk, False, "windows")
                out = [(c["id"], int(p), k, int(i), int(s), int(t)) for c in chunk
                       for p, s, w in zip(c["same"][0].ids, c["same"][0].scores, c["all"], strict=True) if w
                       for k, (i, t) in enumerate(zip(w.ids, w.scores, strict=True), 1)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)],
                                                 ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return anchors.mapInArrow(search, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, scale: int = 256,
                   block_rows: int = 16384, chunk_rows: int | None = None, folder: str | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors``
    (vec_id, label, embedding) whose id is a multiple of ``every``, against all rows.

    Rows without an id or a label, without a vector, or with a component that is missing or not finite take no
    part.  Components become floor(scale * x); the score of a row is its scalar product with the anchor,
    higher first, ties by the smaller id.  An anchor's positives are its first rows of the same label, its
    negatives for each of them the first rows of other labels with low <= 100 * score / positive score <= high
    (with a negative positive score there are none).  Rows with the anchor's own id are never its positives;
    repeated rows count as rows.  Vectors of different lengths are not compared.  An empty table gives no row;
    other columns are ignored.  A score or component too large for 64 bits is an error."""
    rows = taking_part(vectors)
    spark = vectors.sparkSession
    folder = folder or work_dir(spark, "negatives")
    store_lists(rows, folder, scale, block_rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    anchors = stored(anchors, f"{folder}/anchors")
    n = anchors.count()
    # as many anchors for one pass over the blocks as leave work for all cores
    chunk = chunk_rows or min(1024, max(32, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    return mine(rows, anchors.repartition(max(1, -(-n // chunk)), "vec_id"), folder, positives, negatives, low, high, scale, chunk)

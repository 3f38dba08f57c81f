"""Byte-level convolutional network that scores whole documents, in numpy.

A document is its UTF-8 bytes.  Every byte has a learned vector; learned filters look at
8 bytes from every fourth byte on.  Their mean responses over chunks of 256 bytes, which
begin every 128 bytes and so overlap and cover the whole document, and the squares of these
go to a second layer of learned filters; the largest response of each over all chunks goes into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvid.llm.shared import give_back, giving_back, stored, work_dir

DIM, HOP, FILTERS, CHUNK_FILTERS = 8, 4, 32, 32
HALF = 32  # places of the first layer in half a chunk
PIECE = 1 << 18  # bytes looked at together; a multiple of the bytes in half a chunk


class ByteNet:
    SHAPES = {"embed": (256, DIM), "conv": (2 * HOP * DIM, FILTERS), "bias": (FILTERS,), "chunk": (2 * FILTERS, CHUNK_FILTERS),
              "chunk_bias": (CHUNK_FILTERS,), "out": (CHUNK_FILTERS,), "c": (1,)}

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def new(cls, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        scale = {"embed": 0.5, "conv": 0.15, "chunk": 0.3, "out": 0.1}
        return cls({k: (rng.normal(0, scale[k], n) if k in scale else np.zeros(n)).astype("f4") for k, n in cls.SHAPES.items()})

    def dump(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).astype("<f4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> ByteNet:
        flat, p = np.frombuffer(data, "<f4"), {}
        for k, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            p[k], flat = flat[:n].reshape(shape), flat[n:]
        return cls(p)

    def _forward(self, docs: list[bytes]):
        """First layer, half chunks and chunks of some documents, each filled up with zeros
        to whole rows of HOP bytes, and to two rows at least."""
        rows = np.array([max(2, -(-len(d) // HOP)) for d in docs])
        flat = np.frombuffer(b"".join(d.ljust(n * HOP, b"\0") for d, n in zip(docs, rows.tolist(), strict=True)), np.uint8)
        x = self.p["embed"][flat].reshape(-1, HOP * DIM)
        w = HOP * DIM
        z = x[:-1] @ self.p["conv"][:w]
        z += x[1:] @ self.p["conv"][w:]
        z += self.p["bias"]
        np.maximum(z, 0, out=z)
        # halves of each document's places; its last row is where no place begins
        first, places = np.cumsum(rows) - rows, rows - 1
        n_half = -(-places // HALF)
        doc_of = np.repeat(np.arange(len(docs)), n_half)
        rank = np.arange(len(doc_of)) - np.repeat(np.cumsum(n_half) - n_half, n_half)
        lo = first[doc_of] + rank * HALF
        hi = np.minimum(lo + HALF, first[doc_of] + places[doc_of])
        bounds = np.stack([lo, hi], 1).ravel()
        sums = np.add.reduceat(z, bounds[:-1] if bounds[-1] >= len(z) else bounds, axis=0)[::2]
        # a chunk is a half and the next; the last half begins one only where it is alone
        begin = np.flatnonzero((rank < n_half[doc_of] - 1) | (n_half[doc_of] == 1))
        pair = n_half[doc_of[begin]] > 1
        nxt = np.where(pair, begin + 1, begin)
        size = ((hi - lo)[begin] + np.where(pair, (hi - lo)[nxt], 0)).astype("f4")
        mean = (sums[begin] + np.where(pair[:, None], sums[nxt], 0)) / size[:, None]
        seen = np.concatenate([mean, mean * mean], axis=1)  # squares: how far a chunk lies from the usual, whichever way
        return {"flat": flat, "x": x, "z": z, "lo": lo, "hi": hi, "begin": begin, "next": nxt, "pair": pair, "size": size, "seen": seen,
                "chunk": seen @ self.p["chunk"], "first": np.searchsorted(doc_of[begin], np.arange(len(docs)))}

    def pooled(self, docs: list[bytes]) -> np.ndarray:
        """The largest response of each chunk filter in each document."""
        half = HALF * HOP
        pieces, owner = [], []
        for i, d in enumerate(docs):  # a long document in pieces that repeat the last half of the one before
            for lo in range(0, max(1, len(d) - half - HOP), PIECE):
                pieces.append(d[lo:lo + PIECE + half + HOP])
                owner.append(i)
        out = np.full((len(docs), CHUNK_FILTERS), -np.inf, "f4")
        for lo, hi in runs(np.array([len(p) for p in pieces], np.int64), PIECE):
            f = self._forward(pieces[lo:hi])
            np.maximum.at(out, np.array(owner[lo:hi]), np.maximum.reduceat(f["chunk"], f["first"], axis=0))
        return out

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(pooled + self.p["chunk_bias"], 0)
        return h, 1 / (1 + np.exp(-np.clip(h.astype("f8") @ self.p["out"].astype("f8") + float(self.p["c"][0]), -500, 500)))

    def score(self, docs: list[bytes]) -> np.ndarray:
        return self._head(self.pooled(docs))[1]

    def grads(self, docs: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        f, p = self._forward(docs), self.p
        ends = [*f["first"][1:], len(f["chunk"])]
        at = np.stack([f["chunk"][a:b].argmax(axis=0) + a for a, b in zip(f["first"], ends, strict=True)])  # documents x chunk filters
        h, prob = self._head(np.take_along_axis(f["chunk"], at, 0))
        d = ((prob - y) / len(y)).astype("f4")
        dh = d[:, None] * p["out"] * (h > 0)
        dchunk = np.zeros_like(f["chunk"])
        np.add.at(dchunk, (at, np.arange(CHUNK_FILTERS)[None]), dh)
        dseen = dchunk @ p["chunk"].T
        dmean = (dseen[:, :FILTERS] + 2 * f["seen"][:, :FILTERS] * dseen[:, FILTERS:]) / f["size"][:, None]
        dhalf = np.zeros((len(f["lo"]), FILTERS), "f4")
        dhalf[f["begin"]] += dmean
        dhalf[f["next"][f["pair"]]] += dmean[f["pair"]]
        dz = np.zeros_like(f["z"])
        n = f["hi"] - f["lo"]
        place = np.repeat(f["lo"] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        dz[place] = np.repeat(dhalf, n, axis=0)
        dz *= f["z"] > 0
        w = HOP * DIM
        dx = np.zeros_like(f["x"])
        dx[:-1] += dz @ p["conv"][:w].T
        dx[1:] += dz @ p["conv"][w:].T
        dx = dx.reshape(-1, DIM)
        return {"embed": np.stack([np.bincount(f["flat"], dx[:, k], 256) for k in range(DIM)], 1),
                "conv": np.concatenate([f["x"][:-1].T @ dz, f["x"][1:].T @ dz]), "bias": dz.sum(0), "chunk": f["seen"].T @ dchunk,
                "chunk_bias": dh.sum(0), "out": h.T @ d, "c": np.array([d.sum()])}


def fit_net(docs: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the logistic loss, with a rate that falls to zero."""
    net = ByteNet.new(seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    steps, t = epochs * -(-len(docs) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            g = net.grads([docs[i] for i in some], labels[some])
            t += 1
            lr = rate * min(1.0, t / 50) * (1 - t / (steps + 1))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                net.p[k] = (net.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype("f4")
    return net


def constant_net(logit: float) -> bytes:
    """A network that gives every text the same score."""
    net = ByteNet.new(0)
    net.p["out"] *= 0
    net.p["c"][0] = logit
    return net.dump()


def held_out(doc_id) -> F.Column:
    """Rows that never take part in learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitting(heads: list, rows: list, most: int, kind: str, column: str) -> list:
    """The rows (doc_id, size, ...) that hold ``most`` bytes together, in their order; one that does not
    fit any more is passed over.  ``heads``, the first of each ``kind``, go first and all have to fit."""
    out, ids = [], set()
    for r in [*sorted(heads, key=lambda r: r["size"]), *rows]:
        if r["doc_id"] in ids:
            continue
        if r["size"] <= most:
            out.append(r)
            ids.add(r["doc_id"])
            most -= r["size"]
        elif len(ids) < len(heads):
            raise ValueError(f"no text of {kind} {r[column]} fits into the sample: the shortest left has {r['size']} bytes of {most} free")
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 2400, sample_bytes: int = 12 << 20) -> bytes:
    """The network as bytes, learned in one task from a bounded sample of labelled rows.

    ``docs`` (doc_id, text) are joined with ``labels`` (doc_id, ``label``); held-out rows, null
    ids and null labels are left out.  The sample holds up to ``sample_rows`` rows, half of
    them of each label where there are enough, with their whole texts, in turn of both labels
    and by a hash of the id.  A row that no longer fits into ``sample_bytes`` is passed over;
    texts of more than a sixteenth of that come after the others, the shortest first.  A label
    that occurs has a row, or there is an error.  A null text is empty.  Without rows of
    both labels the network is the one of the untrained start, with the labels' mean.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.withColumn("place", F.xxhash64("doc_id", F.lit("fit"))).dropDuplicates(["doc_id"])
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"))
    sized = stored(known.join(sizes, "doc_id"), f"{work_dir(docs.sparkSession, 'sample')}/sized")
    heads, short, long = [], [], []
    for c in (F.col("y") > 0, F.col("y") <= 0):
        fit_in = F.col("size") <= sample_bytes // 16
        some = sized.where(c & fit_in).orderBy("place", "doc_id").limit(sample_rows // 2).collect()
        rest = sized.where(c & ~fit_in).orderBy("size", "place", "doc_id").limit(sample_rows // 2 - len(some)).collect()
        heads += (some + rest)[:1]
        short += enumerate(some)
        long += enumerate(rest)
    turns = [r for part in (short, long) for _, r in sorted(part, key=lambda x: x[0])]
    picked = fitting(heads, turns, sample_bytes, "label", "y")
    if not picked:
        return constant_net(0.0)
    sample = docs.join(F.broadcast(docs.sparkSession.createDataFrame(picked, sized.schema).drop("size")), "doc_id")

    def fit(batches):
        import pyarrow as pa

        rows = sorted((place, text.encode(), y) for b in batches for place, text, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        kept = [(text, float(y > 0)) for _, text, y in rows]
        labels = np.array([y for _, y in kept], "f4")
        if 0 < labels.sum() < len(labels):
            net = fit_net([t for t, _ in kept], labels)
        else:
            yield pa.RecordBatch.from_pydict({"net": pa.array([constant_net(4.0 * (2 * labels.mean() - 1) if len(labels) else 0.0)], pa.binary())})
            return
        yield pa.RecordBatch.from_pydict({"net": pa.array([net.dump()], pa.binary())})

    row = sample.select("place", "text", "y").repartition(1).mapInArrow(giving_back(fit), "net binary").first()
    return constant_net(0.0) if row is None else bytes(row[0])


def score(docs: DataFrame, net: bytes, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of the whole ``text`` (null: as empty) in a
    new column, row by row, without a shuffle."""
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    names = docs.columns

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        model = ByteNet.load(net)
        k = names.index("text")
        for b in batches:
            texts = pc.cast(b.column(k).fill_null(""), pa.binary())
            out = []
            for lo, hi in runs(pc.binary_length(texts).to_numpy(), 8 << 20):
                out.append(model.score(texts.slice(lo, hi - lo).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.empty(0))], [*names, column])

    return docs.mapInArrow(giving_back(run), schema)


def runs(sizes: np.ndarray, most: int):
    """(from, to) of runs of neighbours whose sizes add up to ``most`` at the most, or of one."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns as they were.  Only the
    texts go to the tasks' Python, and only the scores come back."""
    net = train(docs, labels)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = ByteNet.load(net)
        for texts in batches:
            raw = [t.encode() for t in texts]
            out = [model.score(raw[lo:hi]) for lo, hi in runs(np.array([len(t) for t in raw], np.int64), 8 << 20)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))
        give_back()

    return docs.where(scores(F.coalesce("text", F.lit(""))) >= threshold)

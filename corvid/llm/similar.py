"""Exact Jaccard join of documents on word n-grams, with prefix filtering, rarest first.

1. Every document is read once for its set of n-gram hashes: the set's size and hash (rows
   with equal sets are one class from here on), and counts of all n-grams in a fixed
   number of hash buckets, which give the order from rare to frequent.
2. Of each class the n-grams of its prefix, the rarest ones, become postings.  Two sets
   with the asked similarity share one of them; the first one they share passes the
   length filter and the positional filter.
3. Classes that share a prefix n-gram are paired: all with all where they are few; where
   they are many, each with the one in which the n-gram stands first and with its neighbours.
4. Each pair is verified once.  Bitmaps of the sets' parities, a few bits an n-gram, go first: bits
   that differ bound what the two sets do not share.  Only the sets of pairs that pass are
   read and compared, after a suffix filter.
5. N-grams of many classes that the links so far do not connect are looked at again: first the
   best class of each component with the best of all, which is linear, until nothing more is
   joined; then every pair in different components, so nothing is lost and a large group of
   near copies is never paired out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.graph import components
from corvid.llm.shared import giving_back, may_hold, pick, stored, work_dir

BITS = 22  # buckets of the n-gram counts
CHUNK_BITS = 16
FEW = 16  # classes of an n-gram that are paired all with all
HOT_CLASS = 12  # n-grams in more than 2 ** this documents are dealt to several tasks
_BASE = 0x9E3779B97F4A7C15 | 1

POSTINGS = "token long, salt int, spread int, set long, n int, pos int"


class Hasher:
    """Hashes of the n-grams of a text, by prefix sums over its bytes."""

    def __init__(self, n: int):
        self.n = n
        self.table = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
        self._grow(1 << 16)

    def _grow(self, size: int):
        base, inverse = (np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        base[0] = inverse[0] = 1
        self.power, self.inverse = np.cumprod(base), np.cumprod(inverse)

    def _hash(self, text: bytes, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words of a text with single blanks between its words."""
        x = np.frombuffer(text, np.uint8)
        if len(x) + 1 > len(self.power):
            self._grow(2 * len(x))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.table[x] * self.power[: len(x)], out=sums[1:])
        cut = np.flatnonzero(x == 32)
        start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(x)]])
        start, end = start[: len(start) - n + 1], end[n - 1:]
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def grams(self, text: str) -> np.ndarray:
        """The distinct hashes in ascending order: of all runs of n words, or of the whole
        text where it has fewer; none without words.  Words are runs without ASCII white
        space, A-Z in lower case."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        n, step = min(self.n, len(words)), 200_000
        parts = [self._hash(b" ".join(words[lo:lo + step + n - 1]), n) for lo in range(0, max(1, len(words) - n + 1), step)]
        return np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))


def set_hash(grams: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two hashes of a set, the first of ``bits`` bits (fewer in tests only)."""
    from hashlib import blake2b

    first, second = np.frombuffer(blake2b(grams.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return first >> (64 - bits), second


def set_key(grams: np.ndarray, twins: frozenset[int], bits: int) -> int:
    """The first hash, or the second where different sets have the same first one (``twins``)."""
    first, second = set_hash(grams, bits)
    return second if first in twins else first


def parities(grams: np.ndarray) -> bytes:
    """For each of 2 ** k slots, two or more for every n-gram, whether an odd number of them fall there."""
    slots = 1 << max(6, int(2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """N-grams in one of two sets only: at least as many as there are slots whose parities differ.
    The longer bitmap is folded to the length of the shorter."""
    a, b = sorted((np.frombuffer(v, np.uint8) for v in (x, y)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _read_sets(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """A row (doc_id, n, set, check, odd) for each document (``odd``: its parities), and rows
    (chunk, counts) with the n-gram counts of each task."""

    def read(batches):
        import zlib

        import pyarrow as pa

        hasher, counts = Hasher(n), np.zeros(1 << BITS, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set", pa.int64()), ("check", pa.int64()), ("odd", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
        for b in batches:
            size, first, second, odd, slots, waiting = [], [], [], [], [], 0
            for text in b.column(1).to_pylist():
                g = hasher.grams(text)
                size.append(len(g))
                h = set_hash(g, bits)
                first.append(h[0])
                second.append(h[1])
                odd.append(parities(g))
                slots.append((g >> np.uint64(64 - BITS)).astype(np.int64))
                waiting += len(g)
                if waiting > 1 << 21:
                    counts += np.bincount(np.concatenate(slots), minlength=1 << BITS).astype(np.uint32)
                    slots, waiting = [], 0
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=1 << BITS).astype(np.uint32)
            none = pa.nulls(len(size))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(odd, pa.binary()),
                                              none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        parts = [(k, x) for k, x in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)) if x.any()]
        for k, x in parts:
            yield pa.RecordBatch.from_pylist([{"chunk": k, "counts": zlib.compress(x.tobytes(), 1)}], schema=schema)

    return docs.mapInArrow(giving_back(read), "doc_id long, n int, set long, check long, odd binary, chunk int, counts binary")


def _frequency_classes(counted: DataFrame) -> np.ndarray:
    """For each bucket the logarithm of its count above that of the usual bucket.  The counts
    of all tasks are added up in a stream, chunk by chunk; the driver gets 4 bytes a bucket."""

    def add(batches):
        import zlib

        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), np.uint32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.uint64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "logs": [np.log2(1 + x.astype("f4")).astype("<f4").tobytes()]})

    chunks = 1 << (BITS - CHUNK_BITS)
    rows = counted.where("chunk is not null").select("chunk", "counts").repartition(chunks, "chunk").mapInArrow(giving_back(add), "chunk int, logs binary").collect()
    counts = np.zeros((chunks, 1 << CHUNK_BITS), "f4")
    for k, data in rows:
        counts[k] = np.exp2(np.frombuffer(data, "<f4")) - 1
    return np.log2(1 + np.maximum(0, counts - np.median(counts))).astype(np.uint8).ravel()


def _least(n, percent: int):
    """The least overlap of a set of ``n`` with any similar one."""
    return (percent * n + 99) // 100


def _postings(docs: DataFrame, n: int, percent: int, classes, twins: frozenset[int], bits: int) -> DataFrame:
    def read(batches):
        import pyarrow as pa

        hasher, order = Hasher(n), classes.value
        done: set[int] = set()  # the classes of this task: equal sets are posted once
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(0).to_pylist():
                g = hasher.grams(text)
                if not len(g) or (h := set_key(g, twins, bits)) in done:
                    continue
                done.add(h)
                rank = order[g >> np.uint64(64 - BITS)]
                size = len(g)
                first = np.argsort(rank, kind="stable")[: size - _least(size, percent) + 1]
                spread = 1 << np.maximum(rank[first].astype(np.int64) - HOT_CLASS, 0)
                for c, x in zip(cols, (g[first].view(np.int64), (h & 0x7FFFFFFF) & (spread - 1), spread, np.full(len(first), h),
                                       np.full(len(first), size), np.arange(len(first))), strict=True):
                    c.append(x)
            if cols[0]:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t, safe=False) for c, t in zip(cols, kinds, strict=True)],
                                                 ["token", "salt", "spread", "set", "n", "pos"])

    return docs.select("text").mapInArrow(giving_back(read), POSTINGS)


def _may_link(na, pa, nb, pb, percent: int):
    """Length filter, and positional filter for the first n-gram two sets share."""
    need = (percent * (na + nb) + 99 + percent) // (100 + percent)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pa, nb - pb) >= need)


def _pair(postings: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) of sets to verify, and rows (token, set, n, pos) of n-grams to join again."""

    def run(batches):
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        token, salt, spread, ids, n, pos = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(6))
        del got
        order = np.lexsort((ids, n, salt, token))
        token, salt, spread, ids, n, pos = (x[order] for x in (token, salt, spread, ids, n, pos))
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        twice = np.concatenate([[False], same & (ids[1:] == ids[:-1])])
        token, salt, spread, ids, n, pos = (x[~twice] for x in (token, salt, spread, ids, n, pos))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
        size = np.diff(np.concatenate([begin, [len(token)]]))
        run_of = np.repeat(np.arange(len(begin)), size)
        many = (size > FEW)[run_of]
        found = []

        def try_pairs(i, j):
            ok = _may_link(n[i], pos[i], n[j], pos[j], percent) & (ids[i] != ids[j])
            if ok.any():
                x, y = ids[i[ok]], ids[j[ok]]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))

        for d in range(1, FEW):
            i = np.flatnonzero((run_of[d:] == run_of[:-d]) & (~many[d:] | (d <= 2)))
            if not len(i):
                break
            try_pairs(i, i + d)
        if many.any():
            best = np.lexsort((ids, pos, run_of))[begin]  # the set in which the n-gram stands first
            i = np.flatnonzero(many)
            try_pairs(i, best[run_of[i]])
        # an n-gram dealt to several tasks is joined again wherever one of its sets may meet another
        back = many | (spread > 1)
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
        if found:
            ab = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ab[:, 0]), pa.array(ab[:, 1]), *(pa.nulls(len(ab), t.type) for t in list(schema)[2:])], schema=schema)
        if back.any():
            k = int(back.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(token[back]), pa.array(ids[back]),
                                              pa.array(n[back], pa.int32()), pa.array(pos[back], pa.int32())], schema=schema)

    return postings.repartition("token", "salt").mapInArrow(giving_back(run), "a long, b long, token long, set long, n int, pos int")


def _grams(docs: DataFrame, nodes: DataFrame, n: int, twins: frozenset[int], bits: int) -> DataFrame:
    """(set, grams): the sets of the classes in ``nodes`` (set, id), read from one document each."""
    docs = docs.where(F.col("doc_id").isNotNull())
    docs = docs.where(may_hold(nodes, "id")(F.col("doc_id")))  # other texts stay where they are
    rows = docs.join(nodes, docs["doc_id"] == nodes["id"]).select("set", "text")

    def read(batches):
        import pyarrow as pa

        hasher = Hasher(n)
        for b in batches:
            out = [(h, g.tobytes()) for h, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if set_key(g := hasher.grams(text), twins, bits) == h]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([g for _, g in out], pa.binary())], ["set", "grams"])

    return rows.mapInArrow(giving_back(read), "set long, grams binary").dropDuplicates(["set"])


def _too_different(x: np.ndarray, y: np.ndarray, need: int, parts: int = 8) -> bool:
    """Suffix filter: both sets are cut at the same values of one; in each part the smaller
    side bounds what they can share."""
    cuts = x[np.arange(1, parts) * len(x) // parts]
    a, b = (np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])) for s in (x, y))
    return int(np.minimum(a, b).sum()) < need


def _close(pairs: DataFrame, odd: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities leave room for the asked similarity.  ``odd``: (set, n, odd)."""
    x, y = (odd.select(F.col("set").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}")) for k in "ab")
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "oa", "ob")

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for na, nb, oa, ob in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                need = -(-percent * (na + nb) // (100 + percent))
                keep.append(least_difference(oa, ob) <= na + nb - 2 * need)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(giving_back(check), "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()


def _verify(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets with 100 * intersection >= percent * union."""
    ga, gb = (grams.select(F.col("set").alias(k), F.col("grams").alias(f"g{k}")) for k in "ab")
    rows = pairs.join(ga, "a").join(gb, "b").select("a", "b", "ga", "gb")

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if _too_different(x, y, need):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) >= need)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(giving_back(check), "a long, b long")


def _stars(again: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Of each n-gram of many sets, each component's best set (the one in which the n-gram
    stands first) paired with the best of all: one row for each component and n-gram."""
    best = F.min(F.struct("pos", "n", "set"))
    reps = again.join(labels, "set").groupBy("token", "c").agg(best.alias("r"))
    hubs = reps.groupBy("token").agg(F.min("r").alias("h"), F.count("*").alias("parts")).where("parts > 1")
    near = _filters(*[F.col(k) for k in ("r.n", "r.pos", "h.n", "h.pos")], percent)
    pairs = reps.join(hubs, "token").where((F.col("r.set") != F.col("h.set")) & near)
    return pairs.select(F.least("r.set", "h.set").alias("a"), F.greatest("r.set", "h.set").alias("b")).distinct()


def _filters(nx, px, ny, py, percent: int):
    """``_may_link`` for columns."""
    need = F.floor((percent * (nx + ny) + 99 + percent) / (100 + percent))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (F.least(nx - px, ny - py) >= need)


def _rejoin(again: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share an n-gram of many sets, pass the filters, and lie in different
    components.  ``labels``: (set, c).  Of each n-gram, sets outside its largest component meet the others."""
    rows = again.join(labels, "set")
    tops = rows.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(
        F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rows = rows.join(tops, "token")
    x, y = (rows.select("token", *[F.col(k).alias(f"{k}_{side}") for k in ("set", "n", "pos", "c", "top")]) for side in "xy")
    near = _filters(*[F.col(k) for k in ("n_x", "pos_x", "n_y", "pos_y")], percent)
    pairs = x.where("c_x <> top_x").join(y, "token").where((F.col("c_x") != F.col("c_y")) & ((F.col("c_y") == F.col("top_y")) | (F.col("set_x") < F.col("set_y"))) & near)
    return pairs.select(F.least("set_x", "set_y").alias("a"), F.greatest("set_x", "set_y").alias("b")).distinct()


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, folder: str | None = None, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of distinct word
    ``n``-grams (the whole text as one where it has fewer words); component_id is the smallest
    doc_id that links lead to.  A null or empty text has an empty set, which links with
    nothing.  A row with a null doc_id is not linked; its component_id is that of the rows
    with an equal set, or else null.  Rows that share a doc_id are one node.  Other columns
    are ignored.  ``bits``: of the first of a set's two hashes; the second one takes its place
    for sets that share the first.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "similar")
    docs = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = stored(_read_sets(docs, n, bits), f"{folder}/read")
    sets = read.where("chunk is null").select("doc_id", "n", "set", "check", "odd")
    # different sets with the same first hash (some only from 5e9 sets on) go by their second one
    met = sets.where("n > 0").groupBy("set").agg(F.min("check").alias("low"), F.max("check").alias("high"),
                                                 F.min("doc_id").alias("id"), F.max("n").alias("n"))
    met = stored(met, f"{folder}/met")
    double = stored(met.where("low <> high").select("set"), f"{folder}/double")
    twins = frozenset(r[0] for r in double.toLocalIterator())
    if twins:
        sets = sets.join(F.broadcast(double.withColumn("twin", F.lit(True))), "set", "left").select(
            "doc_id", "n", F.when(F.col("twin"), F.col("check")).otherwise(F.col("set")).alias("set"), "check", "odd")
        met = stored(sets.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.min("check").alias("low"),
                                                            F.max("check").alias("high")), f"{folder}/met-again")
        if met.where("low <> high").limit(1).count():
            raise ValueError("different sets have the same hash of 128 bits")
    classes = met.where("id is not null").select("set", "id")
    order = spark.sparkContext.broadcast(_frequency_classes(read))
    found = stored(_pair(_postings(docs, n, percent, order, twins, bits), percent), f"{folder}/found")
    pairs = stored(found.where("a is not null").select("a", "b").distinct(), f"{folder}/pairs")
    again = found.where("token is not null").select("token", "set", "n", "pos")

    def verified(pairs: DataFrame, at: str) -> DataFrame:
        """The links (u, v), as document ids, among ``pairs``: whole sets are read of those only that may link."""
        nodes = _ends(pairs).join(classes, "set")
        odd = nodes.join(sets.select(F.col("set").alias("own"), "doc_id", "n", "odd"), (F.col("set") == F.col("own")) & (F.col("id") == F.col("doc_id")))
        near = stored(_close(pairs, odd.select("set", "n", "odd").dropDuplicates(["set"]), percent), f"{at}/near")
        if not near.limit(1).count():
            return spark.createDataFrame([], "u long, v long")
        nodes = stored(_ends(near).join(classes, "set"), f"{at}/nodes")
        grams = stored(_grams(docs, nodes, n, twins, bits), f"{at}/grams")
        return stored(_by_id(_verify(near, grams, percent), classes), f"{at}/links")

    links = verified(pairs, f"{folder}/first")
    joined = stored(_labels(classes, components(links, f"{folder}/comps")), f"{folder}/labels")
    # first the components' best sets until that joins no more, then every pair that is left
    step, last = 0, False
    while not last:
        step, at = step + 1, f"{folder}/again{step + 1}"
        labels = joined.select("set", "c")
        more = stored(_stars(again, labels, percent).join(pairs, ["a", "b"], "left_anti"), f"{at}/pairs")
        if not (extra := verified(more, f"{at}/stars")).limit(1).count():
            last, pairs = True, pairs.unionByName(more)
            more = stored(_rejoin(again, labels, percent).join(pairs, ["a", "b"], "left_anti"), f"{at}/rest")
            if not (extra := verified(more, f"{at}/others")).limit(1).count():
                break
        links, pairs = links.unionByName(extra), pairs.unionByName(more)
        joined = stored(_labels(classes, components(links, f"{at}/comps")), f"{at}/labels")
    rows = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set").join(joined.select("set", "c"), "set", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _by_id(links: DataFrame, classes: DataFrame) -> DataFrame:
    u, v = (classes.select(F.col("set").alias(k), F.col("id").alias(i)) for k, i in (("a", "u"), ("b", "v")))
    return links.join(u, "a").join(v, "b").select("u", "v")


def _labels(classes: DataFrame, comps: DataFrame) -> DataFrame:
    return classes.join(comps, "id", "left").select("set", "id", F.coalesce("component", "id").alias("c"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id, all columns as
    they were; rows with empty sets or null ids stay, rows that repeat a kept id go."""
    folder = work_dir(docs.sparkSession, "near")
    found = stored(similar_components(docs, n, percent, f"{folder}/similar"), f"{folder}/components")
    linked = found.where("n_shingles > 0 and doc_id is not null").withColumnRenamed("doc_id", "id")
    gone = stored(linked.where("component_id <> id").select("id").distinct(), f"{folder}/gone")
    mark = "may_go"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.col("doc_id").isNotNull() & may_hold(gone, "id")(F.coalesce("doc_id", F.lit(0))))
    doubtful = marked.where(mark)  # other rows stay where they are
    kept = marked.where(~F.col(mark)).unionByName(doubtful.join(gone, doubtful["doc_id"] == gone["id"], "left_anti")).drop(mark)
    repeated = stored(linked.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), f"{folder}/repeated")
    if not repeated.limit(1).count():
        return kept
    twice = kept.join(repeated, kept["doc_id"] == repeated["id"], "left_semi")
    return kept.join(repeated, kept["doc_id"] == repeated["id"], "left_anti").unionByName(twice.dropDuplicates(["doc_id"]))

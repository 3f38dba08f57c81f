"""Repeated byte strings of the corpus, by interval trees over sorted suffixes at anchors.

Every string of ``length`` bytes holds an anchor: a place whose ``k`` bytes have the smallest
hash of all places in it, so equal strings have equal anchors at equal places.  The suffixes
that begin at places with equal anchors are compared with each other only: an enhanced
suffix array of each anchor (suffixes in order, with common-prefix lengths) is scanned with
a stack, which gives the tree of common-prefix intervals.  An interval holds all occurrences
of its prefix; how far they differ on the left says whether it can be extended, and by how
much each occurrence matches another one on both sides.

Occurrences that agree in everything ``length`` bytes around could tell are one class:
counted before the shuffle, and represented by one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import may_hold, stored, work_dir

LARGEST = 50_000  # classes of an anchor that one task compares as a tree
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1)


class Anchors:
    """Anchors of texts: places, hashes, and hashes of what lies around them."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k
        self.tables = np.random.default_rng(19980304).integers(0, 1 << 64, (2, 256), np.uint64)
        self._grow(1 << 17)

    def _grow(self, size: int):
        self.power, self.inverse = [], []
        for base in _BASES:
            for out, x in ((self.power, base), (self.inverse, pow(base, -1, 1 << 64))):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                out.append(np.cumprod(steps))

    def _sums(self, x: np.ndarray, which: int) -> np.ndarray:
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.tables[which][x] * self.power[which][: len(x)], out=sums[1:])
        return sums

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    @staticmethod
    def _sliding(op, a: np.ndarray, w: int, fill) -> np.ndarray:
        """``op`` over every ``w`` neighbours."""
        n = len(a)
        blocks = np.concatenate([a, np.full(-n % w, fill, a.dtype)]).reshape(-1, w)
        ahead = op.accumulate(blocks, axis=1).ravel()
        behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return op(behind[: n - w + 1], ahead[w - 1: n])

    def _needed(self, x: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which anchors of a text are needed.  In a stretch that repeats a short period many
        places tie for the smallest hash.  A string of ``length`` bytes that reaches over an
        end of the stretch holds its first or its last anchor, and equal strings the same one;
        those in between are left out.  A stretch of ``length`` bytes or more holds such
        strings as a whole: there all anchors near both ends stay, and in between, where
        every string equals one near the ends, enough to cover it."""
        keep = np.ones(len(at), bool)
        tied = (h[1:] == h[:-1]) & (at[1:] - at[:-1] <= self.k // 2)
        if not tied.any():
            return keep
        edges = np.flatnonzero(np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8)))
        for first, last in zip(edges[::2], edges[1::2], strict=True):
            if last - first < 2:
                continue
            d = int(at[first + 1] - at[first])
            lo, hi = int(at[first]), int(at[last]) + self.k
            lo -= self._run(x[:lo][::-1], x[d:lo + d][::-1])
            hi += self._run(x[hi:], x[hi - d:len(x) - d])
            inner = at[first + 1:last]
            if hi - lo < self.length:
                keep[first + 1:last] = False
            else:
                near = self.length + 2 * d
                step = max(1, (self.length - self.k) // (2 * d))
                keep[first + 1:last] = (inner < lo + near) | (inner + self.k > hi - near) | ((inner - lo) // d % step == 0)
        return keep

    @staticmethod
    def _run(a: np.ndarray, b: np.ndarray, step: int = 512) -> int:
        """Length of the common beginning."""
        n = min(len(a), len(b))
        for lo in range(0, n, step):
            differ = np.flatnonzero(a[lo:min(n, lo + step)] != b[lo:min(n, lo + step)])
            if len(differ):
                return lo + int(differ[0])
        return n

    def find(self, text: bytes, most: int = 1 << 22):
        """(place, anchor, context, left, right) of all anchors of a text; a long text in
        pieces that overlap by as much as an anchor can depend on."""
        if len(text) < self.length:
            return None
        if len(text) <= most:
            return self._find(text, 0, len(text))
        parts = [self._find(text[max(0, lo - self.length): lo + most + 2 * self.length], max(0, lo - self.length), len(text))
                 for lo in range(0, len(text), most)]
        parts = [p for p in parts if p is not None]
        place, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        return (place, *(np.concatenate([p[i] for p in parts])[at] for i in range(1, 5)))

    def _find(self, piece: bytes, offset: int, size: int):
        if len(piece) < self.length:
            return None
        x = np.frombuffer(piece, np.uint8)
        if len(x) + 1 > len(self.power[0]):
            self._grow(2 * len(x))
        k, w = self.k, self.length - self.k + 1
        sums = self._sums(x, 0)
        h = self._mix((sums[k:] - sums[:-k]) * self.inverse[0][: len(x) - k + 1])
        low = self._sliding(np.minimum, h, w, np.uint64(0xFFFFFFFFFFFFFFFF))
        edge = np.zeros(w - 1, np.uint64)
        top = self._sliding(np.maximum, np.concatenate([edge, low, edge]), w, np.uint64(0))
        at = np.flatnonzero(top == h)
        at = at[self._needed(x, at, h[at])]
        place = at + offset
        left, right = np.minimum(place, self.length - k), np.minimum(size - place, self.length)
        inside = (at >= left) & (at + right <= len(x))  # others lie inside the piece before or after
        at, place, left, right = at[inside], place[inside], left[inside], right[inside]
        more = self._sums(x, 1)
        around = self._mix((more[at + right] - more[at - left]) * self.inverse[1][at - left])
        around = self._mix(around + left.astype(np.uint64) * np.uint64(1 << 32) + right.astype(np.uint64))
        return place, h[at].view(np.int64), around.view(np.int64), left, right


def occurrences(docs: DataFrame, length: int, k: int, classes: bool) -> DataFrame:
    """The anchors of ``docs`` (key, text binary): every one, or (``classes``) one for each
    class and task with the number of them."""
    schema = "anchor long, around long, n long, key long, place long, left int, right int"

    def read(batches):
        import pyarrow as pa

        finder = Anchors(length, k)
        names = [x.split()[0] for x in schema.split(", ")]

        def table(parts):
            anchor, around, n, key, place, left, right = (np.concatenate(c) for c in zip(*parts, strict=True))
            if classes:
                order = np.lexsort((place, key, around, anchor))
                a, c = anchor[order], around[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
                n = np.add.reduceat(n[order], first)
                order = order[first]
                anchor, around, key, place, left, right = (x[order] for x in (anchor, around, key, place, left, right))
            return anchor, around, n, key, place, left, right

        def out(parts):
            for lo in range(0, len(parts[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + (1 << 16)], t, safe=False) for x, t in zip(parts, (
                    *[pa.int64()] * 5, pa.int32(), pa.int32()), strict=True)], names)

        waiting, size, limit = [], 0, 1 << 18
        for b in batches:
            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (f := finder.find(text)) is not None:
                    place, anchor, around, left, right = f
                    waiting.append((anchor, around, np.ones(len(place), np.int64), np.full(len(place), key), place, left, right))
                    size += len(place)
                if size > limit:
                    whole = table(waiting)
                    waiting, size = [whole], len(whole[0])
                    if not classes or 2 * size > limit:  # nothing to gain from waiting longer
                        yield from out(whole)
                        waiting, size = [], 0
        if waiting:
            yield from out(table(waiting))

    return docs.mapInArrow(read, schema)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two byte matrices, ``most`` at most."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def _matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    width = max(1, int(sizes.max()))
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width), sizes


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of every common-prefix interval with two suffixes or more: one
    scan with a stack over the common-prefix lengths of neighbours."""
    stack: list[tuple[int, int]] = []  # (first, depth)
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, d = stack.pop()
            yield first, i, d
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


class _Nearest:
    """Common beginnings of byte strings: of any two neighbours of a subset in sorted order, by
    the least of the lengths between them (a table of minima over runs of 2, 4, 8 ... )."""

    def __init__(self, rows: list[bytes]):
        self.order = np.array(sorted(range(len(rows)), key=rows.__getitem__))
        self.rank = np.empty(len(rows), np.int64)
        self.rank[self.order] = np.arange(len(rows))
        flat, sizes = _matrix([rows[i] for i in self.order])
        self.lcp = _common(flat[:-1], flat[1:], np.minimum(sizes[:-1], sizes[1:]))
        self.minima = [self.lcp]

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For sorted places lo < hi."""
        power = np.frexp(hi - lo)[1] - 1
        while len(self.minima) <= int(power.max(initial=0)):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
        out = np.empty(len(lo), np.int64)
        for p in np.unique(power):
            at = power == p
            out[at] = np.minimum(self.minima[p][lo[at]], self.minima[p][hi[at] - (1 << int(p))])
        return out


def repeats_of(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(members, depth, match): for each common-prefix interval of the suffixes ``rights`` its
    members and, for those that match another one on ``length`` bytes or more, how many bytes on
    the left (``lefts``, nearest byte first) do; -1 for the others.  Nothing is given for an
    interval without such a member."""
    right, left = _Nearest(rights), _Nearest(lefts)
    for first, last, depth in intervals(right.lcp.tolist()):
        rank = np.sort(left.rank[right.order[first:last + 1]])
        # left extensions: neighbours in the order of the left sides match longest
        same = left.between(rank[:-1], rank[1:])
        if int(same.max()) + depth < length:
            continue
        match = np.maximum(np.concatenate([[-1], same]), np.concatenate([same, [-1]]))
        yield left.order[rank], depth, np.where(match + depth >= length, match, -1)


def _spans_of_trees(rows: DataFrame, by: list[str], length: int, k: int) -> DataFrame:
    """(key, lo, hi) for the rows (key, place, lefts, rights) of each group ``by``, which agree in
    ``k`` bytes before ``rights``: the groups of a partition come one after another, and one at a
    time is held."""

    def spans(group):
        place, lefts, rights = ([r[i] for r in group] for i in (1, 2, 3))
        on_left, on_right = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for members, depth, match in repeats_of(lefts, rights, length - k):
            good = members[match >= 0]
            on_left[good] = np.maximum(on_left[good], match[match >= 0])
            on_right[good] = np.maximum(on_right[good], depth + k)
        return [(group[i][0], place[i] - int(on_left[i]), place[i] + int(on_right[i])) for i in np.flatnonzero(on_right > 0)]

    def scan(batches):
        import pyarrow as pa

        last, group, out = None, [], []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                if row[4:] != last:
                    if len(group) > 1:
                        out += spans(group)
                    last, group = row[4:], []
                group.append(row[:4])
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "lo", "hi"])
                    out = []
        if len(group) > 1:
            out += spans(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "lo", "hi"])

    rows = rows.repartition(*by).sortWithinPartitions(*by).select("key", "place", "lefts", "rights", *by)
    return rows.mapInArrow(scan, "key long, lo long, hi long")


def _spans_of_neighbours(rows: DataFrame, by: str, side: str, k: int, folder: str) -> DataFrame:
    """(key, lo, hi) of the groups ``by``, in each of which any two occurrences match on the asked
    length: the longest match on one side is that with a neighbour in order, found in a stream
    over sorted ranges.  A group may lie in many ranges; the first and the last row of each
    range (two a task) are then scanned in the same way, so neighbours in two ranges meet too."""
    kinds = "key long, lo long, hi long, grp string, bytes binary, place long"

    def scan(batches):
        import pyarrow as pa

        types = (*[pa.int64()] * 3, pa.string(), pa.binary(), pa.int64())
        names = [x.split()[0] for x in kinds.split(", ")]
        first = last = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last[0] == row[0]:
                    x, y = last[1], row[1]
                    n = min(len(x), len(y))
                    differ = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
                    n = int(differ[0]) if len(differ) else n
                    for _, _, key, place in (last, row):
                        out.append((key, place - n if side == "lefts" else place, place if side == "lefts" else place + k + n, None, None, None))
                first, last = first or row, row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if first is not None:
            ends = [(r[2], None, None, r[0], r[1], r[3]) for r in (first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends, strict=True), types, strict=True)], names)

    rows = rows.select(F.col(by).cast("string").alias("grp"), F.col(side).alias("bytes"), "key", "place")
    order = ["grp", "bytes", "key", "place"]
    found = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, kinds), folder)
    ends = found.where("grp is not null").select(*order).coalesce(1).sortWithinPartitions(*order).mapInArrow(scan, kinds)
    return found.where("grp is null").select("key", "lo", "hi").unionByName(ends.where("grp is null").select("key", "lo", "hi"))


def _spans_of_large(rows: DataFrame, folder: str, length: int, k: int, largest: int) -> DataFrame:
    """(key, lo, hi) for the rows of anchors with many occurrences, in groups that agree in ``l`` bytes
    on the left and ``r`` on the right.  Groups of ``largest`` rows or fewer are trees.  In a group that
    agrees in all the asked bytes any two rows match.  Others are split: of two rows that match on
    ``length`` bytes, one side agrees in half of the bytes that are still open, so they meet in
    a group by the right or in one by the left.  The open bytes halve with each step."""
    need, step, spans = length - k, 0, None
    rows = rows.select(F.col("anchor").cast("string").alias("part"), F.lit(0).alias("l"), F.lit(0).alias("r"), "key", "place", "lefts", "rights")
    while True:
        at = f"{folder}/split{step}"
        rows = stored(rows, f"{at}/rows")
        sizes = stored(rows.groupBy("part").count().where("count > 1"), f"{at}/sizes")
        rows = rows.join(sizes, "part")
        equal = F.col("l") + F.col("r") >= need
        found = [_spans_of_trees(rows.where(~equal & (F.col("count") <= largest)), ["part"], length, k)]
        if rows.where(equal).limit(1).count():
            found += [_spans_of_neighbours(rows.where(equal), "part", side, k, f"{at}/{side}") for side in ("lefts", "rights")]
        for f in found:
            spans = f if spans is None else spans.unionByName(f)
        if not sizes.where(F.col("count") > largest).limit(1).count():
            return spans
        large = rows.where(~equal & (F.col("count") > largest))
        more = F.floor((need - F.col("l") - F.col("r") + 1) / 2).cast("int")
        right, left = F.col("r") + more, F.lit(need + 1) - F.col("r") - more
        halves = []
        for side, size, l, r in (("rights", right, F.col("l"), right), ("lefts", left, left, F.col("r"))):  # noqa: E741
            part = F.sha2(F.concat(F.concat_ws(":", F.lit(side), "part").cast("binary"), F.substring(side, F.lit(1), size)), 256)
            halves.append(large.where(F.length(side) >= size).select(part.alias("part"), l.alias("l"), r.alias("r"), "key", "place", "lefts", "rights"))
        rows, step = halves[0].unionByName(halves[1]), step + 1


def _context(docs: DataFrame, places: DataFrame, folder: str, length: int, k: int) -> DataFrame:
    """(anchor, key, place, lefts, rights): the bytes before the places (anchor, key, place), nearest
    first, and those that follow the ``k`` bytes all of an anchor agree in."""
    wanted = stored(places.groupBy("key").agg(F.collect_list(F.struct("place", "anchor")).alias("wanted")), f"{folder}/wanted")
    rows = docs.where(may_hold(wanted, "key")(F.col("key"))).join(wanted, "key").select("key", "text", "wanted")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for key, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = [w["place"] for w in wanted]
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array([w["anchor"] for w in wanted], pa.int64()),
                    "key": pa.array([key] * len(at), pa.int64()), "place": pa.array(at, pa.int64()),
                    "lefts": pa.array([text[max(0, p - length + k):p][::-1] for p in at], pa.binary()),
                    "rights": pa.array([text[p + k:p + length] for p in at], pa.binary())})

    return rows.mapInArrow(cut, "anchor long, key long, place long, lefts binary, rights binary")


def repeated_spans(docs: DataFrame, folder: str, length: int, k: int, largest: int = LARGEST) -> DataFrame:
    """(key, lo, hi): parts of ``docs`` (key, text binary) whose every byte lies in a string of
    ``length`` bytes that also starts elsewhere; together they hold all such bytes."""
    local = occurrences(docs, length, k, classes=True)
    classes = stored(local.groupBy("anchor", "around").agg(F.sum("n").alias("n"), F.min(F.struct("key", "place")).alias("at")), f"{folder}/local")
    # an anchor may have any number of classes: they are counted before the shuffle
    stats = classes.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.min("n").alias("least")).where("all > 1")
    classes = classes.join(stored(stats.drop("all"), f"{folder}/stats"), "anchor")
    classes = stored(classes.select("anchor", "around", "n", "at.key", "at.place", "kinds", "least"), f"{folder}/classes")
    # classes of two or more: everything around an anchor is repeated
    whole = occurrences(docs, length, k, classes=False).join(classes.where("n > 1").select("anchor", "around"), ["anchor", "around"])
    spans = whole.select("key", (F.col("place") - F.col("left")).alias("lo"), (F.col("place") + F.col("right")).alias("hi"))
    # the others are compared with all classes of their anchor
    todo = classes.where("kinds > 1 and least = 1")
    around = _context(docs, todo.select("anchor", "key", "place"), folder, length, k)
    sizes = stored(todo.select("anchor", "kinds").where(F.col("kinds") > largest).distinct(), f"{folder}/sizes")
    if not sizes.limit(1).count():
        return spans.unionByName(_spans_of_trees(around, ["anchor"], length, k))
    around = stored(around, f"{folder}/around")
    spans = spans.unionByName(_spans_of_trees(around.join(sizes, "anchor", "left_anti"), ["anchor"], length, k))
    many = around.join(sizes.select("anchor"), "anchor")
    return spans.unionByName(_spans_of_large(many, folder, length, k, largest))


def _with_keys(rows: DataFrame, folder: str, bits: int) -> DataFrame:
    """``rows`` (doc_id, text) with a column ``key``: a 64-bit hash of both, or a second one for
    different rows with the same first hash, so that no row gets the spans of another."""
    first = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - bits) if bits < 64 else F.xxhash64("doc_id", "text")
    second = F.xxhash64("text", F.lit(7), "doc_id")

    def twins(keys: DataFrame, name: str) -> DataFrame:
        met = keys.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high"))
        return stored(met.where("low <> high").select("key"), f"{folder}/{name}")

    same = [r[0] for r in twins(rows.select(first.alias("key"), second.alias("check")), "twins").toLocalIterator()]
    key = F.when(first.isin(same), second).otherwise(first) if same else first
    if same and twins(rows.select(key.alias("key"), second.alias("check")), "twins-again").limit(1).count():
        raise ValueError("different rows have the same hash of 128 bits")
    return rows.withColumn("key", key)


def remove_repeats(docs: DataFrame, length: int = 400, k: int | None = None, folder: str | None = None, largest: int = LARGEST,
                   bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs`` (doc_id, text): the
    UTF-8 bytes without those that a string of ``length`` bytes covers that starts anywhere else too.

    Matches never cross documents; occurrences may overlap, in one document or several.  A null
    text is empty.  Every row is a document of its own: a repeated row loses all bytes of
    its repeated strings, so rows of ``length`` bytes or more that repeat each other lose everything.
    Other columns are ignored.  ``bits``: of the first of a row's two hashes (fewer in tests only)."""
    k = k or length * 8 // 25
    folder = folder or work_dir(docs.sparkSession, "repeats")
    rows = _with_keys(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")), folder, bits)
    spans = repeated_spans(rows.select("key", "text"), folder, length, k, largest)
    spans = stored(spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), f"{folder}/spans")
    marked = rows.withColumn("cut", may_hold(spans, "key")(F.col("key")))
    # texts without a span stay where they are
    rows = marked.where("cut").join(spans, "key", "left").select("doc_id", "text", "spans").unionByName(
        marked.where("not cut").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            n, removed, runs, kept = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out, end, count = [], 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > end or not count:
                        out.append(text[end:lo])
                        count += 1
                    end = max(end, hi)
                out.append(text[end:])
                kept.append(b"".join(out))
                n.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                runs.append(count)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

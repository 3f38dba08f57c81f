"""Benchmark decontamination by the q-gram lemma.

Texts are folded to their ASCII letters and digits in lower case and their bytes beyond
ASCII (Western capitals with accents in lower case too).  A folded item, or any window of a long one, of ``m`` bytes that occurs
in a document with at most ``k`` edits shares ``m + 1 - q * (k + 1)`` q-grams with it or more,
all on diagonals that lie within ``k`` of each other.  So the shared q-grams are collected in
overlapping bands of ``2 * (k + 1)`` diagonals, and only windows that reach the bound in a band
are aligned, inside the band.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.quality import runs
from corvid.llm.shared import giving_back

Q = 8
BITS = 22

HITS = "doc_id long, item_id long, start long, end long, edits int"

_KEEP = np.zeros(256, np.uint8)
_KEEP[list(range(128, 256)) + list(range(48, 58)) + list(range(97, 123))] = 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def fold(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes, their places in ``data``)."""
    low = _LOW[np.frombuffer(data, np.uint8)]
    # capitals with accents: the second byte behind C3 is 80 to 9E (but for the sign D7) in UTF-8
    up = np.flatnonzero(low[:-1] == 0xC3) + 1
    up = up[(low[up] >= 0x80) & (low[up] <= 0x9E) & (low[up] != 0x97)]
    low[up] += 32
    at = np.flatnonzero(_KEEP[low])
    return low[at], at


def _codes(x: np.ndarray) -> np.ndarray:
    """The q-gram (8 bytes) at every place, as one integer each."""
    if len(x) < Q:
        return np.empty(0, np.uint64)
    a = x.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    return a[:-4] | a[4:] << np.uint64(32)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Passages:
    """Folded benchmark items, with an index of their q-grams."""

    def __init__(self, items: list[tuple], rate: float, window: int):
        self.item, self.units = [], []
        for item_id, text in items:
            x = fold(text.encode())[0]
            if len(x) >= Q:
                self.item.append(item_id)
                self.units.append(x)
        size = np.array([len(u) for u in self.units], np.int64)
        self.begin = np.cumsum(size) - size  # of the items, one after another
        self.m = np.minimum(size, max(window, Q))
        # the bound must stay at one shared q-gram or more
        self.k = np.minimum((rate * self.m).astype(np.int64), np.maximum(self.m // Q - 1, 0))
        self.bound = self.m + 1 - Q * (self.k + 1)
        codes = [_codes(u) for u in self.units]
        all_codes = np.concatenate([np.empty(0, np.uint64), *codes])
        unit = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(len(c)) for c in codes)])
        order = np.argsort(all_codes, kind="stable")
        self.codes, self.first, self.count = np.unique(all_codes[order], return_index=True, return_counts=True)
        self.unit, self.at = unit[order], at[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[_slot(self.codes)] = True

    @classmethod
    def of(cls, state: dict) -> Passages:
        made = cls.__new__(cls)
        made.__dict__ |= state
        return made

    def find(self, x: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(place, end, unit, edits) of passages in joined folded texts; ``doc``: whose byte it is."""
        codes = _codes(x)
        if not len(self.codes) or not len(codes):
            return []
        place = np.flatnonzero(self.seen[_slot(codes)])
        place = place[doc[place] == doc[place + Q - 1]]
        got = codes[place]
        k = np.minimum(np.searchsorted(self.codes, got), len(self.codes) - 1)
        place, k = place[self.codes[k] == got], k[self.codes[k] == got]
        n = self.count[k]
        rows = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place, unit = np.repeat(place, n), self.unit[rows]
        at = self.at[rows]
        step = self.k[unit] + 1
        # bands are counted from the start of each document, so that it gets what it would get alone
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        own = np.searchsorted(first, place, "right") - 1
        far = max(len(u) for u in self.units)
        base = np.arange(len(first)) * (far + 4) + first  # of the documents' band numbers
        band = base[own] + 1 + (place - first[own] - at + far) // step
        # the same q-gram of the item counts once in a band
        total = int(self.begin[-1]) + far
        at = self.begin[unit] + at
        pairs = np.unique(np.concatenate([band * total + at, (band - 1) * total + at]))
        band, at = pairs // total, pairs % total
        unit = np.searchsorted(self.begin, at, "right") - 1
        at -= self.begin[unit]
        # a window reaches the bound where so many q-grams in a row begin inside it
        last = np.arange(len(at)) + self.bound[unit] - 1
        here = np.flatnonzero(last < len(at))
        last = last[here]
        here = here[(band[last] == band[here]) & (unit[last] == unit[here]) & (at[last] - at[here] <= self.m[unit[here]] - Q)]
        if not len(here):
            return []
        edge = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (unit[1:] != unit[:-1])]))
        group = np.unique(np.searchsorted(edge, here, "right") - 1)
        edge = np.append(edge, len(at))
        low, high, start, owner, todo = [], [], [], [], []
        for g in group:
            u, d, seen = unit[edge[g]], band[edge[g]], at[edge[g]:edge[g + 1]]
            w = np.arange(len(self.units[u]) - self.m[u] + 1)
            shared = np.searchsorted(seen, w + self.m[u] - Q, "right") - np.searchsorted(seen, w)
            w, shared = w[shared >= self.bound[u]], shared[shared >= self.bound[u]]
            least = -(-(self.m[u] + 1 - Q - shared) // Q)  # an edit costs Q shared q-grams at most
            order = np.lexsort((w, least))
            i = int(np.searchsorted(base, d, "right")) - 1
            low.append(first[i])
            high.append(first[i + 1] if i + 1 < len(first) else len(x))
            start.append(first[i] + (d - base[i] - 1) * (self.k[u] + 1) - far)  # text place of the band's first diagonal
            owner.append(u)
            todo.append((least[order], w[order]))
        return self._align(x, *(np.array(v, np.int64) for v in (low, high, start, owner)), todo)

    def _align(self, x, low, high, start, unit, todo):
        """For each group (document, item, band) the windows with the least edits, the first of them:
        banded alignment, the place in the text free at both ends and from ``low`` to ``high``.
        ``todo``: (edits at least, window) in this order, so windows that cannot be better are left out."""
        best, round_ = {}, 1
        while True:
            group, window = [], []
            for g, (least, w) in enumerate(todo):
                if g in best:
                    keep = (least < best[g][0]) | (least == best[g][0]) & (w < best[g][1])
                    least, w = least[keep], w[keep]
                group += [g] * len(w[:round_])
                window += w[:round_].tolist()
                todo[g] = (least[round_:], w[round_:])
            if not group:
                break
            group, window = np.array(group), np.array(window)
            shape = self.k[unit[group]] << 32 | self.m[unit[group]]
            for kind in np.unique(shape):
                some = np.flatnonzero(shape == kind)
                for lo in range(0, len(some), 4096):
                    g, w = group[some[lo:lo + 4096]], window[some[lo:lo + 4096]]
                    k, m = int(kind >> 32), int(kind & 0xFFFFFFFF)
                    for r, a, b, edits in self._align_equal(x, low[g], high[g], unit[g], start[g] + w, w, k, m):
                        hit = (edits, int(w[r]), a, b)
                        best[int(g[r])] = min(best.get(int(g[r]), hit), hit)
            round_ *= 4
        return [(a, b, int(unit[g]), edits) for g, (edits, _, a, b) in best.items()]

    def _align_equal(self, x, low, high, unit, start, window, k, m):
        width = 2 * (k + 1)
        cols = np.arange(width)
        text = start[:, None] + np.arange(m + width)[None]
        inside = (text >= low[:, None]) & (text < high[:, None])
        # 0 is in no folded text: a letter of the unit beyond the document is one edit, as a dropped one
        seen = np.where(inside, x[np.where(inside, text, 0)], 0)
        pat = np.stack([self.units[u][w:w + m] for u, w in zip(unit, window, strict=True)])
        big = 1 << 12
        # edits * big + first diagonal: the least edits, and of these the leftmost beginning
        cost = np.broadcast_to(cols, (len(unit), width)).astype(np.int64)
        for i in range(m):
            step = cost + big * (seen[:, i:i + width] != pat[:, i:i + 1])
            drop = np.concatenate([cost[:, 1:], np.full((len(unit), 1), big * big)], 1) + big
            best = np.minimum(step, drop)
            cost = np.minimum.accumulate(best - big * cols, axis=1) + big * cols
        end = cost.argmin(axis=1)
        least = cost[np.arange(len(unit)), end]
        out = []
        for r in np.flatnonzero(least // big <= k):
            a, b = max(int(start[r] + least[r] % big), int(low[r])), min(int(start[r] + end[r] + m), int(high[r]))
            if a < b:
                out.append((int(r), a, b, int(least[r] // big)))
        return out


def _search(passages: Passages, texts) -> list[tuple]:
    """(row, item_id, start, end, edits) in an Arrow array of binary texts; places in bytes of
    the text; one row, the one with the least edits and then the first, for each text and item."""
    sizes = [len(t) for t in texts]
    found: dict[tuple, tuple] = {}
    for lo, hi in runs(np.array(sizes, np.int64), 2 << 20):
        parts = [fold(t) for t in texts[lo:hi]]
        x = np.concatenate([p for p, _ in parts])
        doc = np.repeat(np.arange(lo, hi), [len(p) for p, _ in parts])
        first = np.concatenate([[0], np.cumsum([len(p) for p, _ in parts])])
        for a, b, unit, edits in passages.find(x, doc):
            i = int(doc[a])
            at = parts[i - lo][1]
            hit = (edits, int(at[a - first[i - lo]]), int(at[b - 1 - first[i - lo]]) + 1)
            key = (i, passages.item[unit])
            found[key] = min(found.get(key, hit), hit)
    return [(i, item, a, b, e) for (i, item), (e, a, b) in sorted(found.items(), key=lambda kv: (kv[0][0], kv[1]))]


def blocks(bench: DataFrame, rate: float, window: int, block_bytes: int):
    """The benchmark's indexes, each of about ``block_bytes`` of text, so what a task is
    sent never grows with the benchmark; the number of passes does."""
    bench = bench.select("item_id", "text").where(F.col("text").isNotNull())
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Passages(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1])), rate, window)


def contaminated(docs: DataFrame, bench: DataFrame, rate: float = 0.1, window: int = 100, block_bytes: int = 4 << 20) -> DataFrame:
    """The benchmark passages found in ``docs`` (doc_id, text): (doc_id, item_id, start, end,
    edits), one row for each document row and item, places in bytes of the UTF-8 text.

    A passage is found where a whole item of at most ``window`` folded bytes, or any ``window``
    bytes of a longer one, wherever they begin, occur with edits of at most ``rate`` of their
    length; start, end and edits are those of the window with the least edits.  The q-gram bound
    allows m // 8 - 1 edits in m folded bytes, which with the default rate is one less than the
    rate for items of 10 to 15, 20 to 23, 30 and 31 folded bytes.  Items with fewer than 8 folded bytes, null items and null
    texts match nothing.  Every document is read once for each block of the benchmark.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    out = None
    for passages in blocks(bench, rate, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(vars(passages))

        def search(batches, shared=shared):
            import pyarrow as pa

            passages = Passages.of(shared.value)
            for b in batches:
                hits = _search(passages, b.column(1).to_pylist())
                rows, item, start, end, edits = zip(*hits) if hits else ((),) * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()),
                                                  pa.array(end, pa.int64()), pa.array(edits, pa.int32())], ["doc_id", "item_id", "start", "end", "edits"])

        found = docs.mapInArrow(giving_back(search), HITS)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def drop_contaminated(docs: DataFrame, bench: DataFrame, rate: float = 0.1, window: int = 100, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage is found, all columns as they were;
    row by row, without a shuffle."""
    schema, k = docs.schema, docs.columns.index("text")
    for passages in blocks(bench, rate, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(vars(passages))

        def clean(batches, shared=shared):
            import pyarrow as pa
            import pyarrow.compute as pc

            passages = Passages.of(shared.value)
            for b in batches:
                texts = pc.cast(b.column(k).fill_null(""), pa.binary()).to_pylist()
                hit = {h[0] for h in _search(passages, texts)}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(giving_back(clean), schema)
    return docs

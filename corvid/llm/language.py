"""Hashed maximum-entropy language model with class-factored softmax.

P(word | two words before) = P(class | context) * P(word | class, context).  The most frequent words
make up classes of ``WIDE`` words each, in order of frequency; all other words of the training
rows fall into one class for each octave of their counts; one more class stands for every unseen
word.  Both softmaxes start from the smoothed frequencies and add weights for features of the
context: the word before (bigram), the word before that alone (skip) and, for the class, both
(trigram), each hashed to a row of a table of fixed size.  Inside the octaves and for unseen words the
smoothed frequencies stay.  Without weights the model is exactly the smoothed unigram model, and the
probabilities of all words and of one unseen word add up to 1 in every context.

1. ``encode`` reads the texts once and stores word numbers in chunks with a dictionary each.
2. Training counts of the words are added up over all dictionaries.  The counts of frequent words are
   sent to the tasks (a bounded table); those of all others go back to the dictionaries that hold
   them by a join on the word.
3. ``train`` goes through the chunks in rounds.  Every task adds up the gradient over its chunks, blocks of rows
   of the tables are summed up in a fixed order, and the driver, which holds the tables, takes one step.
4. ``score`` gives each document the sum over its tokens.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import filesystem, giving_back, pick, stored, work_dir

WIDE = 64  # words of a class
HEAD_CLASSES = 16
OCTAVES = 31
CLASSES = HEAD_CLASSES + OCTAVES + 1
CLASS_ROWS, WORD_ROWS = 13, 14  # bits
FREQUENT = 1 << 16  # words whose counts are sent to the tasks
LONG = 64  # bytes; longer words are never among those
ALPHA = 0.1
NEVER = -1e4
START = np.uint64(0x5851F42D4C957F2D)
_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def pieces(text: bytes, most: int = 1 << 20):
    """A text in parts that end between words."""
    lo = 0
    while lo < len(text):
        cut = _BLANK.search(text, lo + most) if lo + most < len(text) else None
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """What the training rows say about words: counts, classes and the unigram start of both softmaxes.

    ``top``: (count, number of the word) by order of frequency; ``octaves``: (sum of counts, number of
    words) of all other words by octave; ``n``, ``v``: tokens and distinct words."""

    def __init__(self, top: list[tuple[int, int]], octaves: dict[int, tuple[int, int]], n: int, v: int):
        self.state = (top, octaves, n, v)
        self.n, self.v = n, v
        self.z = n + ALPHA * (v + 1)
        mass = np.zeros(CLASSES)
        self.within = np.full((HEAD_CLASSES, WIDE), NEVER, np.float32)
        for rank, c in enumerate(top):
            mass[rank // WIDE] += (c + ALPHA) / self.z
        for rank, c in enumerate(top):
            self.within[rank // WIDE, rank % WIDE] = np.log((c + ALPHA) / self.z / mass[rank // WIDE])
        for k, (total, words) in octaves.items():
            mass[HEAD_CLASSES + k] = (total + ALPHA * words) / self.z
        mass[-1] = ALPHA / self.z
        self.mass = mass
        self.start = np.where(mass > 0, np.log(np.maximum(mass, 1e-300)), NEVER)
        self.start32 = self.start.astype(np.float32)

    def classes(self, count: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Class of words with these counts; ``rank`` -1 for words outside the head."""
        octave = HEAD_CLASSES + np.minimum(np.frexp(np.maximum(count, 1))[1] - 1, OCTAVES - 1)
        return np.where(rank >= 0, rank // WIDE, np.where(count > 0, octave, CLASSES - 1))

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Natural logarithm of the smoothed frequency."""
        return np.log((count + ALPHA) / self.z)


class Events:
    """Tokens of a chunk with their contexts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, count: np.ndarray, rank: np.ndarray, words: Words):
        self.cls = words.classes(count, rank)[ids]
        self.slot = (rank % WIDE)[ids]
        self.fixed = np.where(rank >= 0, 0.0, words.unigram(count) - words.start[words.classes(count, rank)])[ids]
        self.fixed[self.cls == CLASSES - 1] = 0.0
        h = hashes[ids]
        first = np.cumsum(sizes) - sizes
        self.before = np.concatenate([[START], h[:-1]]) if len(h) else h
        self.before[first] = START
        self.skip = np.concatenate([[START], self.before[:-1]]) if len(h) else h
        self.skip[first] = START

    def rows(self, at: slice) -> np.ndarray:
        """Hashes of the three features, (3, events): bigram, skip and trigram."""
        b, s = self.before[at], self.skip[at]
        return np.stack([mix(b * _KEYS[0]), mix(s * _KEYS[1]), mix(b * _KEYS[2] + s * _KEYS[3])])


class Tables:
    """Weights: rows of class weights and rows of word weights."""

    def __init__(self, by_class: np.ndarray | None = None, by_word: np.ndarray | None = None):
        self.by_class = np.zeros((1 << CLASS_ROWS, CLASSES), np.float32) if by_class is None else by_class
        self.by_word = np.zeros((1 << WORD_ROWS, WIDE), np.float32) if by_word is None else by_word

    def forward(self, events: Events, words: Words, at: slice):
        """(log P(class), log P(word | class), parts that the gradient needs) of some events."""
        f = events.rows(at)
        cls = events.cls[at]
        rows_c = (f >> np.uint64(64 - CLASS_ROWS)).astype(np.int64)
        z = words.start32 + self.by_class.take(rows_c[0], axis=0)
        for r in rows_c[1:]:
            z += self.by_class.take(r, axis=0)
        log_c, *p_c = _softmax(z, cls)
        head = np.flatnonzero(cls < HEAD_CLASSES)
        rows_w = (mix(f[:2, head] + cls[head].astype(np.uint64) * _KEYS[4]) >> np.uint64(64 - WORD_ROWS)).astype(np.int64)
        z = words.within.take(cls[head], axis=0)
        for r in rows_w:
            z += self.by_word.take(r, axis=0)
        slot = events.slot[at][head]
        log_h, *p_w = _softmax(z, slot)
        log_w = events.fixed[at].copy()
        log_w[head] = log_h
        return log_c, log_w, (cls, rows_c, p_c, slot, rows_w, p_w)


def _softmax(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logarithm of the target's probability, exponentials, their sums) of the rows of ``z``.  Starts are
    logarithms of shares and weights are bounded by the steps taken, so nothing overflows."""
    hit = z[np.arange(len(z)), target].astype(np.float64)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    return hit - np.log(total), z, total


STEP = 1 << 12  # events at a time: their rows stay in the processor's cache


def log_probabilities(events: Events, words: Words, tables: Tables) -> np.ndarray:
    """Natural logarithm of the probability of every token."""
    out = np.empty(len(events.cls))
    for lo in range(0, len(out), STEP):
        at = slice(lo, lo + STEP)
        log_c, log_w, _ = tables.forward(events, words, at)
        out[at] = log_c + log_w
    return out


def add_gradient(events: Events, words: Words, tables: Tables, by_class: np.ndarray, by_word: np.ndarray) -> None:
    """Add expected minus observed of all events to the two sums; their last column counts the events of a row."""
    for lo in range(0, len(events.cls), STEP):
        _, _, (cls, rows_c, p_c, slot, rows_w, p_w) = tables.forward(events, words, slice(lo, lo + STEP))
        for target, rows, (p, all_p), out in ((cls, rows_c, p_c, by_class), (slot, rows_w, p_w, by_word)):
            p /= all_p[:, None]
            p[np.arange(len(p)), target] -= 1
            flat = out.reshape(-1)
            for r in rows:
                np.add.at(flat, (r[:, None] * out.shape[1] + np.arange(p.shape[1])).ravel(), p.ravel())
                out[:, -1] += np.bincount(r, minlength=len(out))


class Optimizer:
    """Steps down the gradient, each weight's divided by an estimate of its curvature: the events of its row
    times the share of its output at the start.  A prior keeps rows with few events back; steps become
    shorter with the rounds, as each round sees other documents."""

    def __init__(self, words: Words, rate: float = 1.0, prior: float = 5.0):
        self.rate, self.prior, self.rounds = rate, prior, 0
        self.share = np.maximum(words.mass, 1e-6).astype(np.float32)

    def step(self, tables: Tables, by_class: np.ndarray, by_word: np.ndarray) -> Tables:
        rate = self.rate / (1 + self.rounds / 4)
        self.rounds += 1
        a = by_class[:, :-1] / (by_class[:, -1:] * self.share + self.prior)
        b = by_word[:, :-1] / (by_word[:, -1:] / WIDE + self.prior)
        return Tables(tables.by_class - rate * np.clip(a, -1, 1), tables.by_word - rate * np.clip(b, -1, 1))


CHUNK = "chunk long, part long, doc_ids array<long>, train array<boolean>, sizes array<long>, tokens binary, words array<binary>, counts array<long>"


def encode(docs: DataFrame, chunk_tokens: int = 1 << 21) -> DataFrame:
    """Chunks of whole documents (doc_id, text, train): word numbers, the chunk's words in the order of their
    numbers and their counts in the training rows.  The end of a document is the empty word."""

    def run(batches):
        from collections import defaultdict
        from itertools import chain

        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        names = [f.split()[0] for f in CHUNK.split(", ")]

        def fresh():
            known = defaultdict()
            known.default_factory = known.__len__
            return known, [], [], [], []

        def chunk():
            ids = np.concatenate(tokens)
            kept = np.repeat(np.array(train, bool), sizes)
            counts = np.bincount(ids[kept], minlength=len(known))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(),
                     pa.list_(pa.binary()), pa.list_(pa.int64()))
            row = (part << 32 | seq, part, keys, train, sizes, ids.astype("<u4").tobytes(), list(known), counts.tolist())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        known, tokens, keys, train, sizes = fresh()
        total = 0
        for b in batches:
            for key, text, flag in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = [np.fromiter(map(known.__getitem__, words), np.uint32, len(words)) for words in
                       chain((p.lower().split() for p in pieces(text)), [[b""]])]
                tokens += ids
                keys.append(key)
                train.append(flag)
                sizes.append(sum(map(len, ids)))
                total += sizes[-1]
                if total >= chunk_tokens:
                    yield chunk()
                    known, tokens, keys, train, sizes = fresh()
                    total, seq = 0, seq + 1
        if keys:
            yield chunk()

    return docs.select("doc_id", "text", "train").mapInArrow(giving_back(run), CHUNK)


def _rows_of(folder: str, part: int):
    """{chunk: (numbers, counts)} of a part of the stored counts of words that are not frequent."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    where, path = filesystem(f"{folder}/part={part}")
    found = where.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    out = {}
    for f in sorted(i.path for i in found if i.path.endswith(".parquet")):
        with where.open_input_file(f) as source:
            for row in pq.ParquetFile(source).read(columns=["chunk", "numbers", "counts"]).to_pylist():
                out[row["chunk"]] = (np.frombuffer(row["numbers"], "<u4"), np.frombuffer(row["counts"], "<i8"))
    return out


class Chunks:
    """What tasks need to turn a stored chunk into events."""

    def __init__(self, words: Words, frequent: dict[bytes, tuple[int, int]], rare: str):
        self.words, self.frequent, self.rare = words, frequent, rare
        self.part, self.found = None, {}

    def send(self, spark, tables: Tables):
        """Plain values for the tasks, which need not have this package."""
        return spark.sparkContext.broadcast((self.words.state, self.frequent, self.rare, tables.by_class, tables.by_word))

    @classmethod
    def receive(cls, sent) -> tuple[Chunks, Tables]:
        state, frequent, rare, by_class, by_word = sent.value
        return cls(Words(*state), frequent, rare), Tables(by_class, by_word)

    def read(self, batch):
        """(doc_ids, train, sizes, ids, count, rank, hashes) of each row of a batch of the columns of ``NEEDED``."""
        import xxhash

        for i in range(batch.num_rows):
            chunk, part, keys, train, sizes, tokens, names = (c[i] for c in batch.columns)
            chunk, part = chunk.as_py(), part.as_py()
            if part != self.part:
                self.part, self.found = part, _rows_of(self.rare, part)
            names = names.as_py()
            count, rank = np.zeros(len(names), np.int64), np.full(len(names), -1)
            if chunk in self.found:
                numbers, counts = self.found[chunk]
                count[numbers] = counts
            for j, name in enumerate(names):
                if (known := self.frequent.get(name)) is not None:
                    count[j], rank[j] = known
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
            ids = np.frombuffer(tokens.as_buffer(), "<u4")
            yield keys.as_py(), np.array(train.as_py(), bool), np.array(sizes.as_py(), np.int64), ids, count, rank, hashes


NEEDED = ["chunk", "part", "doc_ids", "train", "sizes", "tokens", "words"]


class Model:
    """A trained model and the stored chunks it was trained on."""

    def __init__(self, chunks: DataFrame, reader: Chunks, tables: Tables):
        self.chunks, self.reader, self.tables = chunks, reader, tables

    def score(self) -> DataFrame:
        """(doc_id, train, n_tokens, n_known, base, score) for every document of the chunks: tokens, those known from the
        training rows, and the log10 probability of the text by the smoothed frequencies and by the model."""
        sent = self.reader.send(self.chunks.sparkSession, self.tables)

        def run(batches):
            import pyarrow as pa

            reader, tables = Chunks.receive(sent)
            words = reader.words
            for b in batches:
                for keys, train, sizes, ids, count, rank, hashes in reader.read(b):
                    first = np.cumsum(sizes) - sizes
                    known = np.add.reduceat((count > 0).astype(np.int64)[ids], first)
                    base = np.add.reduceat(words.unigram(count)[ids], first)
                    own = np.add.reduceat(log_probabilities(Events(ids, sizes, hashes, count, rank, words), words, tables), first)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(train, pa.bool_()), pa.array(sizes), pa.array(known),
                                                      pa.array(base / np.log(10)), pa.array(own / np.log(10))],
                                                     ["doc_id", "train", "n_tokens", "n_known", "base", "score"])

        return self.chunks.select(*NEEDED).mapInArrow(giving_back(run), "doc_id long, train boolean, n_tokens long, n_known long, base double, score double")


BLOCKS = 64  # parts of the gradient that are added up apart


def _gradient(chunks: DataFrame, reader: Chunks, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The sums over the training rows of ``chunks``."""
    sent = reader.send(chunks.sparkSession, tables)

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        reader, tables = Chunks.receive(sent)
        sums = [np.zeros((len(t), t.shape[1] + 1), np.float32) for t in (tables.by_class, tables.by_word)]
        for b in batches:
            for _, train, sizes, ids, count, rank, hashes in reader.read(b):
                kept = np.repeat(train, sizes)
                add_gradient(Events(ids[kept], sizes[train], hashes, count, rank, reader.words), reader.words, tables, *sums)
        if sums[0][:, -1].any():
            parts = [np.split(s, BLOCKS) for s in sums]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(range(BLOCKS), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int32()),
                "a": pa.array([p.tobytes() for p in parts[0]], pa.binary()), "b": pa.array([p.tobytes() for p in parts[1]], pa.binary())})

    def total(batches):
        import pyarrow as pa

        last, sums = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([s.astype("f4").tobytes()], pa.binary()) for s in sums)], ["block", "a", "b"])

        for b in batches:
            for block, a, c in zip(*(v.to_pylist() for v in b.columns), strict=True):
                one = [np.frombuffer(v, np.float32).astype(np.float64) for v in (a, c)]
                if block != last:
                    if sums:
                        yield row()
                    last, sums = block, one
                else:
                    sums = [s + v for s, v in zip(sums, one, strict=True)]
        if sums:
            yield row()

    parts = chunks.select(*NEEDED).mapInArrow(giving_back(add), "block int, task int, a binary, b binary")
    parts = parts.repartition("block").sortWithinPartitions("block", "task").select("block", "a", "b")
    found = {r["block"]: (r["a"], r["b"]) for r in parts.mapInArrow(giving_back(total), "block int, a binary, b binary").collect()}
    sent.unpersist()
    out = []
    for i, t in enumerate((tables.by_class, tables.by_word)):
        flat = [np.frombuffer(found[k][i], np.float32) if k in found else np.zeros(len(t) // BLOCKS * (t.shape[1] + 1), np.float32) for k in range(BLOCKS)]
        out.append(np.concatenate(flat).reshape(len(t), t.shape[1] + 1))
    return tuple(out)


def train(docs: DataFrame, rounds: int = 8, chunk_tokens: int = 1 << 21, folder: str | None = None) -> Model:
    """The model of ``docs`` (doc_id, text, train), learned from all rows with ``train``.

    The stored files are dealt out over the rounds, so each is gone through once; with fewer files than
    rounds they are taken in turn.  Without a training row all words are unseen and nothing is learned."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "language")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)  # a small input
    encode(docs, chunk_tokens).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    chunks = spark.read.schema(CHUNK).parquet(f"{folder}/chunks")
    pairs = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts").where("counts > 0")
    counts = stored(pairs.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")), f"{folder}/counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    # the most frequent words, as whole steps of a sixty-fourth of an octave, are those of at least some count
    power = F.length(F.bin("c")) - 1
    step = (power * 64 + F.floor((F.col("c") - F.expr("shiftleft(1L, length(bin(c)) - 1)")) * 64 / F.expr("shiftleft(1L, length(bin(c)) - 1)"))).cast("int")
    short = F.length("word") <= LONG
    steps = counts.groupBy(step.alias("k")).agg(F.sum("c").alias("s"), F.count("c").alias("n"), F.count_if(short).alias("short")).collect()
    least, free = 64 * 64, FREQUENT
    for r in sorted(steps, key=lambda r: -r["k"]):
        free -= r["short"]
        if free < 0:
            break
        least = r["k"]
    top = [(bytes(r["word"]), r["c"]) for r in counts.where(short & (step >= least)).collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    head = HEAD_CLASSES * WIDE
    sums: dict[int, list] = {}
    for r in steps:
        here = sums.setdefault(min(r["k"] // 64, OCTAVES - 1), [0, 0])
        here[0], here[1] = here[0] + r["s"], here[1] + r["n"]
    for _, c in top[:head]:
        here = sums[min(c.bit_length() - 1, OCTAVES - 1)]
        here[0], here[1] = here[0] - c, here[1] - 1
    words = Words([c for _, c in top[:head]], {k: (s, m) for k, (s, m) in sums.items() if m}, n, v)
    frequent = {w: (c, rank if rank < head else -1) for rank, (w, c) in enumerate(top)}
    # the counts of all other words go back to the chunks that hold them
    known = spark.createDataFrame([(w,) for w, _ in top], "word binary")
    entries = chunks.select("part", "chunk", F.posexplode("words").alias("number", "word"))
    rare = entries.join(F.broadcast(known), "word", "left_anti").join(counts.where(~(short & (step >= least))), "word")
    rare = rare.select("part", "chunk", "number", "c").repartition("part").sortWithinPartitions("part", "chunk", "number")
    _joined(rare).write.partitionBy("part").parquet(f"{folder}/rare")
    reader, tables, optimizer = Chunks(words, frequent, f"{folder}/rare"), Tables(), Optimizer(words)
    files = sorted(chunks.inputFiles())
    for k in range(rounds if files and n else 0):
        mine = files[k::rounds] if len(files) >= rounds else [files[k % len(files)]]
        tables = optimizer.step(tables, *_gradient(spark.read.schema(CHUNK).parquet(*mine), reader, tables))
    return Model(chunks, reader, tables)


def _joined(rare: DataFrame) -> DataFrame:
    """The sorted rows (part, chunk, number, c) as one row for each chunk, in one stream."""

    def run(batches):
        import pyarrow as pa

        last, numbers, counts = None, [], []

        def row():
            n, c = np.concatenate(numbers).astype("<u4"), np.concatenate(counts).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([n.tobytes()], pa.binary()),
                                               pa.array([c.tobytes()], pa.binary())], ["part", "chunk", "numbers", "counts"])

        for b in batches:
            part, chunk, number, c = (x.to_numpy() for x in b.columns)
            cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (part[lo], chunk[lo]) != last and numbers:
                    yield row()
                    numbers, counts = [], []
                last = (part[lo], chunk[lo])
                numbers.append(number[lo:hi])
                counts.append(c[lo:hi])
        if numbers:
            yield row()

    return rare.mapInArrow(giving_back(run), "part long, chunk long, numbers binary, counts binary")


def held_out(doc_id) -> F.Column:
    """Rows that never take part in learning: crc32 of the id as text is a multiple of 10 (a null id is none)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Learned from the rows that are not held out.  A null or empty text has one token, its end.  Repeated rows count
    as rows, also in learning; a null id is not held out.  An empty table gives no row; without a training row no
    token is known and both scores are 0.  Other columns are ignored."""
    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), (~held_out(F.col("doc_id"))).alias("train"))
    model = train(rows, **options)
    return model.score().select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                                F.lit(model.reader.words.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")

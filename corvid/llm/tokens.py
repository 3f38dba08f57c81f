"""Token ids of whole documents, packed into Arrow files of equal-length sequences.

Each range of the ordered documents becomes one shard of two Arrow IPC files:

* ``seq-NNNNNN.arrow``: batches with the fixed-size-list columns ``ids`` (uint16, or uint32
  for a larger vocabulary) and
  ``mask`` (boolean, true for a real id).  Memory-mapped, any sequence is a zero-copy slice;
* ``doc-NNNNNN.arrow``: doc_id and n_tokens of the shard's documents, in order.

The documents of a shard follow one another without gaps; only its last sequence
is filled up, with id 0 and mask 0.
"""

from __future__ import annotations

import re
from codecs import charmap_decode
from itertools import accumulate, chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import WholeFile, filesystem, giving_back, pick, stored, work_dir, worker_memory


#: Bytes of text encoded at once, and new parts whose ids are lists at one time.
CHUNK_BYTES = 2 << 20
NEW_PARTS = 10_000


#: Latin letters, and ASCII marks that the pre-tokenizer cuts into runs (an apostrophe may begin a piece of letters).
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: A word, its marks, and after one line feed another word and its marks.
SHAPE = re.compile("([{0}]+)([{1}]*)(?:\n([{0}]+)([{1}]*))?".format(LETTERS, re.escape(MARKS))).fullmatch


def _spelling(cut) -> str:
    """For each byte the character that stands for it after the pre-tokenizer."""
    table = ["\ufffe"] * 256
    for c in [*LETTERS, *MARKS, "\n"]:
        for byte, char in zip(c.encode(), cut(c)[0], strict=True):
            table[byte] = char
    return "".join(table)


class PieceEncoder:
    """Token ids of texts, with every distinct part given to the tokenizers library once.

    A byte-level BPE tokenizer first cuts a text into pieces and encodes each piece
    alone.  A space next to a character that is not white space always begins a piece,
    so texts are cut there; the ids of a part are kept in a table of at most
    ``most`` parts, and only parts that are not in it are encoded: Latin words, with marks behind
    them and perhaps another such word in the next line, piece by piece by the tokenizer's model
    (``SHAPE``), all others by the whole tokenizer.  Texts in
    which a space stands between white space are given to the tokenizer whole, and so
    are all texts when the tokenizer is found to cut otherwise.  With ``added`` the ids are
    those of the unchanged tokenizer: texts that hold one of its added tokens are given to it
    whole; without, special tokens are encoded as any other text.
    """

    def __init__(self, path: str, most: int = 250_000, added: bool = False):
        import tokenizers

        self.most = most
        self.whole = tokenizers.Tokenizer.from_file(path)
        if not added:
            self.whole.encode_special_tokens = True
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.model = self.whole.model
        pre = self.whole.pre_tokenizer
        cut = lambda x: [p for p, _ in pre.pre_tokenize_str(x)] if pre else []
        self.space = cut(" ")[0] if cut(" ") else ""
        self.cuts = self.whole.normalizer is None and cut(" abc") == [self.space + "abc"] and len(cut("abc.\nD e!!b")) == 7
        self.shaped = self.cuts and len(cut("a" + MARKS + "\nb" + MARKS)) == 5 and all(len(cut(c)[0]) == len(c.encode()) for c in [*LETTERS, *MARKS, "\n"])
        self.spelling = _spelling(cut) if self.shaped else ""
        self.runs: dict[str, list[int]] = {}
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lens, self.unsure = (np.empty(0, t) for t in (np.uint32, np.int64, np.int64, bool))

    def _new(self, parts: list[str]) -> list[list[int]]:
        """Ids of new parts, each with the space before it."""
        out: list = [None] * len(parts)
        rest, space, tokenize, run = [], self.space, self.model.tokenize, self._run
        spelled = lambda x: x if x.isascii() else charmap_decode(x.encode(), "strict", self.spelling)[0]
        for i, part in enumerate(parts):
            if not self.shaped:
                rest.append(i)
            elif part.isascii() and part.isalpha():
                out[i] = [x.id for x in tokenize(space + part)]
            elif found := SHAPE(part):
                word, marks, below, more = found.groups()
                ids = [x.id for x in tokenize(space + spelled(word))]
                if marks:
                    ids += run(marks)
                if below:
                    ids += run("\n")
                    ids += [x.id for x in tokenize(spelled(below))]
                    if more:
                        ids += run(more)
                out[i] = ids
            else:
                rest.append(i)
        for lo in range(0, len(rest), 1000):
            some = rest[lo:lo + 1000]
            for i, e in zip(some, self.whole.encode_batch_fast([" " + parts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _run(self, marks: str) -> list[int]:
        """Ids of a run of marks; some short ones are kept."""
        if marks in self.runs:
            return self.runs[marks]
        ids = [x.id for x in self.model.tokenize(charmap_decode(marks.encode(), "strict", self.spelling)[0])]
        if len(marks) <= 4 and len(self.runs) < 10_000:
            self.runs[marks] = ids
        return ids

    def _add(self, parts: list[str]):
        """Put new parts behind the known ones; beyond ``most`` they stay for this call only, without a name.
        Ids are lists for a few parts at a time only: lists take many times the room of an array."""
        sizes, flats = [], []
        for lo in range(0, len(parts), NEW_PARTS):
            ids = self._new(parts[lo:lo + NEW_PARTS])
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        n, flat = np.concatenate(sizes), np.concatenate(flats)
        unsure = np.array([not x or x[0].isspace() for x in parts], bool)
        known = len(self.index)
        self.index.update(zip(parts[:max(0, self.most - known)], range(known, known + len(parts))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.ids, self.lens, self.unsure = (np.concatenate(x) for x in ((self.ids, flat), (self.lens, n), (self.unsure, unsure)))

    def _forget(self):
        """Drop the parts without a name."""
        n = len(self.index)
        if len(self.starts) > n:
            self.ids = self.ids[: int(self.starts[n])]
            self.starts, self.lens, self.unsure = (x[:n] for x in (self.starts, self.lens, self.unsure))

    def encode(self, texts, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each closed by ``end``; ids of each text)
        of an Arrow array of strings."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cuts:
            parts = pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        else:
            parts = pc.split_pattern(texts, " ")
        words = parts.flatten()
        counts = pc.list_value_length(parts).to_numpy() - 1
        later = np.ones(len(words), bool)
        later[np.cumsum(counts + 1) - counts - 1] = False
        heads = words.filter(pa.array(~later)).to_pylist()
        words = words.filter(pa.array(later)).dictionary_encode()
        names = words.dictionary.to_pylist()
        lead = [e.ids for e in self.whole.encode_batch_fast(heads, add_special_tokens=False)]
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.index) + np.arange(len(new))
            self._add([names[i] for i in new.tolist()])
        at = at[words.indices.to_numpy()]
        lens = self.lens[at]
        body = self._gather(self.starts[at], lens)
        edges = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        # a part that is empty or begins with white space follows a space that may stand between white space
        unsure = set(np.repeat(np.arange(len(texts)), counts)[self.unsure[at]].tolist())
        for token in self.added:
            unsure.update(np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist())
        close = np.array([] if end is None else [end], np.uint32)
        out, sizes = [np.empty(0, np.uint32)], np.empty(len(texts), np.int64)
        for i, ids in enumerate(lead):
            tail = body[edges[i]:edges[i + 1]]
            if i in unsure:
                ids, tail = self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, tail[:0]
            out += [np.array(ids, np.uint32), tail, close]
            sizes[i] = len(ids) + len(tail) + len(close)
        self._forget()
        return np.concatenate(out), sizes

    def _gather(self, starts: np.ndarray, lens: np.ndarray, most: int = 1 << 15) -> np.ndarray:
        """The runs ``ids[start:start + len]``, one after another; some at a time, since places take
        many times the room of ids."""
        out = np.empty(int(lens.sum()), np.uint32)
        done = 0
        for lo in range(0, len(starts), most):
            at, n = starts[lo:lo + most], lens[lo:lo + most]
            at, n = at[n > 0], n[n > 0]
            if not len(at):
                continue
            step = np.ones(int(n.sum()), np.int64)
            step[0] = at[0]
            step[np.cumsum(n)[:-1]] = at[1:] - (at[:-1] + n[:-1] - 1)
            out[done:done + len(step)] = self.ids[np.cumsum(step)]
            done += len(step)
        return out


def id_type(vocabulary: int):
    """The smallest unsigned type that holds every id."""
    import pyarrow as pa

    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Packs ids into rows of ``length`` and writes them in batches of ``rows``."""

    def __init__(self, out, kind, length: int, rows: int):
        import pyarrow as pa

        self.pa, self.kind, self.length, self.rows = pa, kind, length, rows
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(out, self.schema)
        self.wait, self.n, self.seqs = [], 0, 0

    def _write(self, ids: np.ndarray, real: int):
        pa = self.pa
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in
                 (pa.array(ids, self.kind), pa.array(np.arange(len(ids)) < real, pa.bool_()))]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.seqs += len(ids) // self.length

    def add(self, ids: np.ndarray):
        self.wait.append(ids)
        self.n += len(ids)
        full = self.length * self.rows
        if self.n >= full:
            ids = np.concatenate(self.wait)
            for lo in range(0, self.n - self.n % full, full):
                self._write(ids[lo:lo + full], full)
            self.wait = [ids[self.n - self.n % full:]]
            self.n %= full

    def close(self):
        if self.n:
            ids = np.concatenate(self.wait)
            self._write(np.concatenate([ids, np.zeros(-self.n % self.length, ids.dtype)]), self.n)
        self.file.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, length: int = 2048, end: int | None = 0,
                    rows: int = 64) -> DataFrame:
    """Write the shards; one row (shard, documents, tokens, sequences) for each.

    The documents are dealt out by ranges of doc_id (a null id comes first; rows with
    equal ids are ordered by a hash of their text, and equal rows stay apart as rows),
    so a shard's documents precede those of the next.  A null text is empty: only the
    end id.  Other columns are ignored; an empty table makes no shard.
    """
    docs = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    docs = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    name = f"tokenizer {tokenizer}"

    def write(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        batches = iter(batches)
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        coder = worker_memory(name, lambda: PieceEncoder(tokenizer, added=True))
        shard = TaskContext.get().partitionId()
        n_docs = n_tokens = 0
        index = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        with WholeFile(f"{folder}/seq-{shard:06d}.arrow") as a, WholeFile(f"{folder}/doc-{shard:06d}.arrow") as b:
            seqs, docs_file = SequenceWriter(a, id_type(coder.whole.get_vocab_size()), length, rows), pa.ipc.new_file(b, index)
            while batch is not None:
                texts, sizes = batch.column(1), []
                for lo, hi in _chunks(texts, CHUNK_BYTES):
                    ids, n = coder.encode(texts.slice(lo, hi - lo), end)
                    seqs.add(ids)
                    sizes.append(n)
                sizes = np.concatenate(sizes)
                docs_file.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], schema=index))
                n_docs, n_tokens = n_docs + len(sizes), n_tokens + int(sizes.sum())
                batch = next(batches, None)
            seqs.close()
            docs_file.close()
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in (
            ("shard", shard), ("documents", n_docs), ("tokens", n_tokens), ("sequences", seqs.seqs))})

    return docs.mapInArrow(giving_back(write, keeps=name), "shard long, documents long, tokens long, sequences long")


def _chunks(texts, most: int):
    """(from, to) of runs of texts with about ``most`` bytes."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


def open_shard(folder: str, shard: int, kind: str = "seq"):
    """The Arrow file of a shard, memory-mapped where the folder is a local one."""
    import pyarrow as pa
    from pyarrow import fs as pafs

    fs, path = filesystem(f"{folder}/{kind}-{shard:06d}.arrow")
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def sequence(folder: str, shard: int, k: int, rows: int = 64):
    """(ids, mask) of sequence ``k`` of a shard: slices of the mapped file."""
    batch = open_shard(folder, shard).get_batch(k // rows)
    return batch.column(0)[k % rows].values, batch.column(1)[k % rows].values


def read_documents(spark, shards: list, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read from the files.
    ``shards``: (shard, tokens) of every shard; one task for each."""
    shards = sorted((int(s), int(n)) for s, n in shards)
    bases = accumulate([0, *(n for _, n in shards)])
    todo = spark.createDataFrame([(s, b) for (s, _), b in zip(shards, bases)], "shard long, base long")

    def read(batches):
        from zlib import crc32

        import pyarrow as pa

        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seqs = open_shard(folder, shard)
                ids, k = np.empty(0, np.uint32), 0
                docs = open_shard(folder, shard, "doc")
                for d in range(docs.num_record_batches):
                    part = docs.get_batch(d)
                    sizes = part.column(1).to_numpy()
                    sums = []
                    for n in sizes:
                        if len(ids) < n:
                            more = [ids]
                            have = len(ids)
                            while have < n:
                                got = seqs.get_batch(k)
                                flat = got.column(0).flatten().to_numpy()[got.column(1).flatten().to_numpy(zero_copy_only=False)]
                                more.append(flat.astype("<u4"))
                                have, k = have + len(flat), k + 1
                            ids = np.concatenate(more)
                        sums.append(crc32(ids[:n].astype("<u4").tobytes()))
                        ids = ids[n:]
                    starts = start + np.concatenate([[0], np.cumsum(sizes)])
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "start": pa.array(starts[:-1], pa.int64()),
                                                      "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    return todo.repartition(max(1, len(shards))).mapInArrow(giving_back(read, keeps="tokenizer"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the sequences into a new shared folder and read the documents back.  What
    the driver holds is one row (shard, tokens) for each file."""
    spark = docs.sparkSession
    folder = work_dir(spark, "tokens")
    written = stored(write_sequences(docs, f"{folder}/shards", tokenizer, **options), f"{folder}/manifest")
    shards = written.select("shard", "tokens").collect()
    return read_documents(spark, shards, f"{folder}/shards")

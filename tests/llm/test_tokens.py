import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corvid.llm import tokens
from corvid.llm.shared import giving_back, work_dir, worker_memory
from tests.llm.fixtures import documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_parts_give_the_ids_of_whole_texts(library):
    random.seed(1)
    marks = [" ", " ", "\n", "\t", "a", "B", "é", "1", ".", ",", "!", "<|endoftext|>", "　", " ", "'s", "日", "\r", "  ", "the", "\x1c", "\x85", "ñ", "ª", "²"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 25))) for _ in range(4000)]
    for most in (10, 400_000):  # also with a table that is always full
        coder = tokens.PieceEncoder(PATH, most)
        assert coder.cuts
        for _ in range(2):
            ids, sizes = coder.encode(pa.array(texts), 0)
            want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(coder.index) <= most


def test_documents_come_back_in_order(spark, library):
    rows = [(5, "b c"), (3, None), (9, ""), (None, "no id"), (4, prose(1, 5000)), (7, "same"), (7, "same"), (7, "other"), (-1, "ä " * 300)]
    out = tokens.tokenize_documents(documents(spark, rows), PATH, length=64, rows=4).collect()
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    by_start = sorted(out, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.concatenate([[0], np.cumsum([r.n_tokens for r in by_start])[:-1]]).tolist()
    ids = [r.doc_id for r in by_start]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_sequences_have_equal_length_and_masks(spark, library):
    docs = documents(spark, [(i, prose(i, 20 + i)) for i in range(60)])
    folder = work_dir(spark, "tokens-test")
    shards = tokens.write_sequences(docs.repartition(3), folder, PATH, length=32, rows=5).collect()
    flat = []
    for s in sorted(shards, key=lambda r: r.shard):
        real = 0
        for k in range(s.sequences):
            ids, mask = tokens.sequence(folder, s.shard, k, rows=5)
            assert len(ids) == len(mask) == 32
            mask = np.array(mask.to_pylist())
            assert k == s.sequences - 1 or mask.all()
            flat += np.array(ids.to_pylist())[mask].tolist()
            real += int(mask.sum())
        assert real == s.tokens
    want = [i for k in range(60) for i in [*library.encode(prose(k, 20 + k), add_special_tokens=False).ids, 0]]
    assert flat == want


def test_empty_table(spark):
    assert tokens.tokenize_documents(documents(spark, []), PATH).count() == 0


def test_added_tokens_are_those_of_the_unchanged_tokenizer(spark):
    plain = Tokenizer.from_file(PATH)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|>y the end"), (4, "a < |endoftext|> b"), (5, "the end <|endoftext|>  \n"), (6, prose(1, 50))]
    assert plain.encode(rows[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.tokenize_documents(documents(spark, rows), PATH).collect()}
    want = [(i, np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want}


def test_worker_memory_is_bounded(monkeypatch):
    """Pipeline: the ids of a whole chunk's new parts were lists at once, and the encoder stayed with
    the worker through the tasks of all later stages."""
    some, new = [], tokens.PieceEncoder._new
    monkeypatch.setattr(tokens.PieceEncoder, "_new", lambda self, parts: some.append(len(parts)) or new(self, parts))
    text = " ".join(f"word{i}" for i in range(3 * tokens.NEW_PARTS))
    coder = tokens.PieceEncoder(PATH)
    ids, sizes = coder.encode(pa.array([text]), None)
    assert ids.tolist() == coder.whole.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
    assert len(some) == 3 and max(some) <= tokens.NEW_PARTS
    made = []
    run = lambda batches: iter([worker_memory("table", lambda: made.append(1) or "t")])
    for _ in range(2):
        assert list(giving_back(run, keeps="table")([])) == ["t"]
    assert len(made) == 1
    assert list(giving_back(lambda batches: iter([]))([])) == []  # a task of another stage
    assert list(giving_back(run, keeps="table")([])) == ["t"] and len(made) == 2
    list(giving_back(lambda batches: iter([]))([]))


def test_words_with_marks_and_line_feeds_take_the_model(library):
    """op2_token_ids: parts such as ``end.\\nNew`` or ``word$$$`` were given to the whole tokenizer one by one."""
    random.seed(2)
    words, ends = ["Haus", "élan", "ñu", "ªb", "THE", "ſt", "don't", "x_y", "Ωm", "a1", "日", ""], [*tokens.MARKS, "...", "$$$", "!!", ",&&&", "'s", "!'s", "", "", "\n", "\n\n", "\x1c"]
    pick = random.choice
    texts = [" ".join(pick(words) + pick(ends) + pick(["", "\n"]) + pick(words) + pick(ends) for _ in range(random.randint(1, 9))) for _ in range(6000)]
    coder = tokens.PieceEncoder(PATH)
    assert coder.shaped
    ids, sizes = coder.encode(pa.array(texts), None)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    class Counted:
        given = 0

        def encode_batch_fast(self, texts, **kw):
            self.given += len(texts)
            return library.encode_batch_fast(texts, **kw)

    coder = tokens.PieceEncoder(PATH)
    coder.whole = counted = Counted()
    text = "The Haus,\nNeu élan$$$ ends.\nÜber, ñu.&&& mañana!!"
    assert coder.encode(pa.array([text]), None)[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert counted.given == 1  # the part before the first space


def test_gathering_ids_takes_little_more_room_than_the_ids():
    """Pipeline: the places of a whole chunk's ids were held twice, eight bytes each."""
    import tracemalloc

    coder = tokens.PieceEncoder(PATH)
    coder.ids = np.arange(5000, dtype=np.uint32)
    rng = np.random.default_rng(1)
    starts, lens = rng.integers(0, 4990, 400_000), rng.integers(0, 9, 400_000)
    tracemalloc.start()
    got = coder._gather(starts, lens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [i for s, n in zip(starts.tolist(), lens.tolist()) for i in range(s, s + n)]
    assert peak < 2.5 * got.nbytes

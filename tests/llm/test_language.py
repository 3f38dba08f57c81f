import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from corvid.llm import language
from corvid.llm.shared import work_dir
from tests.llm.fixtures import documents, prose

BLANK = " \t\n\v\f\r"


def tokens(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANK:
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return [*out, *[word] * bool(word), None]


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by the contract, plainly."""
    held = lambda i: i is not None and crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
             sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    return got


ODD = [(1, None), (2, ""), (None, "no id AT all"), (3, " \n\t"), (4, prose(2, 40)), (4, prose(2, 40)), (4, "other text"), (5, "É é ÀB à b c"),
       (6, "x" * 5000), (7, prose(1, 3000)), (8, ("long " * 300_000) + "end"), (10, "only here"), (20, "unseen wörd")]


def test_base_scores_and_odd_rows(spark):
    rows = ODD + [(i, prose(i % 37, 30 + i % 50)) for i in range(100, 400)]
    got = same(language.score_documents(documents(spark, rows)).collect(), base(rows))
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)  # better than word frequencies on rows not learned from


def test_chunks_and_rare_words_change_nothing_but_the_steps(spark, monkeypatch):
    """With few frequent words nearly all counts take the way through the join."""
    rows = ODD[:-3] + [(i, prose(i % 37, 30 + i % 50)) for i in range(100, 250)]
    whole = language.train(_flagged(spark, rows), rounds=0)
    monkeypatch.setattr(language, "FREQUENT", 5)
    few = language.train(_flagged(spark, rows), rounds=0, chunk_tokens=500)
    assert len(few.reader.frequent) <= 5 < len(whole.reader.frequent)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[4])
    for a, b in zip(*(sorted((tuple(r) for r in m.score().collect()), key=key) for m in (whole, few)), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:5], b[4:5])


def _flagged(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), (~language.held_out(F.col("doc_id"))).alias("train"))


def test_empty_and_no_training_row(spark):
    assert language.score_documents(documents(spark, [])).count() == 0
    held = [i for i in range(200) if crc32(str(i).encode()) % 10 == 0][:3]
    got = language.score_documents(documents(spark, [(i, "a b") for i in held])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


def _setup(seed=1, n_words=9000, n=4000):
    """A vocabulary with head, octaves and unseen words, and events over it."""
    rng = np.random.default_rng(seed)
    count = np.concatenate([rng.integers(1, 4000, n_words), [0, 0]])
    order = np.argsort(-count, kind="stable")[: language.HEAD_CLASSES * language.WIDE]
    rank = np.full(len(count), -1)
    rank[order] = np.arange(len(order))
    octaves = {}
    for c in count[(rank < 0) & (count > 0)].tolist():
        s, m = octaves.get(c.bit_length() - 1, (0, 0))
        octaves[c.bit_length() - 1] = (s + c, m + 1)
    words = language.Words([int(count[i]) for i in order], octaves, int(count.sum()), n_words)
    hashes = rng.integers(0, 1 << 63, len(count), np.int64).astype(np.uint64)
    ids = rng.integers(0, len(count), n).astype(np.uint32)
    sizes = np.array([n // 4, n // 4, n - n // 2])
    tables = language.Tables()
    tables.by_class[:] = rng.normal(0, 0.5, tables.by_class.shape)
    tables.by_word[:] = rng.normal(0, 0.5, tables.by_word.shape)
    return words, count, rank, hashes, ids, sizes, tables


def test_probabilities_add_up_to_one():
    words, count, rank, hashes, _, _, tables = _setup()
    assert abs(words.mass.sum() - 1) < 1e-12
    seen = np.flatnonzero(count > 0)
    every = np.concatenate([seen, [len(count) - 1]])  # all known words and one unseen
    for context in ([3, 8], [len(count) - 2, 0]):
        ids = np.concatenate([np.r_[context, w] for w in every]).astype(np.uint32)
        e = language.Events(ids, np.full(len(every), 3), hashes, count, rank, words)
        p = np.exp(language.log_probabilities(e, words, tables)[2::3])
        assert abs(p.sum() - 1) < 1e-4
    # without weights the model is the smoothed frequency
    e = language.Events(every.astype(np.uint32), np.array([len(every)]), hashes, count, rank, words)
    assert np.allclose(language.log_probabilities(e, words, language.Tables()), words.unigram(count)[every], atol=1e-5)


def test_forward_and_gradient_against_loops():
    words, count, rank, hashes, ids, sizes, tables = _setup(n=60)
    e = language.Events(ids, sizes, hashes, count, rank, words)
    got = language.log_probabilities(e, words, tables)
    grads = [np.zeros((len(t), t.shape[1] + 1), np.float32) for t in (tables.by_class, tables.by_word)]
    language.add_gradient(e, words, tables, *grads)
    want = [np.zeros_like(g, dtype=np.float64) for g in grads]
    k64 = lambda x: np.array([x], np.uint64)
    at = 0
    for size in sizes:
        before = [language.START, language.START]  # two back, one back
        for i in ids[at:at + size]:
            f = [int(language.mix(k64(v))[0]) for v in (
                int(before[1]) * int(language._KEYS[0]) % 2**64, int(before[0]) * int(language._KEYS[1]) % 2**64,
                (int(before[1]) * int(language._KEYS[2]) + int(before[0]) * int(language._KEYS[3])) % 2**64)]
            cls = int(words.classes(count[[i]], rank[[i]])[0])
            rows = [x >> (64 - language.CLASS_ROWS) for x in f]
            z = words.start + sum(tables.by_class[r].astype(float) for r in rows)
            p = np.exp(z) / np.exp(z).sum()
            logp = math.log(p[cls])
            for r in rows:
                want[0][r, :-1] += p - (np.arange(len(p)) == cls)
                want[0][r, -1] += 1
            if rank[i] >= 0:
                rows = [int(language.mix(k64((x + cls * int(language._KEYS[4])) % 2**64))[0]) >> (64 - language.WORD_ROWS) for x in f[:2]]
                z = words.within[cls].astype(float) + sum(tables.by_word[r].astype(float) for r in rows)
                p = np.exp(z) / np.exp(z).sum()
                slot = rank[i] % language.WIDE
                logp += math.log(p[slot])
                for r in rows:
                    want[1][r, :-1] += p - (np.arange(len(p)) == slot)
                    want[1][r, -1] += 1
            elif count[i]:
                logp += math.log((count[i] + 0.1) / words.z) - math.log(words.mass[cls])
            assert abs(logp - got[at]) < 1e-4
            before = [before[1], hashes[i]]
            at += 1
    assert all(np.allclose(g, w, atol=1e-4) for g, w in zip(grads, want, strict=True))


def test_distributed_gradient_equals_one_pass(spark):
    rows = [(i, prose(i % 37, 30 + i % 50)) for i in range(100, 300)]
    folder = work_dir(spark, "lm-test")
    model = language.train(_flagged(spark, rows).repartition(3), rounds=2, chunk_tokens=700, folder=folder)
    got = language._gradient(model.chunks, model.reader, model.tables)
    want = [np.zeros_like(g) for g in got]
    for b in model.chunks.select(*language.NEEDED).toArrow().to_batches():
        for _, train, sizes, ids, count, rank, hashes in model.reader.read(b):
            kept = np.repeat(train, sizes)
            language.add_gradient(language.Events(ids[kept], sizes[train], hashes, count, rank, model.reader.words), model.reader.words, model.tables, *want)
    assert all(np.allclose(g, w, atol=1e-3) for g, w in zip(got, want, strict=True)) and got[0][:, -1].sum() == 3 * model.reader.words.n


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa bbbb cc", b" " * 9, b"x" * 30, b"ab\tcd\nef gh"])
def test_pieces_cut_between_words(text):
    for most in (1, 3, 8):
        assert [w for p in language.pieces(text, most) for w in p.split()] == text.split()

import numpy as np
import pytest

from corvid.llm.lines import SPACE, CuckooFilter, LineIndex
from corvid.llm.shared import work_dir
from tests.llm.fixtures import documents, prose


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 62), 1 << 62, 3000)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all()
    other = rng.integers(-(1 << 62), 1 << 62, 20000)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.05
    assert f.insert(keys[:1500]) and f.contains(keys).all()
    again = CuckooFilter.load(f.dump())
    assert again.contains(keys).all()
    assert CuckooFilter.of(np.array([5] * 3)).contains(np.array([5])).all()  # equal keys
    assert not CuckooFilter.empty(0).contains(keys).any()


COMMON = "This line is long enough to be counted as a common one."


def _rows():
    rows = [(i, f"{prose(i, 12)}\n  {COMMON.upper() if i % 2 else COMMON}\t\nshort\n{prose(i, 9)}") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, f"{COMMON}\n{COMMON}"), (None, COMMON), (6, rows[6][1]), (30, "é" * 40), (31, "é" * 39)]
    return rows


def _brute(rows, least, min_docs):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get(key(x), ())) >= min_docs and i != max((j for j in held[key(x)] if j is not None), default=None) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 5, 10])
def test_clean_equals_brute_force(spark, min_docs):
    docs = documents(spark, _rows()).repartition(3)
    index = LineIndex(spark, work_dir(spark, "lines-test"), n_shards=4, min_chars=40).insert(docs)
    got = sorted((tuple(r) for r in index.clean(docs, min_docs).collect()), key=str)
    assert got == _brute(_rows(), 40, min_docs)


def _state(index):
    refs = sorted(map(tuple, index._table("refs").collect()))
    return refs, sorted(map(tuple, index._table("postings").collect()), key=str)


def test_insert_and_delete_are_reversible(spark):
    rows = _rows()
    first, second = documents(spark, rows[:9]), documents(spark, [(100 + i, t) for i, t in enumerate(t for _, t in rows[4:])])
    index = LineIndex(spark, work_dir(spark, "lines-test"), n_shards=4).insert(first)
    before = _state(index)
    index.insert(second)
    whole = LineIndex(spark, work_dir(spark, "lines-test"), n_shards=4).insert(first.unionByName(second))
    assert _state(index) == _state(whole)  # in two steps or in one
    index.delete(second.select("doc_id"))
    assert _state(index) == before
    # the filters know every key that is left, and hardly any that is gone
    left = {(r.a, r.b) for r in index._table("refs").collect()}
    gone = {(r.a, r.b) for r in whole._table("refs").collect()} - left
    filters = {r.shard: CuckooFilter.load(r.slots) for r in index._table("filters").collect()}
    known = lambda a, b: a % 4 in filters and bool(filters[a % 4].contains(np.array([a ^ b], np.int64))[0])
    assert all(known(a, b) for a, b in left) and sum(known(a, b) for a, b in gone) <= 1
    index.delete(spark.createDataFrame([(-5,)], "doc_id long"))
    assert _state(index) == before


def test_empty_table(spark):
    docs = documents(spark, [])
    index = LineIndex(spark, work_dir(spark, "lines-test")).insert(docs)
    assert index.clean(docs, 5).count() == 0
    some = documents(spark, [(1, "a\nb")])
    assert [tuple(r) for r in index.clean(some, 5).collect()] == [(1, 2, 0, "a\nb")]


def test_parts_equal_brute_force_and_need_the_filters(spark):
    docs = documents(spark, _rows()).repartition(3)
    index = LineIndex(spark, work_dir(spark, "lines-test"), n_shards=4).insert_in_parts(docs, 3)
    assert index.generation == 3
    assert sorted((tuple(r) for r in index.clean(docs, 5).collect()), key=str) == _brute(_rows(), 40, 5)
    # with filters that know nothing a common key is split into several, and its lines stay
    blind = LineIndex(spark, work_dir(spark, "lines-test"), n_shards=4)
    table = blind._table
    blind._table = lambda name: table(name).limit(0) if name == "filters" else table(name)
    blind.insert_in_parts(docs, 3)
    assert blind._table("refs").groupBy("a", "b").count().where("count > 1").count() > 0


def test_shards_follow_the_keys(spark, monkeypatch):
    from corvid.llm import lines

    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 2)
    docs = documents(spark, _rows()).repartition(3)
    index = LineIndex(spark, work_dir(spark, "lines-test")).insert_in_parts(docs, 2)
    keys = index._table("refs").count()
    assert keys <= 2 * index.shards < 4 * keys
    assert sorted((tuple(r) for r in index.clean(docs, 2).collect()), key=str) == _brute(_rows(), 40, 2)

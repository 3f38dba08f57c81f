import itertools
import random
import re

import numpy as np
import pytest

from corvid.llm import graph, similar
from corvid.llm.shared import work_dir
from tests.llm.fixtures import documents, prose


def _set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def _brute(rows, n, percent):
    sets = [_set(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if rows[i][0] == rows[j][0] or a and b and 100 * len(a & b) >= percent * len(a | b):
            group[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(i)
    return sorted((i, len(sets[k]), min(ids[top(k)]) if sets[k] else i) for k, (i, _) in enumerate(rows))


def _got(docs, n, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar.similar_components(docs, n, percent).collect())


def _rows(seed, groups=25, size=8):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 12, 40, 90]))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_equals_brute_force(spark, n, percent):
    rows = _rows(1)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"), (1006, prose(1, 9000)),
             (1007, prose(1, 8990)), (1008, "Ä b c d e f"), (1009, "ä b c d e f")]
    assert _got(documents(spark, rows).repartition(5), n, percent) == _brute(rows, n, percent)


def test_groups_of_many_are_not_paired_out(spark, monkeypatch):
    """A large group of near copies, with n-grams dealt to several tasks and few pairs each."""
    monkeypatch.setattr(similar, "FEW", 3)
    monkeypatch.setattr(similar, "HOT_CLASS", 2)
    rng = random.Random(7)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 250):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(120)] = f"x{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    passage = [f"p{k}" for k in range(60)]
    for i in range(300, 420):  # a shared passage with too much around it to link
        rows.append((i, " ".join([*(f"u{i}_{k}" for k in range(12)), *passage, *(f"v{i}_{k}" for k in range(12))])))
    docs = documents(spark, rows).repartition(6)
    assert _got(docs, 4, 85) == _brute(rows, 4, 85)
    calls = []
    real = similar._verify
    monkeypatch.setattr(similar, "_verify", lambda pairs, *a: (calls.append(pairs.count()), real(pairs, *a))[1])
    similar.similar_components(docs, 4, 85).count()
    assert sum(calls) < 20 * len(rows)


def test_null_and_repeated_ids(spark):
    text = prose(5, 30)
    docs = documents(spark, [(None, text), (3, text), (8, text), (8, text), (9, "alone here now again yes"), (None, "only without id one two")])
    out = {(r.doc_id, r.component_id) for r in similar.similar_components(docs, 4, 85).collect()}
    assert out == {(None, 3), (3, 3), (8, 3), (9, 9), (None, None)}


def test_one_of_each_group_stays(spark):
    text = prose(5, 60)
    rows = [(4, text), (2, text + " end"), (9, text), (9, text), (7, prose(8, 40)), (7, prose(8, 40)), (11, None), (12, ""), (None, text), (13, prose(20, 12))]
    out = similar.drop_near_duplicates(documents(spark, rows))
    assert out.columns == documents(spark, []).columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [11, 12, 13, 2, 7, None]
    assert similar.drop_near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(200)] + [(300, 301), (5, 5), (301, 300)]
    out = {r.id: r.component for r in graph.components(spark.createDataFrame(rows, "u long, v long"), work_dir(spark, "graph-test")).collect()}
    assert out == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


def test_parities_never_hide_a_link():
    rng = random.Random(4)
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.choice([1, 3, 30, 400]))}
        b = {x for x in a if rng.random() < 0.8} | {rng.getrandbits(64) for _ in range(rng.choice([0, 2, 50]))}
        x, y = (np.array(sorted(v), np.uint64) for v in (a, b))
        assert similar.least_difference(similar.parities(x), similar.parities(y)) <= len(a ^ b)
    assert similar.least_difference(similar.parities(x), similar.parities(x)) == 0
    far = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    assert similar.least_difference(similar.parities(far), similar.parities(far[:200])) > 100


def test_sets_with_the_same_first_hash_stay_apart(spark):
    rows = _rows(7)
    docs = documents(spark, rows).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar.similar_components(docs, 4, 85, bits=4).collect())
    assert got == _brute(rows, 4, 85)  # 16 hashes for some hundred sets

import random

import numpy as np

from corvid.llm import decontaminate as dc
from tests.llm.fixtures import documents, prose

ITEM = "Where does the narrow river meet the old harbour road, and who kept the lamp burning there through the winter of 1887?"


def _bench(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, start int")


def _found(spark, rows, items, **kw):
    return {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in dc.contaminated(documents(spark, rows), _bench(spark, items), **kw).collect()}


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    edited = ITEM.replace("narrow", "narow").replace("lamp", "lmap").replace("1887", "1888")
    rows = [(1, f"{prose(1, 80)} {ITEM} {prose(2, 80)}"), (2, ITEM), (3, prose(3, 500)), (4, f"{prose(4, 20)} {edited} {prose(5, 20)}"),
            (5, f"{prose(6, 9)}\n{ITEM.upper()}\n"), (6, prose(1, 40) + " ".join(ITEM.replace(",", "").split("  ")).replace(" ", "\n")),
            (7, ITEM[:40]), (8, None), (9, ""), (None, ITEM), (2, ITEM), (10, prose(9, 30_000) + ITEM)]
    found = _found(spark, rows, [(1, ITEM), (2, None), (3, ""), (4, "tiny"), (None, prose(11, 30))])
    assert {d for d, i in found if i == 1} == {1, 2, 4, 5, 6, None, 10}
    assert all(i == 1 for _, i in found)
    start, end, edits = found[(1, 1)]
    text = rows[0][1].encode()
    assert edits == 0 and text[start:end].decode() == ITEM.rstrip("?")
    assert 0 < found[(4, 1)][2] <= 6
    kept = dc.drop_contaminated(documents(spark, rows), _bench(spark, [(1, ITEM)]))
    assert kept.columns == documents(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]


def test_blocks_give_the_same(spark):
    items = [(i, prose(100 + i, 25)) for i in range(30)]
    rows = [(i, f"{prose(i, 30)} {items[i % 30][1] if i % 3 == 0 else ''} {prose(i + 1, 30)}") for i in range(60)]
    one = _found(spark, rows, items)
    assert one == _found(spark, rows, items, block_bytes=500)
    assert {d for d, _ in one} >= {i for i in range(60) if i % 3 == 0}


def test_long_items_are_found_in_part(spark):
    item = prose(50, 60)
    words = item.split()
    rows = [(1, f"{prose(1, 30)} {' '.join(words[15:50])} {prose(2, 30)}"), (2, prose(3, 90))]
    assert {d for d, _ in _found(spark, rows, [(1, item)])} == {1}


def test_equals_alignment_of_everything():
    """Every place with at most k edits is found, and nothing else (small alphabet, brute force)."""
    rng = random.Random(5)
    for trial in range(60):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(20, 60)))
        edited = list(item)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(edited))
            edited[at:at + 1] = rng.choice([[], [rng.choice("abc")], [edited[at], rng.choice("abc")]])
        text = "".join(rng.choice("abcdef") for _ in range(30)) + "".join(edited) + "".join(rng.choice("abcdef") for _ in range(30))
        p = dc.Passages([(1, item)], 0.1, 100)
        k, m = int(p.k[0]), len(item)
        row = np.zeros(len(text) + 1, int)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, t in enumerate(text):
                new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
            row = np.array(new)
        least = int(row.min())
        got = dc._search(p, [text.encode()])
        assert bool(got) == (least <= k), (trial, least, k, m)
        if got:
            assert got[0][4] == least


def test_empty_tables(spark):
    assert _found(spark, [], [(1, ITEM)]) == {} and _found(spark, [(1, ITEM)], []) == {}
    assert dc.drop_contaminated(documents(spark, [(1, ITEM)]), _bench(spark, [])).count() == 1


def test_neighbours_in_a_batch_change_nothing():
    """Items cut or changed at the edge of a document are found there, whatever text comes before or after."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for trial in range(60):
        item = "".join(rng.choice(letters) for _ in range(80))
        noise = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(4)]
        cut = 1 + trial % 6
        p = dc.Passages([(1, item)], 0.1, 100)
        docs = [noise[0], noise[1] + item[:-cut], noise[2], item[cut:] + noise[3], noise[0], item[:40], item[40:], item[:-cut] + "#" * 5]
        docs = [d.encode() for d in docs]
        alone = [(i, *h[1:]) for i, d in enumerate(docs) for h in dc._search(p, [d])]
        assert dc._search(p, docs) == alone
        assert [h[0] for h in alone] == [1, 3, 7] and all(h[4] <= cut for h in alone)


def test_excerpts_are_found_wherever_they_begin():
    """Each run of ``window`` folded bytes of a long item, also with the edits the rate allows."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    item = "".join(rng.choice(letters) for _ in range(330))
    noise = "".join(rng.choice("123456789") for _ in range(90))
    p = dc.Passages([(1, item), (2, noise[:12])], 0.1, 100)
    texts = [(noise[20:] + item[lo:lo + 100] + noise[20:]).encode() for lo in range(231)]
    assert [h for h in dc._search(p, texts) if h[1] == 1] == [(i, 1, 70, 170, 0) for i in range(231)]
    changed = []
    for lo in range(231):
        part = list(item[lo:lo + 100])
        for at in range(5, 100, 10):
            part[at] = "#0"[rng.randrange(2)]
        changed.append((noise[20:] + "".join(part) + noise[20:]).encode())
    assert {h[0] for h in dc._search(p, changed)} == set(range(231))
    assert not dc._search(p, [(noise[20:] + item[lo:lo + 80] + noise[20:]).encode() for lo in range(0, 240, 7)])

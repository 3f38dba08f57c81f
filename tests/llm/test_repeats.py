import random
import re
from collections import Counter

import pytest

from corvid.llm import repeats
from tests.llm.fixtures import documents, prose


def _brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = b"\x01" * length
        out.append((len(t), sum(cover), len(re.findall(b"\x01+", bytes(cover))), bytes(b for b, c in zip(t, cover) if not c)))
    return out


def _rows(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.choice([10, 30, 80, 150]))) for _ in range(12)]
    rows = []
    for i in range(120):
        rows.append((i, "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 40)))
                                for _ in range(rng.randint(0, 6)))))
    return rows + [(200, "a" * 500), (201, "a" * 130), (202, "ab" * 100), (203, "x" + "ab" * 60 + "y"), (204, None), (205, ""), (None, rows[5][1]),
                   (7, rows[7][1]), (206, prose(1, 3000)), (207, prose(1, 2990)[5:])]


@pytest.mark.parametrize("length,largest", [(25, 20_000), (50, 20_000), (100, 20_000), (25, 2), (60, 2)])
def test_equals_brute_force(spark, length, largest):
    rows = _rows(length)
    got = repeats.remove_repeats(documents(spark, rows).repartition(4), length=length, largest=largest).collect()
    want = _brute([(t or "").encode() for _, t in rows], length)
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)
    assert have == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=str)


def test_anchors_of_a_long_text_in_pieces():
    text = (prose(3, 3000) + "a" * 900 + prose(4, 800)).encode()
    finder = repeats.Anchors(400, 128)
    whole, parts = finder.find(text), finder.find(text, most=3000)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert (whole[0][1:] - whole[0][:-1] <= 400 - 128 + 1).all()  # one in every string of the length


def test_intervals_of_a_known_suffix_array():
    # suffixes of "banana": a, ana, anana, banana, na, nana
    assert sorted(repeats.intervals([1, 3, 0, 0, 2])) == [(0, 2, 1), (0, 5, 0), (1, 2, 3), (4, 5, 2)]


def test_trees_give_all_members_and_test_the_left():
    rights = [b"match-one-tail", b"match-one-tail", b"match-one-other", b"match-two"]
    lefts = [b"xyz", b"xyq", b"xya", b"b"]
    groups = {(tuple(sorted(m.tolist())), d): dict(zip(m.tolist(), match.tolist())) for m, d, match in repeats.repeats_of(lefts, rights, 10)}
    assert groups == {((0, 1), 14): {0: 2, 1: 2}, ((0, 1, 2), 10): {0: 2, 1: 2, 2: 2}}


def test_a_passage_in_differing_surroundings_is_split_until_groups_are_small(spark):
    """Occurrences that agree on less than the length, and pairs among them that agree on all of it."""
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, more = noise(75), [noise(30) for _ in range(4)]
    rows = [(i, noise(60) + passage + noise(60)) for i in range(60)]
    rows += [(100 + i, noise(40) + rng.choice(more) + passage + rng.choice(more) + noise(40)) for i in range(30)]
    got = repeats.remove_repeats(documents(spark, rows).repartition(4), length=100, largest=8).collect()
    want = _brute([t.encode() for _, t in rows], 100)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want))
    assert sum(w[1] for w in want) > 0


def test_rows_with_the_same_first_hash_keep_their_own_spans(spark):
    rows = _rows(3)[:80]
    got = repeats.remove_repeats(documents(spark, rows).repartition(4), length=50, bits=4).collect()
    want = _brute([(t or "").encode() for _, t in rows], 50)
    assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == sorted((i, w[1], w[3]) for (i, _), w in zip(rows, want))


def test_empty_table(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0

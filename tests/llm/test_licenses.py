import math
import random
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvid.llm.licenses import CUE, NOTICES, TEXTS, licence_scan, scan, templates
from tests.llm.fixtures import EXTRA, prose


def _files(spark, rows):
    return spark.createDataFrame([(i, p, t, "k", 1, "x", "y", "z", 2) for i, p, t in rows], f"doc_id long, place string, text string, {EXTRA}")


def _scan(spark, rows, **kw):
    return [(r.doc_id, r.path, r.licence, r.origin) for r in licence_scan(_files(spark, rows), F.col("place"), **kw).collect()]


def test_templates_hold_a_cue():
    assert all(re.match(CUE, t["cue"]) and t["terms"][t["at"]] == t["cue"] for t in templates())


def test_headers_files_and_inheritance(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", prose(1, 40)),
            (3, "a/b/c/LICENSE", NOTICES["Apache-2.0"][1]), (4, "a/b/c/d/y.py", prose(2, 30)),
            (5, "a/b/z.py", f"# This work is licensed under the GNU General Public License, version 3.\n{prose(3, 300)}"),
            (6, "other/w.py", prose(4, 20)), (7, "top", prose(5, 5)), (8, None, "Licensed under CC BY 4.0."), (9, "a/n", None),
            (10, "a/b/c/e", ""), (None, "a/q", prose(6, 4)), (2, "a/b/x.py", prose(1, 40)), (11, "q/long", prose(7, 20_000) + "\nLicensed under CC BY-NC 4.0.")]
    got = sorted(_scan(spark, rows), key=str)
    assert got == sorted([
        (1, "a/LICENSE", "MIT", "own"), (2, "a/b/x.py", "MIT", "inherited"), (2, "a/b/x.py", "MIT", "inherited"),
        (3, "a/b/c/LICENSE", "Apache-2.0", "own"), (4, "a/b/c/d/y.py", "Apache-2.0", "inherited"), (5, "a/b/z.py", "GPL-3.0", "own"),
        (6, "other/w.py", None, None), (7, "top", None, None), (8, None, "CC-BY-4.0", "own"), (9, "a/n", "MIT", "inherited"),
        (10, "a/b/c/e", "Apache-2.0", "inherited"), (None, "a/q", "MIT", "inherited"), (11, "q/long", "CC-BY-NC-4.0", "own")], key=str)


def test_most_common_licence_of_a_directory(spark):
    rows = [(1, "d/1", "Released under the MIT License."), (2, "d/2", "Licensed under CC BY 4.0."), (3, "d/3", "Licensed under CC BY 4.0."), (4, "d/4", "plain text")]
    assert {r[0]: r[2] for r in _scan(spark, rows)} == {1: "MIT", 2: "CC-BY-4.0", 3: "CC-BY-4.0", 4: "CC-BY-4.0"}


def test_mentions_are_no_notice(spark):
    rows = [(1, "d/1", "He lost his driving license near the public garden and asked for permission to walk home along the river instead")]
    assert _scan(spark, rows)[0][2] is None
    assert _scan(spark, []) == []


def test_native_plan(spark):
    plan = licence_scan(_files(spark, [(1, "d/1", "Released under the MIT License.")]), F.col("place"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_full_texts_are_licence_files_at_any_length(spark):
    rows, want = [], {}
    for k, p in enumerate(sorted(TEXTS.glob("*.txt"))):
        rows += [(2 * k, f"p{k}/LICENSE", p.read_text("utf-8")), (2 * k + 1, f"p{k}/src/deep/x.c", prose(k, 50))]
        want |= {2 * k: (p.stem, "own"), 2 * k + 1: (p.stem, "inherited")}
    mit = (TEXTS / "MIT.txt").read_text("utf-8").replace("<year> <copyright holders>", "2019 Some Body and others")
    rows += [(100, "q/LICENSE", mit.replace("\n", "\r\n")), (101, "q/x.c", ""), (102, "r/LICENCE", " ".join(mit.split())), (103, "r/x.c", "")]
    want |= {100: ("MIT", "own"), 101: ("MIT", "inherited"), 102: ("MIT", "own"), 103: ("MIT", "inherited")}
    assert {r[0]: (r[2], r[3]) for r in _scan(spark, rows)} == want


@pytest.mark.parametrize("mark", ["# ", "// ", " * ", ""])
def test_hard_wrapped_headers(spark, mark):
    chosen = [("MPL-2.0", 1), ("BSD-3-Clause", 0), ("GPL-3.0", 1), ("GPL-2.0", 1), ("LGPL-2.1", 0), ("AGPL-3.0", 0), ("Apache-2.0", 2), ("MIT", 2)]
    rows = []
    for k, (licence, i) in enumerate(chosen):
        for width in (40, 72):
            header = "\n".join(mark + x for x in textwrap.wrap(NOTICES[licence][i], width))
            rows.append((k * 100 + width, f"s/{licence}-{width}.c", f"int first;\n\n{header}\n\n{prose(k, 3000)}"))
    rows.append((1, "s/none.c", prose(3, 10)))  # headers make no licence file
    got = {r[0]: (r[2], r[3]) for r in _scan(spark, rows)}
    assert got == {k * 100 + width: (licence, "own") for k, (licence, _) in enumerate(chosen) for width in (40, 72)} | {1: (None, None)}


def _brute(texts, least):
    """Best (licence, score, whole) of each text: every window and every full text, without the early exits."""
    words = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower().replace("licenc", "licens"))
    df = Counter(x for t in texts for x in set(words(t)))
    weight = lambda c: {x: (1 + math.log(f)) * (math.log((len(texts) + 1) / (df[x] + 1 if x in known else 1)) + 1) for x, f in c.items()}
    known = {x for t in templates() for x in t["terms"]}

    def cosine(a, b):
        a, b = weight(Counter(a)), weight(Counter(b))
        return sum(w * b.get(x, 0) for x, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    out = []
    for text in texts:
        lines = [w for w in map(words, text.split("\n")) if w]
        flat = [(x, i) for i, line in enumerate(lines) for x in line]
        found = []
        for t in templates():
            if t["full"]:
                cases = [(True, [x for x, _ in flat])]
            else:
                cases = []
                for p in (p for p, (x, _) in enumerate(flat) if x == t["cue"]):
                    a, b = flat[max(p - t["at"], 0)][1], flat[min(p - t["at"] + len(t["terms"]), len(flat)) - 1][1]
                    window = sum(lines[a:b + 1], [])
                    if len(window) <= 3 * len(t["terms"]):
                        cases.append((2 * len(window) >= len(flat), window))
            found += [(whole, round(cosine(c, t["terms"]), 6), -t["k"], t["licence"]) for whole, c in cases if c]
        found = [f for f in found if f[1] >= least]
        out.append((max(found)[3], max(found)[1], max(found)[0]) if found else None)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [t for ts in NOTICES.values() for t in ts] + [p.read_text("utf-8") for p in TEXTS.glob("*.txt")]
    texts = ["", "license", "licence " * 40]
    for k in range(60):
        pick = rng.choice(pool).split(" ")
        for _ in range(rng.randrange(1 + len(pick) // 6)):  # words go, come and change
            pick[rng.randrange(len(pick))] = rng.choice(["", "the", "license", "permission granted", "foo\nbar"])
        body = "\n".join(textwrap.wrap(" ".join(pick), rng.choice([30, 60, 1000]))) if rng.random() < 0.7 else " ".join(pick)
        texts.append(rng.choice(["", prose(k, rng.randrange(30)) + rng.choice(["\n", " "])]) + body + rng.choice(["", "\n" + prose(k + 9, rng.randrange(1, 200))]))
    files = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(texts)], "file long, path string, text string")
    for least in (0.5, 0.75):
        got = {r.file: (r.licence, r.score, r.whole) for r in scan(files, least).collect()}
        want = {i: w for i, w in enumerate(_brute(texts, least)) if w}
        assert got.keys() == want.keys()
        for i, (licence, score, whole) in want.items():
            assert got[i][0] == licence and got[i][2] == whole and abs(got[i][1] - score) <= 2e-6

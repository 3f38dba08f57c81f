import re
from collections import Counter

from corvid.llm.rules import quality_rules
from tests.llm.fixtures import documents, prose

ROWS = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, prose(1, 60) + "."), (5, "a b c d e f g a b c d e f g a b c d e"), (6, "x\ny\nx\n\n\nx \n y"),
        (7, "# * $ % & | < > # ** $$"), (8, "word " * 40), (9, "\n".join(f"{prose(i, 9)}." for i in range(30))), (9, "again"),
        (10, "\n".join(" | ".join(prose(20 + i, 6).split()) for i in range(9))),
        (11, prose(3, 200) + ".\nAccept cookies to go on\n" + prose(4, 50) + "."), (None, prose(2, 30) + "."), (12, "日本 語 é x " * 5),
        (13, prose(5, 20_000)), (14, "!! ".join(prose(8, 30).split()) + "\nfine words here."), (15, "$$$ ".join(prose(6, 30).split()))]


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) for k in range(5) if grams[tuple(words[i:i + 5])] > 1}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(spark):
    out = quality_rules(documents(spark, ROWS)).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert sorted(got, key=str) == sorted([(i, *_brute(t)) for i, t in ROWS], key=str)


def test_verdicts(spark):
    out = {r.doc_id: r for r in quality_rules(documents(spark, [r for r in ROWS if r != (9, "again")])).collect()}
    assert {i for i, r in out.items() if r.kept} == {4, 9, 11, None}
    assert all(not r.kept for r in out.values() if r.base_failed)
    assert not out[10].base_failed and not out[14].base_failed and not out[15].base_failed  # lost by their lines
    assert "cookies" not in out[11].clean_text and out[11].clean_text.startswith(prose(3, 200))


def test_empty_table_and_native_plan(spark):
    assert quality_rules(documents(spark, [])).count() == 0
    plan = quality_rules(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Pandas", "Arrow"))

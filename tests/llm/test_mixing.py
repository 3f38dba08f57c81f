import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import mixing
from tests.llm.fixtures import documents, prose

GERMAN = "über straße grün die schöne größe mögen fließt würde königin".split()


def _german(i, n):
    return " ".join(GERMAN[(i * 3 + k * k + k) % len(GERMAN)] for k in range(n))


def _docs(spark):
    rows = [(2 * i, prose(i, 20 + i % 30)) for i in range(150)] + [(2 * i + 1, _german(i, 10 + i % 20)) for i in range(60)]
    return documents(spark, [*rows, (1000, None), (1002, ""), (None, prose(3, 10)), (0, rows[0][1])])


def _labelled(docs):
    return docs.where("doc_id < 200").select("doc_id", F.col("lang").alias("domain"))


def test_targets_are_met(spark):
    docs = _docs(spark)
    out = mixing.document_rates(docs, _labelled(docs), {"en": 0.3, "de": 0.7})
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and 0 <= r.membership <= 1 for r in rows)
    wrong = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 300 and (r.domain == "de") != bool(r.doc_id % 2)]
    assert not wrong
    total = sum(r.n_tokens for r in rows)
    # two domains: the posterior of the other one is what is left
    sums = {"en": 0.0, "de": 0.0}
    for r in rows:
        sums[r.domain] += r.rate * r.n_tokens * r.membership
        sums["de" if r.domain == "en" else "en"] += r.rate * r.n_tokens * (1 - r.membership)
    assert sums["en"] == pytest.approx(0.3 * total, rel=1e-4) and sums["de"] == pytest.approx(0.7 * total, rel=1e-4)
    copies = sum(r.copies * r.n_tokens for r in rows)
    assert copies == pytest.approx(total, rel=0.15)
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in out.collect()}  # the same in every run


def test_rates_stay_at_the_bound(spark):
    docs = _docs(spark)
    rows = mixing.document_rates(docs, _labelled(docs), {"en": 0.0, "de": 1.0}).collect()
    assert min(r.rate for r in rows) == 0 and {r.domain for r in rows if r.rate < 0.05} == {"en"}


def test_repeating_loses_no_row(spark):
    docs = _docs(spark)
    out = mixing.mix(docs, _labelled(docs), {"en": 0.5, "de": 0.5})
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(n) == {r.doc_id for r in docs.collect()} and min(n.values()) >= 1
    words = {"en": 0, "de": 0}
    for r in out.where("lang is not null and text is not null").collect():
        words[r.lang] += len(r.text.split())
    assert abs(words["en"] / sum(words.values()) - 0.5) < 0.05


def test_projected_steps_equal_least_squares():
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 100, 200).astype(float)
    gram = (p * n[:, None]).T @ p
    target = np.array([0.2, 0.3, 0.5]) * n.sum()
    steps, totals = [], (p * n[:, None]).sum(0)
    for _ in range(30):
        steps.append(np.linalg.inv(gram) @ (totals - target))
        totals = (p * (n * mixing._rates(p, steps, 0.0))[:, None]).sum(0)
    assert np.allclose(totals, target, rtol=1e-6) and mixing._rates(p, steps, 0.0).min() >= 0


def test_empty_tables_and_no_labels(spark):
    docs = _docs(spark)
    none = docs.limit(0).select("doc_id", F.col("lang").alias("domain"))
    assert {(r.domain, r.rate, r.copies) for r in mixing.document_rates(docs, none, {"en": 1.0}).collect()} == {(None, 1.0, 1)}
    assert mixing.mix(docs, none, {"en": 1.0}).count() == docs.count()
    empty = documents(spark, [])
    assert mixing.document_rates(empty, _labelled(docs), {"en": 1.0}, texts=docs).count() == 0
    assert mixing.mix(empty, _labelled(docs), {"en": 1.0}, texts=docs).count() == 0


def test_no_domain_is_lost_to_long_texts(spark):
    rows = [(2 * i, prose(i, 40)) for i in range(60)] + [(2 * i + 1, _german(i, 30)) for i in range(60)]
    docs = documents(spark, [*rows, *[(200 + i, prose(i, 4000)) for i in range(40)]])
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    rare = labelled.where("doc_id < 60").withColumn("domain", F.when(F.col("doc_id") == 0, "rare").otherwise(F.col("domain")))
    assert mixing.learn_domains(docs, labelled, sample_bytes=20_000).domains == ["de", "en"]
    assert mixing.learn_domains(docs, rare, sample_rows=5).domains == ["de", "en", "rare"]
    with pytest.raises(ValueError, match="no text of domain"):
        mixing.learn_domains(docs.where("doc_id >= 200"), labelled, sample_bytes=1000)

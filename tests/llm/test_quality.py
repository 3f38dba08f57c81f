import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import quality
from corvid.llm.quality import ByteNet, fit_net
from tests.llm.fixtures import documents, prose


def _bad(i):
    return " | ".join(f"{w}$$$" for w in prose(i, 30).split())


def test_gradients_are_right():
    net = ByteNet.new(3)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    docs, y = [prose(i, 60 + 40 * i).encode() for i in range(4)] + [b"", b"ab"], np.array([1, 0, 1, 0, 1, 0.0])
    grads = net.grads(docs, y)

    def loss():
        p = net.score(docs)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    rng = np.random.default_rng(0)
    for name, g in grads.items():
        flat, gf = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for k in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was = flat[k]
            flat[k] = was + 1e-4
            up = loss()
            flat[k] = was - 1e-4
            down = loss()
            flat[k] = was
            assert (up - down) / 2e-4 == pytest.approx(gf[k], rel=0.05, abs=2e-4), name


def test_whole_documents_in_pieces_and_batches(monkeypatch):
    net = ByteNet.new(5)
    docs = [prose(i, 4000).encode() for i in range(3)] + [b"", b"a", prose(9, 3).encode()]
    one = net.score(docs)
    assert np.allclose(one, [net.score([d])[0] for d in docs], atol=1e-6)
    monkeypatch.setattr(quality, "PIECE", 128 * 8)
    assert np.allclose(one, net.score(docs), atol=1e-6)
    # the last bytes of a long document count
    assert net.score([docs[0] + b"$$$ ### %%% " * 40])[0] != pytest.approx(one[0], abs=1e-9)
    assert np.array_equal(ByteNet.load(net.dump()).score(docs), net.score(docs))


def test_learns_and_keeps_columns(spark):
    rows = [(i, prose(i, 50) if i % 3 else _bad(i)) for i in range(400)]
    docs = documents(spark, [*rows, (1000, None), (1001, ""), (None, "no id"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, int(bool(i % 3)), "x") for i in range(400)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    held = {r.doc_id for r in docs.where(quality.held_out(F.col("doc_id"))).collect()}
    assert len([i for i in held if i is not None and i < 400]) > 50
    right = sum((i in kept) == bool(i % 3) for i in held if i is not None and i < 400)
    assert right >= 0.97 * len([i for i in held if i is not None and i < 400])
    net = quality.train(docs, labels)
    scores = quality.score(docs.select("doc_id", "text"), net).collect()
    assert len(scores) == 404 and all(0 <= r.score <= 1 for r in scores)


def test_no_labels_of_one_kind(spark):
    docs = documents(spark, [(1, "a"), (2, "b")])
    for rows in ([], [(1, 1), (2, 1)]):
        net = quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert len({round(r.score, 6) for r in quality.score(docs.select("doc_id", "text"), net).collect()}) == 1
    assert quality.score(documents(spark, []).select("doc_id", "text"), ByteNet.new(1).dump()).count() == 0


def test_fit_is_the_same_each_time():
    docs, y = [prose(i, 30).encode() if i % 2 else _bad(i).encode() for i in range(40)], np.array([i % 2 for i in range(40)], "f4")
    assert fit_net(docs, y, epochs=2).dump() == fit_net(docs, y, epochs=2).dump()


def test_long_texts_leave_room_for_the_others(spark):
    """A long text is passed over, wherever it comes in hash order; an error, if a label is left without a row."""
    rows = [(i, prose(i, 50) if i % 2 else _bad(i)) for i in range(200)]
    order = spark.range(200).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit("fit"))).collect()
    first = {order[0].id, order[1].id}
    docs = documents(spark, [(i, t * 200 if i in first else t) for i, t in rows])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    net = quality.train(docs, labels, sample_bytes=30_000)
    scores = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), net).collect()}
    assert len(set(scores.values())) > 100
    assert np.mean([scores[i] > 0.5 for i in range(1, 200, 2)]) > 0.8 and np.mean([scores[i] > 0.5 for i in range(0, 200, 2)]) < 0.2
    with pytest.raises(ValueError, match="no text of label"):
        quality.train(docs.where(F.col("doc_id").isin(list(first))), labels, sample_bytes=3000)

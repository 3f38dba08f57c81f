import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import knn
from corvid.operators.split import split_parts
from corvid.sources import read_table
from tests.conftest import SF_SMALL


def _fruit(spark):
    rows = [(1, 150.0, 1, "A"), (2, 150.0, 1, "B"),  # duplicate point, different labels
            (3, 160.0, 2, "A"), (4, 300.0, 5, "B"), (5, 310.0, 5, "B"), (6, 155.0, 1, "A")]
    return spark.createDataFrame(rows, "id long, Weight double, Colour int, Label string")


def test_distance_tie_broken_by_train_key(spark):
    train = _fruit(spark)
    test = spark.createDataFrame([(100, 150.0, 1)], "id long, Weight double, Colour int")
    nb = knn.knn_neighbors(train, test, features=["Weight", "Colour"], label_col="Label", train_id="id",
                           test_id="id", k=2).orderBy("rank").collect()
    assert [r.neighbor_id for r in nb] == [1, 2]  # both at distance 0, smaller key first
    # k=2 votes A vs B tie -> smallest label
    pred = knn.knn_predict(train, test, features=["Weight", "Colour"], label_col="Label", train_id="id",
                           test_id="id", k=2).collect()
    assert pred[0].prediction == "A"


def test_k_limits(spark):
    train = _fruit(spark)
    test = spark.createDataFrame([(100, 305.0, 5)], "id long, Weight double, Colour int")
    kw = dict(features=["Weight", "Colour"], label_col="Label", train_id="id", test_id="id")
    assert knn.knn_predict(train, test, k=6, **kw).count() == 1  # k = n
    with pytest.raises(ValueError):
        knn.knn_predict(train, test, k=7, **kw)  # k = n + 1
    out = knn.knn_predict(train, test, k=7, allow_fewer=True, **kw).collect()
    assert out[0].prediction == "A"  # all 6 vote: 3 A, 3 B -> smallest


def test_metric_changes_neighbours(spark):
    train = spark.createDataFrame([(1, 3.0, 3.0, "x"), (2, 0.0, 4.5, "y")], "id long, a double, b double, l string")
    test = spark.createDataFrame([(9, 0.0, 0.0)], "id long, a double, b double")
    kw = dict(features=["a", "b"], label_col="l", train_id="id", test_id="id", k=1)
    # euclid: sqrt(18)=4.24 < 4.5 -> x ; manhattan: 6 > 4.5 -> y
    assert knn.knn_predict(train, test, metric="euclidean", **kw).first().prediction == "x"
    assert knn.knn_predict(train, test, metric="manhattan", **kw).first().prediction == "y"
    # feature subset by weight 0 on 'a': only b counts -> x (3 < 4.5)
    assert knn.knn_predict(train, test, weights=[0.0, 1.0], **kw).first().prediction == "x"


def _brute_knn(train_x, train_y, train_ids, test_x, k, power=2):
    preds = []
    for q in test_x:
        d = (np.abs(train_x - q) ** power).sum(axis=1)
        order = np.lexsort((train_ids, d))[:k]
        labels, counts = np.unique(train_y[order], return_counts=True)
        preds.append(labels[counts == counts.max()].min())
    return np.array(preds)


@pytest.mark.parametrize("metric,power", [("euclidean", 2), ("manhattan", 1)])
def test_blocked_equals_brute_force(spark, metric, power):
    emb = read_table(spark, SF_SMALL, "embeddings", ["vec_id", "embedding", "label"])
    train, test = split_parts(emb, "vec_id", 0.25, 0)
    tr = train.toPandas().sort_values("vec_id")
    te = test.toPandas().sort_values("vec_id")
    expect = _brute_knn(np.stack(tr.embedding).astype(float), tr.label.to_numpy(), tr.vec_id.to_numpy(),
                        np.stack(te.embedding).astype(float), 7, power)
    kw = dict(features="embedding", label_col="label", train_id="vec_id", test_id="vec_id", k=7, metric=metric)
    one = knn.knn_predict(train, test.drop("label"), **kw).toPandas().sort_values("vec_id")
    many = knn.knn_predict(train, test.drop("label"), block_rows=20, chunk_rows=30, **kw).toPandas().sort_values("vec_id")
    assert list(one.prediction) == list(expect)
    assert list(many.prediction) == list(expect)


def test_blocks_are_stored_once_and_skipped(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), str(int(x) % 3)) for i, x in enumerate(rng.integers(0, 500, 2000))]
    train = spark.createDataFrame(rows, "id long, v double, l string")
    fit = knn.store_training(train, features=["v"], label_col="l", train_id="id", block_rows=100)
    boxes = spark.read.parquet(f"{fit.path}/pages").collect()
    assert fit.n == 2000 and len(boxes) >= 20 and max(b.hi[0] - b.lo[0] for b in boxes) < 100  # boxes are narrow
    queries = np.r_[rng.uniform(-10, 510, 200), rng.integers(0, 500, 100)]
    test = spark.createDataFrame([(i, float(x)) for i, x in enumerate(queries)], "qid long, v double")
    got = knn.knn_neighbors(fit, test, test_id="qid", k=5).toPandas().sort_values(["qid", "rank"])
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for i, q in enumerate(queries):
        d = (x - q) ** 2
        assert got[got.qid == i].neighbor_id.tolist() == ids[np.lexsort((ids, d))[:5]].tolist()
    plan = knn.knn_neighbors(fit, test, test_id="qid", k=5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no side is shuffled


def test_string_keys_and_labels(spark):
    train = spark.createDataFrame([("b", 1.0, "x"), ("a", 1.0, "y"), ("c", 5.0, "x")], "id string, v double, l string")
    test = spark.createDataFrame([("q", 1.0)], "qid string, v double")
    for rows in (None, 1):
        nb = knn.knn_neighbors(train, test, features=["v"], label_col="l", train_id="id", test_id="qid", k=2, block_rows=rows)
        assert [r.neighbor_id for r in nb.orderBy("rank").collect()] == ["a", "b"]


def test_accuracy_invariants(spark):
    emb = read_table(spark, SF_SMALL, "embeddings", ["vec_id", "embedding", "label"])
    kw = dict(features="embedding", label_col="label", train_id="vec_id", test_id="vec_id")
    # k=1 on its own (unique) training rows: each row is its own neighbour
    assert knn.knn_score(emb, emb, k=1, **kw).first().accuracy == 1.0
    # scoring on the model's own predictions is 1.0 by construction
    train, test = split_parts(emb, "vec_id", 0.25, 0)
    pred = knn.knn_predict(train, test.drop("label"), k=5, **kw)
    again = knn.knn_predict(train, test.drop("label"), k=5, keep_cols=[], **kw)
    both = pred.join(again.withColumnRenamed("prediction", "p2"), "vec_id")
    assert knn.accuracy(both, "prediction", "p2").first().accuracy == 1.0
    wrong = both.withColumn("p2", F.when(F.col("vec_id") % 2 == 0, F.col("p2")))
    share = wrong.agg(F.avg((F.col("vec_id") % 2 == 0).cast("double"))).first()[0]
    assert knn.accuracy(wrong, "prediction", "p2").first().accuracy == pytest.approx(share)


def test_many_k_equals_single_k(spark):
    emb = read_table(spark, SF_SMALL, "embeddings", ["vec_id", "embedding", "label"])
    train, test = split_parts(emb, "vec_id", 0.25, 0)
    kw = dict(features="embedding", label_col="label", train_id="vec_id", test_id="vec_id")
    nb = knn.knn_neighbors(train, test.drop("label"), k=7, **kw)
    many = knn.knn_vote_many(nb, "vec_id", [3, 7]).filter(F.col("k") == 3).select("vec_id", "prediction")
    single = knn.knn_predict(train, test.drop("label"), k=3, **kw)
    assert sorted(many.collect()) == sorted(single.collect())


def test_minkowski_power(spark):
    emb = read_table(spark, SF_SMALL, "embeddings", ["vec_id", "embedding", "label"])
    train, test = split_parts(emb, "vec_id", 0.25, 0)
    kw = dict(features="embedding", label_col="label", train_id="vec_id", test_id="vec_id", k=5)
    p2 = knn.knn_predict(train, test.drop("label"), metric="minkowski", p=2, **kw)
    eu = knn.knn_predict(train, test.drop("label"), metric="euclidean", **kw)
    assert sorted(p2.collect()) == sorted(eu.collect())
    tr = train.toPandas().sort_values("vec_id")
    te = test.toPandas().sort_values("vec_id")
    expect = _brute_knn(np.stack(tr.embedding).astype(float), tr.label.to_numpy(), tr.vec_id.to_numpy(),
                        np.stack(te.embedding).astype(float), 5, 3)
    p3 = knn.knn_predict(train, test.drop("label"), metric="minkowski", p=3, **kw).toPandas().sort_values("vec_id")
    assert list(p3.prediction) == list(expect)


def test_weight_units_change_neighbours(spark):
    train = spark.createDataFrame([(1, 150.0, 1, "A"), (2, 151.0, 5, "B"), (3, 195.0, 1, "C")],
                                  "id long, Weight double, Colour int, Label string")
    test = spark.createDataFrame([(9, 170.0, 1)], "id long, Weight double, Colour int")
    kw = dict(features=["Weight", "Colour"], label_col="Label", train_id="id", test_id="id", k=1)
    grams = knn.knn_predict(train, test, **kw).first().prediction
    kg = knn.knn_predict(train.withColumn("Weight", F.col("Weight") / 1000),
                         test.withColumn("Weight", F.col("Weight") / 1000), **kw).first().prediction
    # grams: d^2 = 400 (A), 19^2 + 4^2 = 377 (B), 625 (C) -> B
    assert grams == "B"
    # kg: the colour dominates: 0.02^2 (A) < 0.025^2 (C) < 16 (B) -> A
    assert kg == "A"


def test_missing_features_give_no_label(spark):
    train = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [5.0, 5.0], "b"), (3, None, "c"), (4, [0.0, None], "d")],
                                  "id long, v array<double>, l string")
    test = spark.createDataFrame([(10, [0.1, 0.0]), (11, None), (12, [4.0, None])], "id long, v array<double>")
    kw = dict(features="v", label_col="l", train_id="id", test_id="id", k=1)
    out = {r.id: r.prediction for r in knn.knn_predict(train, test, **kw).collect()}
    assert out == {10: "a", 11: None, 12: None}  # every test row kept, none guessed
    with pytest.raises(Exception, match="feature vector"):
        knn.knn_predict(train, test, missing="error", **kw).collect()
    with pytest.raises(ValueError):
        knn.knn_predict(train.limit(0), test, **kw)


def test_directory_of_two_levels(spark):
    """Many blocks and pages: the same neighbours, and nothing of the directory is in the plan or the driver."""
    rows = [(i, float(i * 37 % 1000) / 3, i % 3) for i in range(1500)]
    train = spark.createDataFrame(rows, "id int, v double, l int")
    test = spark.createDataFrame([(i, float(i * 11 % 400)) for i in range(60)], "qid int, v double")
    kw = dict(features=["v"], label_col="l", train_id="id", block_rows=20)
    key = lambda df: [tuple(r) for r in df.orderBy("qid", "rank").collect()]
    want = key(knn.knn_neighbors(train, test, features=["v"], label_col="l", train_id="id", test_id="qid", k=4))
    for blocks in (3, 1000):
        fit = knn.store_training(train, **kw, page_blocks=blocks)
        pages, top = (spark.read.parquet(f"{fit.path}/{x}") for x in ("pages", "top"))
        assert pages.count() >= 75 and top.count() >= (75 // 3 if blocks == 3 else 1)
        assert key(knn.knn_neighbors(fit, test, test_id="qid", k=4)) == want
        assert all(not hasattr(v, "__len__") or isinstance(v, (str, list)) for v in vars(fit).values())


def test_votes_leave_the_search_task(spark):
    train = spark.createDataFrame([(i, float(i // 2), ["b", "a", None][i % 3]) for i in range(30)], "id int, v double, l string")
    test = spark.createDataFrame([(1, 3.2, "p"), (1, 9.9, "q"), (2, None, "r"), (None, 0.0, "s")], "qid int, v double, name string")
    fit = knn.store_training(train, features=["v"], label_col="l", train_id="id", block_rows=4)
    out = knn.knn_predict_many(fit, test, test_id="qid", ks=[1, 4, 4, 7], keep_cols=["name"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    got = {(r.name, r.k): r.prediction for r in out.collect()}
    rows = train.collect()
    for name, v in (("p", 3.2), ("q", 9.9), ("s", 0.0)):
        near = sorted(rows, key=lambda r: (abs(r.v - v), r.id))
        for k in (1, 4, 7):
            labels = [r.l for r in near[:k] if r.l]
            assert got[name, k] == min(set(labels), key=lambda x: (-labels.count(x), x), default=None)
    assert got["r", 4] is None and len(got) == 12  # equal test ids are rows of their own
    nb = knn.knn_neighbors(fit, test.where("name = 'q'"), test_id="qid", k=7)
    assert knn.knn_vote(nb, "qid").first().prediction == got["q", 7]

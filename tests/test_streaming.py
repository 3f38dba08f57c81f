import os
import tempfile

from pyspark.sql import functions as F

from corvid.operators import knn
from corvid.operators.split import split_parts
from corvid.sources import read_table
from corvid.streaming import knn_label_stream, logistic_score_stream
from tests.conftest import SF_SMALL


def test_knn_stream_equals_batch(spark):
    emb = read_table(spark, SF_SMALL, "embeddings", ["vec_id", "embedding", "label"])
    train, test = split_parts(emb, "vec_id", 0.25, 0)
    d = tempfile.mkdtemp(prefix="corvid-stream-")
    test.drop("label").write.parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(test.drop("label").schema).parquet(os.path.join(d, "in"))
    q = knn_label_stream(stream, train, features="embedding", label_col="label", train_id="vec_id",
                         test_id="vec_id", k=5, out_path=os.path.join(d, "out"),
                         checkpoint_path=os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(d, "out")).select("vec_id", "prediction")
    ref = knn.knn_predict(train, test.drop("label"), features="embedding", label_col="label",
                          train_id="vec_id", test_id="vec_id", k=5)
    assert sorted(got.collect()) == sorted(ref.collect())


def test_logistic_stream(spark):
    d = tempfile.mkdtemp(prefix="corvid-stream-")
    spark.createDataFrame([(1, 0.5, 1.0), (2, -2.0, 0.0), (3, 2.0, 0.0)], "id int, a double, b double").write.parquet(
        os.path.join(d, "in"))
    stream = spark.readStream.schema("id int, a double, b double").parquet(os.path.join(d, "in"))
    scored = logistic_score_stream(stream, ["a", "b"], 0.1, [1.0, -1.0], degree=1)
    q = scored.writeStream.format("memory").queryName("scored_stream").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r.id: r.prediction for r in spark.sql("SELECT * FROM scored_stream").collect()}
    # z = 0.1 + a - b: -0.4, -1.9, 2.1
    assert rows == {1: 0, 2: 0, 3: 1}

"""Scoring a stream with the fitted pieces (the reference has no streaming;
these are the only parts that apply row by row).

* ``logistic_score_stream``: a fixed-coefficient logistic model is a column
  expression, so it works on a streaming DataFrame unchanged.
* ``knn_label_stream``: KNN against a static training table needs the
  micro-batch as a table, so the training rows are stored once and each batch is
  scored through ``foreachBatch`` and appends to a parquet sink.  Batches are idempotent on
  retry: the output of a batch is written under its batch id and overwritten
  when the batch is replayed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvid.operators import knn
from corvid.operators.logit import logistic_score


def logistic_score_stream(stream: DataFrame, feature_cols: Sequence[str], intercept: float,
                          coefs: Sequence[float], degree: int = 2, prob_col: str = "p") -> DataFrame:
    p = logistic_score(feature_cols, intercept, coefs, degree)
    return stream.withColumn(prob_col, p).withColumn("prediction", (F.col(prob_col) > 0.5).cast("int"))


def knn_label_stream(stream: DataFrame, train: DataFrame, *, features, label_col: str, train_id: str,
                     test_id: str, k: int, out_path: str, checkpoint_path: str,
                     metric: str = "euclidean", trigger_once: bool = True) -> StreamingQuery:
    blocks = knn.store_training(train, features=features, label_col=label_col, train_id=train_id)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        pred = knn.knn_predict(blocks, batch, test_id=test_id, k=k, metric=metric)
        pred.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()

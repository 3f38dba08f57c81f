"""The reference's Flow B over CSV files, composed from the operators:
train CSV -> exact split -> KNN fit (hold the rows) -> held-out and training
accuracy -> predict a test CSV in file order -> label CSV with a row number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import knn
from corvid.operators.split import split_parts
from corvid.sources import dense_row_number, read_csv, write_labels


def knn_csv_flow(spark: SparkSession, train_csv: str, test_csv: str, out_dir: str, *,
                 features: Sequence[str], label: str, k: int = 5, metric: str = "euclidean",
                 test_share: float = 0.25, seed: int = 0, drop_cols: Sequence[str] = (),
                 single_file: bool = False) -> DataFrame:
    """Runs the flow and returns the accuracies (``part``, ``accuracy``): held out,
    training, on the written predictions with the same fit (the file against the
    model that wrote it), and of a model refitted on them."""
    data = dense_row_number(read_csv(spark, train_csv), "row_id")
    parts = split_parts(data, "row_id", test_share, seed)
    train, test = parts
    own = dict(features=list(features), label_col=label, train_id="row_id")
    kw = dict(test_id="row_id", k=k, metric=metric)
    fit = knn.store_training(train, **own)
    held = knn.knn_score(fit, test, score_label=label, **kw)
    again = knn.knn_score(fit, train, score_label=label, **kw)

    new = read_csv(spark, test_csv)
    new = dense_row_number(new.drop(*[c for c in drop_cols if c in new.columns]), "row_id")
    write_labels(knn.knn_predict(fit, new, **kw), out_dir, "row_id", "prediction", single_file=single_file)

    written = read_csv(spark, out_dir, schema="row_id long, label string").withColumnRenamed("label", "written")
    check = new.join(written, "row_id")
    same = knn.knn_score(fit, check, score_label="written", **kw)
    refit = knn.store_training(check, **{**own, "label_col": "written"})
    after = knn.knn_score(refit, check, score_label="written", **{**kw, "allow_fewer": True})
    out = None
    for part, df in (("held_out", held), ("training", again), ("written_labels", same), ("refit", after)):
        df = df.select(F.lit(part).alias("part"), "accuracy")
        out = df if out is None else out.unionByName(df)
    return out

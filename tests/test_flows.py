import os
import tempfile

import numpy as np

from corvid.plans.flows import knn_csv_flow


def test_knn_csv_flow(spark):
    d = tempfile.mkdtemp(prefix="corvid-flow-")
    rng = np.random.default_rng(5)
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write("Weight,Colour,Label\n")
        for _ in range(40):
            if rng.random() < 0.5:
                f.write(f"{rng.normal(150, 10):.1f},{rng.integers(1, 3)},A\n")
            else:
                f.write(f"{rng.normal(120, 10):.1f},{rng.integers(4, 6)},B\n")
    with open(os.path.join(d, "test.csv"), "w") as f:
        f.write("Weight,Colour,Label\n")
        for w, c in [(373.0, 1), (150.0, 2), (118.0, 5)]:
            f.write(f"{w},{c},\n")
    acc = {r.part: r.accuracy for r in knn_csv_flow(
        spark, os.path.join(d, "train.csv"), os.path.join(d, "test.csv"), os.path.join(d, "out"),
        features=["Weight", "Colour"], label="Label", k=5, drop_cols=["Label"], single_file=True).collect()}
    assert acc["held_out"] > 0.8 and acc["training"] > 0.8
    assert acc["written_labels"] == 1.0  # the file holds what this fit predicts
    assert acc["refit"] == 2 / 3  # three rows labelled A, A, B: all vote, so the B row becomes an A
    out = sorted(open(os.path.join(d, "out", p)).read() for p in os.listdir(os.path.join(d, "out"))
                 if p.endswith(".csv"))
    lines = out[0].strip().splitlines()
    assert lines[0] == "row_id,label" and [ln.split(",")[0] for ln in lines[1:]] == ["0", "1", "2"]
    assert lines[2].endswith(",A") and lines[3].endswith(",B")

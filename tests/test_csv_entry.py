import importlib
import os
import tempfile

from corvid.sources import read_csv, write_labels


def test_csv_newline_header_na_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="corvid-csv-")
    p = os.path.join(d, "wc.csv")
    with open(p, "w") as f:
        f.write('Team,Group,"First match \nagainst",Note\n')
        f.write('Iran,B,Spain,"a, b"\n')
        f.write(",,,\n")
        f.write("Korea,F,NA,x\n")
    df = read_csv(spark, p, multiline=True)
    assert df.columns == ["Team", "Group", "First match against", "Note"]
    rows = df.collect()
    assert rows[0].Note == "a, b"
    assert rows[-1]["First match against"] is None  # NA -> missing
    typed = read_csv(spark, p, schema="team string, grp string, first string, note string", multiline=True)
    assert typed.na.drop(how="all").count() == 2


def test_label_sink_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="corvid-out-")
    df = spark.createDataFrame([(0, "A"), (1, "B")], "row_id long, label string")
    write_labels(df, os.path.join(d, "pred"), single_file=True)
    write_labels(df, os.path.join(d, "pred"), single_file=True)  # overwrite
    back = read_csv(spark, os.path.join(d, "pred"), schema="row_id long, label string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_types_are_found_after_missing_tokens(spark):
    d = tempfile.mkdtemp(prefix="corvid-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("n,x,flag,day,text,blank,none\n1,1.5,true,2018-06-14,a, NA,NA\nNA,NaN,NA,,NA,b,\n3,2,false,2018-06-15,3,c,null\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "day": "date", "text": "string", "blank": "string", "none": "string"}
    rows = df.collect()
    assert [r.n for r in rows] == [1, None, 3] and [r.x for r in rows] == [1.5, None, 2.0]
    assert rows[0].blank == " NA" and rows[1].text is None and [r.none for r in rows] == [None] * 3


def test_entry_and_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    out = entry.entry(spark).collect()
    assert {r.part for r in out} == {"held_out", "training"}
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    from corvid.plans import ORACLE_SQL, QUERIES
    assert set(QUERIES) - set(ORACLE_SQL) == {"logit_fit_predict", "logit_evaluation"}


def test_dense_row_number(spark):
    from corvid.sources import dense_row_number
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v")
    out = dense_row_number(df).collect()
    assert sorted(r.row_id for r in out) == list(range(1000))
    assert all(r.row_id == r.v for r in out)  # input order kept


def test_dense_row_number_of_a_shuffled_input(spark):
    """More rows than the range sampler draws: a second run of the plan may cut its ranges elsewhere."""
    from pyspark.sql import functions as F

    from corvid.sources import dense_row_number
    df = spark.range(0, 300_000, 1, 16).select((F.xxhash64("id") % 1_000_003).alias("v"), F.col("id").alias("_place"))
    out = dense_row_number(df.repartitionByRange(7, "v").sortWithinPartitions("v"))
    got = out.agg(F.count("*"), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).first()
    assert tuple(got) == (300_000, 300_000, 0, 299_999) and out.columns == ["v", "_place", "row_id"]
    pairs = out.select("row_id", "v").orderBy("row_id").toPandas()
    assert pairs.v.is_monotonic_increasing
    assert dense_row_number(df.limit(0)).count() == 0

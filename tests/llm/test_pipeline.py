import duckdb
import pytest

import corpus_pipeline
from corvid.llm.oracle import ORACLE_SQL
from corvid.llm.queries import QUERIES
from corvid.llm.shared import stored, work_dir
from tests.conftest import SF_SMALL
from tests.llm.fixtures import documents, prose
from tests.test_plan_guard import _table


@pytest.fixture(scope="module")
def con():
    from corvid.sources import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = _table(QUERIES[name](spark, SF_SMALL).toPandas()), _table(con.execute(ORACLE_SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_stages_take_each_others_result(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token ids"]
    docs = start = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    folder, ids = work_dir(spark, "pipeline-test"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF_SMALL), f"{folder}/{k}")
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert k == 4 or docs.schema.simpleString() == start.schema.simpleString()
    assert start.count() >= len(ids[0]) >= len(ids[1]) >= len(ids[2]) > 0
    assert set(ids[3]) == set(ids[2]) and sorted(ids[4]) == sorted(ids[3])  # mixing repeats and loses nothing


def test_stages_on_odd_rows(spark):
    """Each stage alone, on missing values, empty and long texts, repeated rows; and on no row."""
    base = [(1, None), (2, ""), (None, "no id at all"), (3, prose(1, 6000)), (4, prose(2, 40)), (4, prose(2, 40)), (5, prose(2, 40) + " more"), (6, "x")]
    docs = documents(spark, base).select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        n = stage(spark, docs, SF_SMALL).count()
        assert n >= len(base) if k in (3, 4) else 0 <= n <= len(base)
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0

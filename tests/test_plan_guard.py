"""Every registered query against its SQL, and a scale guard on the plans that ran: no
cartesian product, no broadcast nested-loop join, in a query or in anything it stored
on the way (read from Spark's event log)."""

import json
import os

import duckdb
import pytest

from corvid.plans import ORACLE_SQL, QUERIES
from corvid.sources import TABLES
from tests.conftest import EVENTS, SF_SMALL

FORBIDDEN = {"CartesianProduct", "BroadcastNestedLoopJoin"}


def _table(df):
    import pandas as pd

    cols = sorted(df.columns)
    out = df[cols].copy()
    for c in cols:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = out[c].dt.date
        if pd.api.types.is_float_dtype(out[c]):
            out[c] = out[c].round(6)
    out = out.astype(object).where(out.notna(), None).astype(str).replace({r"\.0$": ""}, regex=True)
    return out.sort_values(cols).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _table(got), _table(want)
    assert len(a) == len(b) and a.equals(b), a.compare(b).head() if len(a) == len(b) else (len(a), len(b))


def _names(node):
    yield node["nodeName"]
    for x in node["children"]:
        yield from _names(x)


def test_no_all_pairs_join_ran(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen, bad = 0, set()
    for f in os.listdir(EVENTS):
        for line in open(os.path.join(EVENTS, f), errors="replace"):
            if "sparkPlanInfo" in line:
                try:
                    names = set(_names(json.loads(line)["sparkPlanInfo"]))
                except ValueError:  # the line being written
                    continue
                seen += 1
                bad |= names & FORBIDDEN
    assert seen > len(QUERIES) and not bad

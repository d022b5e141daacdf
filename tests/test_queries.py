"""Queries of the engine against their SQL twins on the smallest sample."""

import math

import duckdb
import pytest

from thornwall.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple("nan" if isinstance(v[i], float) and math.isnan(v[i]) else v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = [tuple(r) for r in df.collect()]
    assert found, "planted payloads must be found"
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_plain_documents_hold_no_payloads(spark):
    from pyspark.sql import functions as F

    from thornwall.config import DetectorConfig
    from thornwall.operators.chunk import chunk, prose
    from thornwall.operators.engine import detectors, findings

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert findings(chunk(prose(docs, F.col("doc_id"), F.col("text"))), detectors(DetectorConfig())).where("detector <> 'perplexity'").count() == 0


def test_a_scan_shuffles_only_by_path(spark):
    plan = QUERIES["full_scan"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" not in plan

"""The pipeline on the smallest sample: what stages drop and keep."""

import importlib

import pytest

corpus_pipeline = importlib.import_module("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SMALL), name))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_narrow(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == before.columns
        assert ids(after) <= ids(before)
        assert after.count() == len(ids(after))
    assert ids(stages[-1]) == ids(stages[-2])


def test_decisions_take_effect(spark, stages):
    from thornwall.llm import quality, simhash

    kept = {r["doc_id"] for r in quality.apply(stages[0]).where("kept").collect()}
    assert ids(stages[1]) == kept
    found = simhash.near_duplicates(stages[3]).collect()
    assert ids(stages[4]) == {r["component_id"] for r in found}


def test_repeated_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "a b c " * 9 + "d.", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SMALL).count() >= 0


def test_near_dedup_keeps_one_row_each(spark):
    text = "a long enough text that stands here twice under one id"
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text, "en", "s", 0), (None, "something else entirely", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()))) == ["1", "None"]

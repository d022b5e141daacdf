"""What keeps time and memory of a task from growing with the table."""

import random

import pytest
from pyspark.sql import functions as F

from thornwall.functions import stats
from thornwall.operators.chunk import chunk, prose, windows_of
from thornwall.plans.queries import QUERIES
from thornwall.sources.files import PART_BYTES, spread

SMALL = "/root/testdata/sf0.001"


def test_parts_follow_the_bytes_of_texts(spark):
    one = spark.range(0, 44, 1, 1).select("id", F.repeat(F.lit("x"), PART_BYTES // 8).alias("text"))
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() == 6
    assert dealt.select("id").distinct().count() == 44
    assert spread(one.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["human_report", "sarif_results", "quarantine_filter", "quarantine_append"])
def test_detectors_run_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= 1
    spark.catalog.clearCache()


def test_hashes_of_a_batch():
    draw = random.Random(3)
    values = [bytes(draw.randrange(256) for _ in range(draw.choice([0, 1, 2, 30, 300]))) for _ in range(60)] + [b"z" * 5000]
    assert stats.fnv1a64_all(values).tolist() == [stats.fnv1a64(v) for v in values]
    assert stats.fnv1a64_all([]).tolist() == []


def test_simhashes_of_a_batch(monkeypatch):
    draw = random.Random(4)
    words = ["a", "bb", "ümlaut", "語", "word", "ignore"]
    texts = ["", " ", *(" ".join(draw.choices(words, k=draw.randrange(1, 40))) for _ in range(50)), ""]

    def plain(text):
        tokens = [stats.fnv1a64(t.encode()) for t in text.split()]
        return sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in tokens) > len(tokens))

    for most in (1 << 20, 100, 1):
        monkeypatch.setattr(stats, "SLICE", most)
        assert stats.simhashes(texts).tolist() == [plain(t) for t in texts]


def test_windows_are_normalised_where_they_are_cut(spark):
    import unicodedata

    texts = ["", "plain " * 900, "ﬁne Å ½ é " * 700, "ｆ" * 683, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r["path"], r["chunk_seq"]): (r["span"]["start"], r["span"]["end"], r["text"]) for r in chunk(prose(rows, F.col("i"), F.col("t"))).collect()}
    want = {(str(i), k): (w["start"], w["end"], unicodedata.normalize("NFKC", t.encode()[w["start"] : w["end"]].decode())) for i, t in enumerate(texts) if t is not None for k, w in enumerate(windows_of(t.encode()))}
    assert got == want

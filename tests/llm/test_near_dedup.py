"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import importlib
import random

corpus_pipeline = importlib.import_module("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_is_jaccard(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(15):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 300))]
        texts.append(base)
        for changes in (1, 3, 6, 12):
            other = list(base)
            for _ in range(changes):
                other[rnd.randrange(len(other))] = f"w{rnd.randrange(5000)}"
            texts.append(other)
    texts = [" ".join(t) for t in texts]
    sets, low = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:  # the smallest id spreads along the links
        for i, a in enumerate(sets):
            for j in range(i):
                if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(low)


def test_near_dedup_of_repeated_and_null_ids(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(0, texts["a"]), (1, texts["a"]), (1, texts["b"]), (1, texts["c"]), (None, texts["c"]), (None, texts["d"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(0, texts["a"]), (1, texts["b"]), (1, texts["c"]), (None, texts["d"])], key=str)


def test_near_dedup_collects_the_drivers_garbage(spark):
    """What earlier stages left on the driver goes before and during this one."""

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.createDataFrame([(i, f"text {i} of few words", "en", "s", 0) for i in range(3)], SCHEMA)
    before = collections()
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 3
    assert collections() >= before + 3


def test_near_dedup_of_hot_simhashes(spark):
    """Texts with the same voters, of which each is like one other and no more: all pairs of a hot SimHash count."""
    jaccard = importlib.import_module("thornwall.llm.jaccard")
    rnd = random.Random(8)
    hashes = sorted((int(jaccard.shingles(f"w{i}", 1)[0]), f"w{i}") for i in range(4000))
    shared, other = [w for _, w in hashes[:8]], [w for _, w in hashes[8:]]
    rows = []
    for i in range(12):
        own = rnd.sample(other, 40)
        rows += [(2 * i, " ".join([*shared, *own])), (2 * i + 1, " ".join([*shared, *own[:38], other[-1 - i]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, low = [set(t.split()) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    found = {r["doc_id"]: r["group"] for r in jaccard.near_duplicates(docs, words=1).collect()}
    assert len(set(low)) == 12
    assert all((found[i] == found[j]) == (low[i] == low[j]) for i in found for j in found)

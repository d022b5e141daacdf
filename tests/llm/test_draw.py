"""The labelled sample of language identification."""

from thornwall.llm import language


def test_copies_are_drawn_one_by_one(spark, monkeypatch):
    seen, real = [], language.cluster

    def spy(vectors, *rest, **more):
        seen.append(len(vectors))
        return real(vectors, *rest, **more)

    monkeypatch.setattr(language, "cluster", spy)
    texts = [f"some words that stand in many documents of this language, form {k}" for k in range(4)]
    docs = spark.createDataFrame([(i, texts[i % 4], "en") for i in range(2000)], "doc_id long, text string, lang string")
    language.fit(docs, sample=100)
    assert 50 <= sum(seen) <= 200

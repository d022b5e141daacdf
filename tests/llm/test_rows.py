"""Line dedup of rows without an id, of rows that repeat one, and of long lines."""

from collections import Counter

from thornwall.llm import language, lines, simhash


def line(k):
    return " ".join(f"{k}word{k}{i}" for i in range(9))


def test_lines_of_null_and_repeated_ids(spark):
    shared, own = line("a"), [line(k) for k in "bcdefgh"]
    rows = [(0, shared), (None, f"{own[0]}\n{shared}\n{own[1]}"), (None, f"{own[2]}\n{own[3]}"), (5, f"{own[4]}\n{shared}"), (5, f"{own[5]}\n{own[6]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(0, shared, 0), (None, f"{own[0]}\n{own[1]}", 1), (None, f"{own[2]}\n{own[3]}", 0), (5, own[4], 1), (5, f"{own[5]}\n{own[6]}", 0)]
    got = [(r["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedupe(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_last_place_stays_in_bounds(spark):
    docs = spark.createDataFrame([(i, line("a")) for i in (-(1 << 63), (1 << 63) - 1, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedupe(docs).collect()}
    assert got == {-(1 << 63): 0, (1 << 63) - 1: 1, None: 1}


def test_private_names_may_clash(spark):
    names = ["row", "__row", "__id", "__gone", "__old", "h", "key", "line_no", "n_lines", "n_dropped"]
    docs = spark.createDataFrame([(i, f"{line('a')}\n{line(k)}", *names) for i, k in enumerate("bc")], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    got = sorted(lines.dedupe(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in got] == [f"{line('a')}\n{line('b')}", line("c")]
    assert [r["n_dropped"] for r in got] == [0, 1]
    assert all([r[n] for n in names[:8]] == names[:8] for r in got)


def test_simhash_of_null_ids(spark):
    a, b, c = ("near the river bank and then it runs home again " * 9, "something else entirely, that is never said twice", "a third text of some other words altogether")
    docs = spark.createDataFrame([(7, a), (None, a), (None, b), (None, b), (9, c)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == {(7, 7): 1, (None, 7): 1, (None, None): 2, (9, 9): 1}


def test_simhash_of_repeated_ids(spark):
    t1, t2 = "one text with words of its own", "another one that shares nothing with it"
    docs = spark.createDataFrame([(3, t1), (5, t1), (5, t2), (9, t2), (11, "a last one")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {3: 3, 5: 3, 9: 3, 11: 11}


def test_marks_alone_are_no_letter(spark):
    model = language.fit(spark.createDataFrame([(1, "some words here", "en"), (2, "des mots ici", "fr")], "doc_id long, text string, lang string"))
    assert model.predict(["e\u0301t\u0301"])[0][0] != "und"
    assert [r[0] for r in model.predict(["\u0301\u0302", "12 \u0301 !", None, ""])] == ["und"] * 4


def test_sample_is_bounded(spark, monkeypatch):
    seen, real = [], language.cluster
    monkeypatch.setattr(language, "cluster", lambda vectors, *rest, **more: (seen.append(len(vectors)), real(vectors, *rest, **more))[1])
    docs = spark.createDataFrame([(1, "the same row many times", "en")] * 500 + [(i, f"text number {i} of many", "en") for i in range(2, 60)], "doc_id long, text string, lang string")
    language.fit(docs, sample=20)
    assert 1 <= sum(seen) <= 40

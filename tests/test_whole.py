"""Engine queries on all rows against plain Python."""

import re

from pyspark.sql import functions as F

from thornwall.functions import stats
from thornwall.operators import detect
from thornwall.plans.queries import QUERIES, chunks
from thornwall.plans.spike import spiked

SMALL = "/root/testdata/sf0.001"


def test_text_functions_see_all_rows(spark):
    want = {r["doc_id"] for r in spiked(spark, SMALL).select("doc_id").collect()}
    got = QUERIES["text_functions"](spark, SMALL).collect()
    assert {r["doc_id"] for r in got} == want
    assert len(got) == len(want)


def test_fnv_of_all_words(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    words = {w for t in texts if t is not None for w in t.split(" ")}
    got = {r["word"]: r["fnv"] for r in QUERIES["fnv1a64"](spark, SMALL).collect()}
    assert got == {w: f"{stats.fnv1a64(w.encode()):016x}" for w in words}


def test_nearest_of_all_windows(spark):
    from thornwall.functions.text import normalise

    rows = chunks(spark, SMALL).where(F.octet_length("text") >= detect.MIN_SIMILAR_BYTES).select("path", "chunk_seq", normalise(F.col("text")).alias("t")).collect()
    known, want = [stats.simhash(p) for p in detect.PAYLOADS], set()
    for r in rows:
        d, i = min((bin(stats.simhash(r["t"]) ^ k).count("1"), i) for i, k in enumerate(known))
        if d <= detect.MAX_DISTANCE:
            want.add((r["path"], r["chunk_seq"], d))
    got = [(r["path"], r["chunk_seq"], r["distance"]) for r in QUERIES["simhash_nearest"](spark, SMALL).collect()]
    assert set(got) == want
    assert len(got) == len(want)


def test_strings_of_all_events(spark):
    n = spark.read.parquet(f"{SMALL}/events.parquet").count()
    got = QUERIES["json_strings"](spark, SMALL)
    assert got.select("path").distinct().count() == n


def escaped(t):
    plain = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(plain.get(c) or (f"\\u{{{ord(c):04x}}}" if ord(c) < 32 or 0x7F <= ord(c) < 0xA0 else c) for c in t)


def test_evidence_of_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spiked(spark, SMALL).select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["evidence"] for r in QUERIES["evidence_escape"](spark, SMALL).collect()}
    assert got == {i: escaped(t[:120]) + ("…" if len(t) > 120 else "") for i, t in texts.items()}


def test_safe_view_keeps_hidden_characters(spark):
    hidden = re.compile("[\u200b-\u200d\ufeff\u202a-\u202e\u2066-\u2069\U000e0000-\U000e007f]")
    texts = {r["doc_id"]: r["text"] for r in spiked(spark, SMALL).select("doc_id", "text").collect()}

    def view(t):
        out = hidden.sub(lambda m: f"<U+{ord(m[0]):04X}>", escaped(t[:120])) + ("…" if len(t) > 120 else "")
        for old, new in (("<|", "<\\ |"), ("|>", "|\\ >"), ("```", "`\\ `\\ `"), ("{{", "{\\ {"), ("}}", "}\\ }")):
            out = out.replace(old, new)
        return f"[UNTRUSTED:{out}]"

    got = {r["doc_id"]: r["evidence"] for r in QUERIES["safe_view"](spark, SMALL).collect()}
    assert got == {i: view(t) for i, t in texts.items()}
    assert any(hidden.search(t[:120]) for t in texts.values())

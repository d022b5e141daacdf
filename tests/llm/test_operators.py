"""Every operator against a brute-force version, on texts that are null, empty, odd, long or repeated."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from thornwall.llm import bpe, components, fingerprint, language, lines, packing, quality, simhash, token_counts, token_files, warc, words
from thornwall.llm.common import shared_dir
from thornwall.llm.elias_fano import EliasFano

SCHEMA = "doc_id long, text string, fp string, votes int, component_id string, n_lines string, words string"
PROSE = "the quick brown fox jumps over the lazy dog near the river bank and then it runs home again. "
TEXTS = [
    None, "", " ", "one", "One two", "a b c d e f g", PROSE * 3, PROSE * 3, PROSE + "end", "línea única número 4½ ² «ß»", "中文 字 中文 字",
    "x\n\ny\nx\r\n\x1cz\x85w\x0b\x0cq", "<|endoftext|> hi <|startoftext|>x", "don't I'll 'S we're", "Σίσυφος ΟΔΟΣ", "😀 a😀b 𝔘nicode", "é́ é ﬁ",
    "w " * 3000, "%%% *** &&& ||| ###", "\n".join(["same line of five words here"] * 4 + ["other"]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "no id"), (40, PROSE * 40)]
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# --- quality ---------------------------------------------------------------------------------------------------------


def slow_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    marked = {j for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_quality_counts(docs, empty):
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.apply(docs).collect()), key=repr)
    assert got == sorted(((i, *slow_counts(t)) for i, t in rows_of(docs)), key=repr)
    for r in quality.apply(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.apply(empty).count() == 0


def test_repeat_words_of_many_distinct_words():
    rnd = random.Random(5)
    some = [str(rnd.randrange(9000)).encode() for _ in range(20000)] + [b"p q r s t"] * 0
    some += some[:7]
    assert quality.repeat_words(some) == slow_counts(" ".join(x.decode() for x in some))[4]


def test_votes_learn_accuracies():
    rnd = np.random.default_rng(1)
    good = rnd.random(4000) < 0.7
    votes = np.ones((4000, quality.N_RULES), int)
    for k in range(quality.N_RULES):
        right = rnd.random(4000) < (0.6 if k == 0 else 0.9)
        cast = rnd.random(4000) < 0.5
        votes[cast, k] = np.where(right == good, 2, 0)[cast]
    codes = (votes * 3 ** np.arange(quality.N_RULES - 1, -1, -1)).sum(axis=1)
    patterns, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
    post, accuracy = quality.fit(patterns, counts.astype(float))
    assert ((post[at] >= 0.5) == good).mean() > 0.9
    assert abs(accuracy[0] - 0.6) < 0.06 and abs(accuracy[1:] - 0.9).max() < 0.05


# --- fingerprints ----------------------------------------------------------------------------------------------------


def test_fingerprints_with_next(spark, docs, empty):
    one_each = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {i: t or "" for i, t in rows_of(one_each)}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(one_each).collect()}
    assert len(got) == len(order)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        own, other = texts[i], texts[j]
        k = len(own) // 2
        edited = own[: len(own) - k] + other[:k]
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        mine = fingerprint.codes(own.encode())
        assert got[i]["fingerprint"] == fingerprint.digest(mine)
        assert got[i]["near_edited"] == pytest.approx(fingerprint.likeness(mine, fingerprint.codes(edited.encode())))
        assert got[i]["near_next"] == pytest.approx(fingerprint.likeness(mine, fingerprint.codes(other.encode())))
    assert fingerprint.compare_with_next(docs).count() == docs.count()
    assert fingerprint.compare_with_next(empty).count() == 0
    assert fingerprint.compare_with_next(docs.limit(1)).count() == 1


def test_digest_round_trip():
    code = fingerprint.codes(PROSE.encode() * 5)
    assert (fingerprint.parse(fingerprint.digest(code)) == code).all()
    assert fingerprint.likeness(code, code) == 1.0
    assert 0 <= fingerprint.likeness(code, fingerprint.codes(b"")) < 1


# --- tokens ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(words.public_path())


def odd_texts():
    rnd = random.Random(1)
    alphabet = "abAB'sStT 1²\n\t\x1c\x85é́Σς中😀<|>endoftext%.​"
    return [t or "" for t in TEXTS] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(500)]


def test_encoders_equal_the_library(library):
    texts = odd_texts()
    own = bpe.Codec(words.public_path())
    for text, want, a, b in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode(texts), words.library_encoder(words.public_path()).encode(texts), strict=True):
        assert np.frombuffer(a, "<u4").tolist() == want.ids, text
        assert a == b
        assert own.decode(a) == library.decode(want.ids, skip_special_tokens=False)


def test_encoder_table_is_bounded(monkeypatch, library):
    monkeypatch.setattr(words, "MAX_PIECES", 50)
    own = bpe.Codec(words.public_path())
    for text in odd_texts()[:60]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.encoder.table) <= 4000


def test_round_trip_query(docs, empty, library):
    got = sorted((tuple(r) for r in bpe.round_trip(docs, words.public_path()).collect()), key=repr)
    want = []
    for i, t in rows_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(empty, words.public_path()).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 0), (5, 3), (1000, 10**6), (700, 700), (3000, 10**9)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    code = EliasFano.from_bytes(EliasFano.encode(values, top).to_bytes())
    assert (code.all() == values).all()
    assert [code.select(i) for i in range(n)] == values.tolist()
    if n == 3000:
        assert len(code.to_bytes()) < 8 * n / 2


def test_token_files(spark, docs, empty, library):
    manifest = token_files.write(docs, words.public_path(), shared_dir(spark, "t"))
    got = [tuple(r) for r in token_files.read_back(manifest).collect()]
    encoded = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows_of(docs)]
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in encoded)
    assert Counter((i, n, crc) for i, _, n, crc in got) == want
    at, last = 0, -1
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        assert i is None or i >= last
        at, last = at + n, last if i is None else i
    cut = token_files.write(docs, words.public_path(), shared_dir(spark, "t"), most=50)
    assert Counter(tuple(r) for r in token_files.read_back(cut).collect()) == Counter(got)
    sizes = [r["n_ids"] for r in cut.collect()]
    assert len(sizes) > 8
    assert all(r["n_ids"] <= 50 or r["n_docs"] == 1 for r in cut.collect())
    file = token_files.TokenFile(manifest.first()["path"])
    assert file.ids(0).tolist()[-1] == 2
    assert token_files.read_back(token_files.write(empty, words.public_path(), shared_dir(spark, "t"))).count() == 0


def slow_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    for seed in range(150):
        rnd = random.Random(seed)
        size = rnd.choice([5, 16, 40, 100])
        counts = Counter(rnd.randint(1, size) for _ in range(rnd.randint(0, 150)))
        runs, fill = packing.plan(counts, size), {}
        for n, many in counts.items():
            own = [r for r in runs if r[0] == n]
            for rank in range(many):
                _, first, each, bin_, place = [r for r in own if r[1] <= rank][-1]
                q, m = divmod(rank - first, each)
                fill.setdefault(bin_ + q, []).append((place + m * n, n))
        rest = []
        for parts in fill.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            rest.append(size - at)
        assert sorted(rest) == slow_best_fit(list(counts.elements()), size)


def test_packing(docs, empty, library):
    got = packing.pack(docs, words.public_path(), size=64).collect()
    whole = Counter()
    for i, t in rows_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            whole[i, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == whole
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) == len(slow_best_fit([r["length"] for r in got], 64))
    assert packing.pack(empty, words.public_path()).count() == 0


def test_token_counts(docs, empty):
    path = words.public_path(token_counts.TOKENIZER)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    got = {}
    for r in token_counts.count_sections(docs.where("doc_id <> 3 and doc_id is not null"), path).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["length"], r["n_tokens"], r["boundary"])
    for i, t in rows_of(docs):
        if i in (3, None):
            continue
        t = t or ""
        cuts = [0, *(k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)), len(t)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        count, across = Counter(), Counter()
        for a, b in plain.encode(t, add_special_tokens=False).offsets:
            shares = [min(b, e) - max(a, s) for s, e in spans]
            inside = [k for k, (s, e) in enumerate(spans) if s <= a and b <= e and a < e]
            k = inside[0] if inside else max(range(len(spans)), key=lambda x: (shares[x], -x))
            count[k] += 1
            across[k] += not inside
        assert got[i] == {k: (s, e - s, count[k], across[k]) for k, (s, e) in enumerate(spans)}, i
    assert token_counts.count_sections(empty, path).count() == 0


def test_token_spans_equal_the_library():
    path = words.public_path(token_counts.TOKENIZER)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = odd_texts()
    for text, spans, want in zip(texts, token_counts.SpanEncoder(path).spans(texts), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [tuple(s) for s in spans.tolist()] == want.offsets, text


# --- near duplicates -------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, distance):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprint_of_words():
    for text in TEXTS:
        assert simhash.fingerprint(text) == slow_fingerprint(text), text


def test_near_duplicates(docs, empty):
    some = [(i, t) for i, t in rows_of(docs) if i is not None]
    ids = sorted({i for i, _ in some})
    fps = [slow_fingerprint(dict(some)[i]) for i in ids]
    want = {i: ids[g] for i, g in zip(ids, slow_groups(fps, 2), strict=True)}
    for r in simhash.near_duplicates(docs).collect():
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{slow_fingerprint(dict(some)[r['doc_id']]):016x}"
            assert r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0


def test_index_finds_all_links(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(20)}
    for _ in range(3):
        fps |= {f ^ 1 << rnd.randrange(64) for f in fps if rnd.random() < 0.8}
    fps = sorted(fps)[:220]
    want = slow_groups(fps, 2)
    nodes = np.arange(len(fps))
    assert simhash.forest(np.array(fps, np.uint64), nodes, 2).tolist() == want
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    for group in (1 << 20, 30):  # the second makes hot block values, which are dealt out again
        found = {r["node"]: r["component"] for r in components.components(simhash.links(table, 2, group)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (100, 101), (139, 100)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


# --- lines -----------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def slow_dedupe(rows):
    """Texts after dedup, by edit similarity of all pairs of distinct lines and nothing else."""
    norm = lambda line: tuple(re.findall(r"[^\W_]+", line.lower()))
    places = [(i, k, norm(line)) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(norm(line)) >= 5]
    kinds = sorted({n for _, _, n in places})
    parent = list(range(len(kinds)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for j in range(i):
            x, y = " ".join(a), " ".join(kinds[j])
            if 1 - distance(x, y) / max(len(x), len(y)) >= 0.8 - 1e-12:
                parent[root(i)] = root(j)
    first = {}
    for i, k, n in sorted(places):
        first.setdefault(root(kinds.index(n)), (i, k))
    keep = {(i, k) for i, k in first.values()}
    gone = {(i, k) for i, k, _ in places} - keep
    return {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def line_texts():
    rnd = random.Random(2)
    vocab = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "of", "the"]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 40))) for _ in range(12)]

    def vary(line):
        parts = line.split()
        if rnd.random() < 0.6:
            parts[rnd.randrange(len(parts))] += "s"
        return ("  " if rnd.random() < 0.3 else "") + " ".join(parts).capitalize() + rnd.choice([".", "!", ""])

    docs = ["\n".join(vary(rnd.choice(base)) for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    return [*docs, None, "", "short line", "short line\n\nshort line", "Zahl 5 größer ändern über Länge\nzahl 5 GRÖSSER ändern über länge"]


@pytest.mark.parametrize("hot", [64, 3])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rows = list(enumerate(line_texts()))
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, doc_key string, line_no string")
    got = {r["doc_id"]: r["text"] for r in lines.dedupe(docs).collect()}
    assert got == slow_dedupe(rows)
    assert lines.dedupe(docs).columns[:4] == docs.columns


def test_line_dedup_of_a_hot_passage(spark):
    """Many lines with the same voters, the longest words, of which some are alike and none with most others."""
    rnd = random.Random(11)
    passage = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(13)) for _ in range(8))
    tails = [["".join(rnd.choice("abcdefghijklmnop") for _ in range(2)) for _ in range(34)] for _ in range(12)]
    rows = [" ".join([passage, *t]) for t in tails] + [" ".join([passage, *t[:20], "zz", "yy", *t[22:]]) for t in tails]
    rows = list(enumerate(rows))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedupe(docs).collect()}
    assert got == slow_dedupe(rows)
    assert sum(t == "" for t in got.values()) == 12


def test_line_dedup_reads_texts_once(spark, monkeypatch):
    """Lines of hot SimHashes need their texts in several turns, but the documents are cut for them once."""
    read, texts = [], lines.line_texts
    monkeypatch.setattr(lines, "line_texts", lambda *args: read.append(1) or texts(*args))
    rnd = random.Random(6)
    passage = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(13)) for _ in range(6))
    rows = [(i, f"{passage} {' '.join(rnd.choice('qrstuvwxyz') * 3 for _ in range(30))}") for i in range(12)]
    lines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert len(read) == 1


def test_line_dedup_of_odd_tables(spark, docs, empty):
    assert lines.dedupe(docs).count() == docs.count()
    assert lines.dedupe(empty).count() == 0


def test_very_long_lines(spark):
    """Lines of 2 MB that differ in few words are one group; another of that length isn't."""
    base = [f"w{i * 7919 % 300007}x" for i in range(250_000)]
    other = [*base[:1000], "inserted", "words", *base[1000:120_000], "replaced", *base[120_001:]]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(reversed(base)) + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.dedupe(docs).collect()} == {1: 0, 2: 1, 3: 0}


# --- language --------------------------------------------------------------------------------------------------------


def test_language(spark, docs, empty):
    rnd = random.Random(4)
    vocab = {"en": "the of and to in is that was for with house water".split(), "de": "der die und das nicht ein für über haus wasser größe".split(), "fr": "le la et les des est une été où maison l'eau français".split()}
    rows = [(i, lang, " ".join(rnd.choice(vocab[lang]) for _ in range(30))) for i in range(300) for lang in [rnd.choice(list(vocab))]]
    table = spark.createDataFrame([*rows, (900, None, "the of"), (901, "en", None), (902, "en", "12 34")], "doc_id long, lang string, text string")
    model = language.fit(table.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in language.predict(table, model).collect()}
    assert len(got) == 303
    held = [(i, lang) for i, lang, _ in rows if i % 3 == 1]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert (got[901]["lang_pred"], got[902]["lang_pred"], got[901]["rejected"]) == ("und", "und", True)
    assert language.predict(docs, model).count() == docs.count()
    assert language.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(table.limit(0))).collect()} == {"und"}


def test_grams_of_blocks(monkeypatch):
    text = PROSE * 20 + "ÄÖÜ 中文 😀"
    whole = language.grams(text)
    monkeypatch.setattr(language, "_BLOCK", 1 << 20)
    assert (language.grams(text) == whole).all()
    assert language.grams("1 2 3") is None and language.grams(None) is None


def test_held_out():
    assert language.held_out(5) == (zlib.crc32(b"5") % 3 == 1)


# --- archives --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://www{i % 3}.Example.org/{i % 5}?q={i}", f"<p>page {i % 4} é</p>", "x") for i in range(40)]
    rows += [(50, None, None, "x"), (51, "http://a.b/x\ty", "", "x"), (None, "bad://[", "<p>page 1 é</p>", "x"), (1, "http://again", "<p>page 1 é</p>", "x"), (60, "", "\r\n\r\nWARC/1.1\r\n" * 50, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string")


def test_archives(spark, pages):
    archives = warc.write(pages, shared_dir(spark, "w"))
    index = warc.build_index(warc.captures(archives), shared_dir(spark, "i"), 4)
    got = [tuple(r) for r in warc.read_records(index).collect()]
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first = {}
    for i, data in rows:
        if i is not None:
            first[data] = min(first.get(data, i), i)
    want = Counter()
    for i, data in rows:
        head = first.get(data)
        again = head is not None and (i is None or i > head)
        want[i, len(data), warc.digest_of(data), "revisit" if again else "response", head if again else None] += 1
    assert Counter(got) == want
    lookup = warc.Index(index).lookup
    for r in pages.collect():
        found = lookup(r["url"])
        assert any(f["WARC-Record-ID"] == f"<urn:page:{'' if r['page_id'] is None else r['page_id']}>" for f, _ in found)
    (fields, body), *_ = lookup("http://www0.example.org/0?q=0")
    assert fields["WARC-Type"] == "response" and body == "<p>page 0 é</p>".encode()
    assert lookup("http://nowhere.example/") == []


def test_no_archives(spark, pages):
    archives = warc.write(pages.limit(0), shared_dir(spark, "w"))
    assert warc.read_records(warc.build_index(warc.captures(archives), shared_dir(spark, "i"))).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.Example.org:8080/a/b?c=d") == "org,example,www:8080)/a/b?c=d"
    assert warc.url_key(None) == ""

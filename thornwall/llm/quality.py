"""Quality rules by weak supervision.

Each rule votes good (+1), junk (-1) or abstains (0) on a document. Votes are a function of a few exact counts
of the whole text. Expectation-maximisation estimates each rule's accuracy from the number of documents with each combination of votes; a document is kept if its posterior
probability of being good is at least `threshold` and no hard base rule fails.

The documents go through Python once. What the driver sees is one row per combination of votes, at most 3^N_RULES
rows whatever the input size.

Defined cases: null text counts as empty; a text without words fails the base rule (fewer than MIN_WORDS words);
repeated rows each get a row of their own; an empty table gives an empty result; columns other than the id and the
text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, map_batches, materialize, slices

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
THRESHOLD = 0.5

#: Warning rules: name, measure, junk if it is below a or above b, clean if it is in [c, d]; else neither.
WARNINGS = (
    ("length", "n_words", MIN_WORDS, 1_000_000, 30, 100_000),
    ("word_length", "mean_word", 2.0, 14.0, 3.0, 10.0),
    ("symbols", "symbol_rate", -1.0, 0.15, 0.0, 0.02),
    ("repeated_lines", "dup_line_rate", -1.0, 0.3, 0.0, 0.05),
    ("repeated_windows", "repeat_rate", -1.0, 0.2, 0.0, 0.05),
    ("letters", "alpha_rate", 0.75, 2.0, 0.95, 1.0),
    ("capitals", "upper_rate", -1.0, 0.5, 0.0, 0.2),
    ("exclamations", "shout_rate", -1.0, 0.2, 0.0, 0.02),
    ("digits", "digit_rate", -1.0, 0.25, 0.0, 0.05),
)
#: A warning rule votes junk or abstains. Two more rules vote good or abstain: `clean` if every measure is clean,
#: `prose` if nearly all words have letters and the share of words that end in a stop or comma is in a range.
PROSE, PROSE_LETTERS = (0.08, 0.4), 0.9
RULES = (*(w[0] for w in WARNINGS), "clean", "prose")
N_RULES = len(RULES)

#: The accuracy that a rule is thought to have before any document is seen, and its weight in votes.
START, START_DOCS = 0.85, 10.0

FEATURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, votes int"
)
_FIELDS = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("votes", pa.int32())]
)
_NOT_CONT = bytes(range(0x80, 0xC0))
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_LOWER = bytes(x for x in range(256) if not 97 <= x <= 122)
_KEEP = {name: bytes(set(range(256)) - set(chars)) for name, chars in (("symbol", SYMBOLS), ("digit", b"0123456789"), ("shout", b"!"))}


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of `window` words that occurs at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    code, size = ids[: n - window + 1], len(seen)
    for k in range(1, window):  # exact codes: made dense again before the product could leave 63 bits
        if size > (1 << 62) // len(seen):
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code, size = code * len(seen) + ids[k : n - window + 1 + k], size * len(seen)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(len(code), np.bool_)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[dict[str, int], dict[str, float]]:
    """Exact counts of a text, and the rates that the rules look at."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    n_chars = len(joined.translate(None, _NOT_CONT))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n_symbols = len(data.translate(None, _KEEP["symbol"]))
    base = {
        "n_words": n,
        "word_chars": n_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
    }
    per = max(n, 1)
    digits, shouts = len(joined.translate(None, _KEEP["digit"])), len(joined.translate(None, _KEEP["shout"]))
    cased, capitals = letters(text)
    with_letter = sum(1 for w in words if w.lower() != w.upper() or not w.isascii())
    rates = {
        "n_words": n,
        "mean_word": n_chars / per,
        "symbol_rate": n_symbols / per,
        "dup_line_rate": base["n_dup_lines"] / max(1, len(lines)),
        "repeat_rate": base["n_repeat_words"] / per,
        "alpha_rate": with_letter / per,
        "upper_rate": capitals / max(1, cased),
        "shout_rate": shouts / per,
        "digit_rate": digits / max(1, n_chars),
        "stop_rate": sum(w[-1] in b".,;:?" for w in words) / per,
    }
    return base, rates


def letters(text: str) -> tuple[int, int]:
    """Letters that have case, and capitals."""
    if text.isascii():
        data = text.encode()
        upper = len(data.translate(None, _NOT_UPPER))
        return upper + len(data.translate(None, _NOT_LOWER)), upper
    upper = sum(map(str.__ne__, text, low)) if len(low := text.lower()) == len(text) else sum(c != c.lower() for c in text)
    lower = sum(map(str.__ne__, text, up)) if len(up := text.upper()) == len(text) else sum(c != c.upper() for c in text)
    return upper + lower, upper


def vote_code(rates: dict[str, float]) -> int:
    """The votes of all rules as one number in base 3 (0 junk, 1 abstains, 2 good). No words: all abstain."""
    votes, clean = [], True
    for _, value, a, b, c, d in WARNINGS:
        x = rates[value]
        votes.append(0 if x < a or x > b else 1)
        clean = clean and c <= x <= d
    prose = rates["alpha_rate"] >= PROSE_LETTERS and PROSE[0] <= rates["stop_rate"] <= PROSE[1]
    votes += [1 + clean, 1 + prose]
    code = 0
    for v in votes if rates["n_words"] else [1] * N_RULES:
        code = code * 3 + v
    return code


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def features(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, base verdict and votes."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for part in slices(batch):
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                base, rates = counts(text)
                rows.append((i, *base.values(), base_fails(base["n_words"], base["n_repeat_words"]), vote_code(rates)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    return map_batches(id_text(docs), one, FEATURES)


def votes_of(codes: np.ndarray) -> np.ndarray:
    """(patterns, rules) of -1, 0, 1."""
    powers = 3 ** np.arange(N_RULES - 1, -1, -1)
    return (codes[:, None] // powers) % 3 - 1


def fit(codes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern of votes, and each rule's accuracy.

    A rule that votes is right with its accuracy whatever the class; one that abstains says nothing. Classes count
    as equally likely beforehand, so that no votes at all leave 0.5. Accuracies start at START, which also weighs
    START_DOCS votes in every round, and stay in [0.55, 0.99]: a vote never counts against its own direction.
    """
    votes = votes_of(codes)
    accuracy, post = np.full(N_RULES, START), np.full(len(codes), 0.5)
    for _ in range(rounds):
        new = 1 / (1 + np.exp(-np.clip(votes @ np.log(accuracy / (1 - accuracy)), -500, 500)))
        right = weights @ ((votes == 1) * new[:, None] + (votes == -1) * (1 - new)[:, None])
        accuracy = np.clip((right + START * START_DOCS) / (weights @ np.abs(votes) + START_DOCS), 0.55, 0.99)
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    return post, accuracy


def apply(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, votes, posterior and verdict of every document."""
    spark = docs.sparkSession
    found = materialize(features(docs), "quality")
    groups = found.groupBy("votes").count().collect()  # at most 3^N_RULES rows
    codes = np.array([r["votes"] for r in groups], np.int64)
    post, _ = fit(codes, np.array([r["count"] for r in groups], float))
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True)], "votes int, p_good double")
    return (
        found.join(F.broadcast(table), "votes", "left")
        .withColumn("p_good", F.round("p_good", 6))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes")
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(documents(spark, sf_dir))

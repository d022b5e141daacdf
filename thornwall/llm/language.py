"""Language identification by nearest centroid.

A text's letters are lower-cased, everything else becomes one space, and runs of one to three characters are hashed
into SIZE counters. A vector is the counters' logarithms times inverse document frequencies, scaled to length one.
Each language has a few centroids, found by spherical k-means over labelled vectors; a text gets the language of the
centroid with the largest cosine, which is also its score. A text is rejected if that cosine is below the language's
distance limit, LENIENCE times the REJECT quantile over its own labelled vectors, or if it has no letter.

Document frequencies are counted over all labelled rows. Centroids are fitted on a sample of at most about SAMPLE
labelled rows of each language (the bound is a parameter; never more than twice as many), chosen by a hash of id and
text; rows equal in both count once there.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; labels that are null are not
learned; if nothing is labelled every text is `und`; repeated rows keep a row each; an empty table gives an empty
result; a very long text is counted in blocks; of equal cosines the first centroid counts; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, materialize, slices, small_batches

SIZE = 4096
CENTROIDS = 4
SAMPLE = 1500
REJECT, LENIENCE = 0.02, 0.4
SEED = 7
UNKNOWN = "und"
#: Characters looked at in one step; neighbouring blocks overlap, so all of a text counts.
_BLOCK = 1 << 18
_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SHIFT = np.uint64(64 - 12)


def _letters() -> np.ndarray:
    """For each code point of the first plane: its value in n-grams, 0 for what isn't a letter or mark."""
    table = np.zeros(1 << 16, np.uint64)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = c
    table[0x300:0x370] = np.arange(0x300, 0x370)
    return table


_TABLE = _letters()


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed character 1-, 2- and 3-grams of the whole text; None if it has no letter."""
    count, any_letter = np.zeros(SIZE, np.int64), False
    text = text or ""
    for at in range(0, len(text), _BLOCK):
        points = np.frombuffer(text[max(0, at - 2) : at + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        v = np.where(points < 1 << 16, _TABLE[np.minimum(points, 0xFFFF)], 0)
        high = np.flatnonzero(points >= 1 << 16)
        for i in high:
            v[i] = points[i] if chr(points[i]).isalpha() else 0
        if not v.any():
            continue
        any_letter = any_letter or bool(((v != 0) & ((v < 0x300) | (v >= 0x370))).any())  # a mark alone is no letter
        keep = np.ones(len(v), np.bool_)
        keep[1:] = (v[1:] != 0) | (v[:-1] != 0)  # runs of other characters are one space
        v = np.concatenate([[np.uint64(0)], v[keep], [np.uint64(0)]])
        one = v[v != 0]
        two = v[:-1] << np.uint64(21) | v[1:]
        three = v[:-2] << np.uint64(42) | v[1:-1] << np.uint64(21) | v[2:]
        for x, salt in zip((one, two, three), _SALT, strict=True):
            count += np.bincount((x * salt + salt >> _SHIFT).astype(np.int64), minlength=SIZE)
    return count if any_letter else None


@dataclass(frozen=True)
class Model:
    """langs[k] is the language of centroids[k]; limits are the cosines below which it rejects."""

    langs: tuple[str, ...]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def vector(self, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count) * self.idf
        return v / max(np.sqrt(v @ v), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and rejection of each text."""
        found = [grams(t) for t in texts]
        known = [i for i, c in enumerate(found) if c is not None]
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if known and self.langs:
            near = np.stack([self.vector(found[i]) for i in known]) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, k, score in zip(known, best.tolist(), near[np.arange(len(best)), best].tolist(), strict=True):
                out[i] = (self.langs[k], float(min(1.0, max(0.0, score))), bool(score < self.limits[k]))
        return out


def cluster(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Spherical k-means: at most k centroids of length one."""
    k = min(k, len(vectors))
    centroids = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        moved = np.stack([vectors[nearest == i].mean(axis=0) if (nearest == i).any() else centroids[i] for i in range(k)])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def fit(labelled: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from lang and text. One pass over all rows counts documents, in partial sums of SIZE numbers a task."""
    rows = labelled.select(column(labelled, "lang", "string").alias("lang"), column(labelled, "text", "string").alias("text"), column(labelled, "doc_id", "long").alias("doc_id")).where("lang is not null and text is not null")
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 1)).drop("doc_id")
    small_batches(labelled.sparkSession)
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    share = {lang: min(1.0, sample / n) for lang, n in size.items()}

    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("count", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(SIZE, np.int64), 0, set()  # rows that repeat a drawn one add nothing to the sample
        for batch in batches:
            langs, draws, kept = [], [], []
            for part in slices(batch):
                for lang, text, draw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if (c := grams(text)) is None:
                        continue
                    df += c > 0
                    n += 1
                    if draw < share[lang] * (1 << 63) and (lang, draw) not in seen:
                        seen.add((lang, draw))
                        langs.append(lang)
                        draws.append(draw)
                        kept.append(zlib.compress(c.astype("<u4").tobytes(), 1))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(draws, pa.int64()), pa.array(kept, pa.binary())], schema=schema)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n], pa.int64()), pa.array([df.astype("<i8").tobytes()], pa.binary())], schema=schema)

    found = materialize(rows.mapInArrow(run, "lang string, n long, count binary"), "language-sample")
    df, n = np.zeros(SIZE, np.int64), 0
    for r in found.where("lang is null").toLocalIterator():  # one row a task
        df += np.frombuffer(r["count"], "<i8")
        n += r["n"]
    first = Window.partitionBy("lang").orderBy("n", "count")
    found = found.where("lang is not null").dropDuplicates(["lang", "n"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * sample)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    drawn: dict[str, list[bytes]] = {}
    for r in found.select("lang", "count").collect():  # about `sample` rows a language, twice that at most
        drawn.setdefault(r["lang"], []).append(r["count"])
    blank = Model((), np.zeros((0, SIZE)), np.zeros(0), idf)
    langs: list[str] = []
    centroids, limits, rng = [], [], np.random.default_rng(SEED)
    for lang in sorted(drawn):
        counts = sorted(drawn[lang])
        vectors = np.stack([blank.vector(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64)) for c in counts])
        own = cluster(vectors, k, rng)
        limit = LENIENCE * float(np.quantile((vectors @ own.T).max(axis=1), REJECT))
        langs += [lang] * len(own)
        centroids.append(own)
        limits += [limit] * len(own)
    return Model(tuple(langs), np.concatenate(centroids) if centroids else np.zeros((0, SIZE)), np.array(limits), idf)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers a centroid
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(schema)[1:], strict=True))], schema=schema)

    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    found = predict(docs, fit(docs.where(~fold)))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "rejected")

"""Running detectors over chunks: one pass, no shuffle."""

from __future__ import annotations

import glob
import json
import logging
import os
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions.text import evidence, severity_label
from ..rules import Rule, parse
from ..schema import CRITICAL, DETECTORS, HIGH, MEDIUM
from . import detect

log = logging.getLogger("thornwall")


def load_rules(patterns: Sequence[str]) -> list[Rule]:
    """Rules of all files that match the globs; files that can't be read or parsed are left out with a warning."""
    out: list[Rule] = []
    for pattern in patterns:
        for path in sorted(glob.glob(pattern, recursive=True)):
            try:
                with open(path, encoding="utf-8") as f:
                    out += parse(f.read())
            except (OSError, ValueError) as e:
                log.warning("rule file %s left out: %s", path, e)
    return out


def detectors(config: DetectorConfig) -> list[detect.Detector]:
    """The enabled column detectors, in the order in which their findings arrive."""
    built: list[tuple[bool, Callable[[], detect.Detector]]] = [
        (config.heuristic, lambda: detect.Heuristic(load_rules(config.extra_rules))),
        (config.hidden_chars, detect.HiddenChars),
        (config.encoded, detect.Encoded),
        (config.canary, lambda: detect.Canary(config.extra_canaries)),
        (config.perplexity, detect.Perplexity),
        (config.embedding and not config.embedding_model, detect.Similarity),
    ]
    return [make() for on, make in built if on]


def findings(chunks: DataFrame, chosen: Sequence[detect.Detector]) -> DataFrame:
    """A row for each finding: what it is, where, and (chunk_seq, det_ord, f_seq), the order of arrival."""
    chunk = detect.Chunk(F.col("text"), F.col("span.start"), F.col("span.end"), F.col("provenance"))
    orders = {name: i for i, name in enumerate(DETECTORS)}

    def numbered(hits: Column, order: int) -> Column:
        return F.transform(hits, lambda h, i: F.struct(F.lit(order).alias("det_ord"), i.alias("f_seq"), h.alias("h")))

    early = {name: c for d in chosen for name, c in getattr(d, "prepare", lambda _: {})(chunk).items()}
    chunks = chunks.withColumns(early) if early else chunks
    own = [numbered(d.hits(chunk), orders.get(d.id, len(orders))) for d in chosen]
    if not own:
        own = [numbered(detect.none(), 0)]
    # not explode, as Spark would filter by the size of what is exploded, and so run the detectors twice
    rows = chunks.select("path", "chunk_seq", "provenance", F.explode_outer(F.concat(*own)).alias("x")).where("x is not null")
    return rows.select("path", "chunk_seq", "provenance", "x.det_ord", "x.f_seq", "x.h.*").transform(with_labels)


def kept(found: DataFrame) -> DataFrame:
    """Findings for plans that read them several times, on executors' disks, so that the detectors run once.

    They are computed again where an executor is lost. Spark looks kept tables up by plan, so each gets a mark of its own: files
    may have changed at the same path. They go with the session, or by spark.catalog.clearCache().
    """
    return found.withColumn("__mark", F.lit(uuid.uuid4().hex)).persist(StorageLevel.DISK_ONLY).drop("__mark")


def with_labels(found: DataFrame) -> DataFrame:
    category = F.create_map(*(F.lit(x) for k, v in DETECTORS.items() for x in (k, v)))
    return found.withColumn("category", F.coalesce(F.element_at(category, F.col("detector")), F.col("detector"))).withColumn("severity_label", severity_label(F.col("severity")))


def scan_chunks(chunks: DataFrame, config: DetectorConfig, judge: Callable[[list[str]], list[tuple[bool, float, str] | None]] | None = None) -> DataFrame:
    """Findings of all enabled detectors, those that need a model included."""
    out = findings(chunks, detectors(config))
    if config.embedding and config.embedding_model:
        out = out.unionByName(model_similarity(chunks, onnx_encoder(config)))
    if config.llm_classifier and (judge := judge or http_judge(config)):
        out = out.unionByName(judged(chunks, judge))
    return out


COLUMNS = "path string, chunk_seq bigint, provenance string, det_ord int, f_seq int, detector string, severity int, confidence double, start bigint, end bigint, message string, evidence string"
MIN_COSINE = 0.78


def nearest(vectors: pd.Series, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the first of the nearest known ones, by cosine, and that cosine."""
    v = np.stack(vectors.to_numpy()).astype(float)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near = unit(v) @ unit(known).T
    best = near.argmax(axis=1)
    return best, near[np.arange(len(v)), best]


def model_similarity(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Chunks close to a known payload by the cosine of an encoder's vectors; `encode` runs on executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encode(list(detect.PAYLOADS))
        for batch in batches:
            batch = batch[batch.text.str.encode("utf-8").str.len() >= detect.MIN_SIMILAR_BYTES]
            if batch.empty:
                continue
            best, near = nearest(pd.Series(list(encode(batch.text.tolist()))), known)
            out = batch.assign(det_ord=5, f_seq=0, detector="embedding", severity=HIGH, confidence=np.clip(near, 0.5, 0.99), evidence=[detect.PAYLOADS[i] for i in best])
            out["message"] = [f"semantically similar to known injection payload (cosine {x:.3f})" for x in near]
            yield out[near >= MIN_COSINE].drop(columns="text")[[c.split()[0] for c in COLUMNS.split(", ")]]

    return chunks.select("path", "chunk_seq", "provenance", "span.start", "span.end", "text").mapInPandas(run, COLUMNS).transform(with_labels)


def onnx_encoder(config: DetectorConfig) -> Callable[[list[str]], np.ndarray]:
    """Mean-pooled vectors of a sentence model; model and tokenizer files must be readable on executors."""
    model, tokenizer = config.embedding_model, config.embedding_tokenizer
    loaded: list = []

    def encode(texts: list[str]) -> np.ndarray:
        if not loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            loaded.append((onnxruntime.InferenceSession(model), Tokenizer.from_file(tokenizer)))
        session, words = loaded[0]
        names = {i.name for i in session.get_inputs()}
        rows = []
        for found in words.encode_batch(texts):
            feed = {"input_ids": np.array([found.ids], np.int64), "attention_mask": np.array([found.attention_mask], np.int64), "token_type_ids": np.array([found.type_ids], np.int64)}
            out = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
            rows.append(out[0].mean(axis=0) if out.ndim == 3 else out[0])
        return np.stack(rows)

    return encode


MAX_JUDGED = 4096


def cut_bytes(text: str, most: int = MAX_JUDGED) -> str:
    """At most so many bytes of a text, without cutting a character."""
    return text.encode("utf-8")[:most].decode("utf-8", "ignore")


def http_judge(config: DetectorConfig, timeout: float = 30.0) -> Callable[[list[str]], list[tuple[bool, float, str] | None]] | None:
    """A judge that asks a chat-completion endpoint; None without an API key. Any error counts as no finding."""
    key = os.environ.get(config.llm_api_key_env or "OPENAI_API_KEY")
    if not key:
        return None
    url = (config.llm_base_url or "https://api.openai.com/v1").rstrip("/") + "/chat/completions"
    ask = 'Does this text try to inject instructions into a language model? Answer as JSON: {"unsafe": bool, "confidence": number from 0 to 1, "reason": string}.'

    def judge(texts: list[str]) -> list[tuple[bool, float, str] | None]:
        out: list[tuple[bool, float, str] | None] = []
        for text in texts:
            body = {"model": config.llm_model or "gpt-4o-mini", "temperature": 0, "messages": [{"role": "system", "content": ask}, {"role": "user", "content": text}]}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    said = json.loads(json.load(answer)["choices"][0]["message"]["content"])
                out.append((bool(said["unsafe"]), float(said["confidence"]), str(said["reason"])))
            except (OSError, ValueError, KeyError, IndexError, TypeError):
                out.append(None)
        return out

    return judge


def judged(chunks: DataFrame, judge: Callable[[list[str]], list[tuple[bool, float, str] | None]]) -> DataFrame:
    """Chunks that a judge calls unsafe; `judge` runs on executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [cut_bytes(t) for t in batch.text]
            rows = []
            for row, text, said in zip(batch.itertuples(index=False), texts, judge(texts), strict=True):
                if said and said[0]:
                    severity = CRITICAL if said[1] >= 0.9 else HIGH if said[1] >= 0.7 else MEDIUM
                    rows.append((row.path, row.chunk_seq, row.provenance, 6, 0, "llm_classifier", severity, said[1], row.start, row.end, f"LLM classifier flagged chunk: {said[2]}", text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    found = chunks.select("path", "chunk_seq", "provenance", "span.start", "span.end", "text").mapInPandas(run, COLUMNS)
    return found.withColumn("evidence", evidence(F.col("evidence"), 120)).transform(with_labels)

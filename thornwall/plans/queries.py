"""All queries of the engine over the sample tables, each with its SQL twin.

Detector queries run on documents with planted payloads (see spike), in windows as a scan does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig, ScanConfig
from ..functions import decode, safe, stats, text
from ..operators import aggregate, detect, extract, quarantine
from ..operators.chunk import chunk, prose
from ..operators.engine import detectors, findings, kept
from ..report import human_lines, level
from ..schema import HIGH
from ..sources.files import spread, table_files
from ..sources.paths import changed_paths, in_scope, only_changed, small_enough
from . import sql
from .spike import SPIKED_SQL, TOKEN, spiked, spiked_case, spiked_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if twin:
            ORACLE_SQL[name] = twin
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(prose(spiked(spark, sf_dir), F.col("doc_id"), F.col("text")))


ALL = DetectorConfig(extra_canaries=[TOKEN])


def found(spark: SparkSession, sf_dir: str, *chosen: str) -> DataFrame:
    """Findings of some detectors, or of all that are on."""
    own = [d for d in detectors(ALL) if not chosen or d.id in chosen]
    return findings(chunks(spark, sf_dir), own)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("path", "chunk_seq", "detector", "severity", F.round("confidence", 4).alias("confidence"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "message", "evidence")


SHOWN = "path, CAST(chunk_seq AS BIGINT) AS chunk_seq, detector, severity, round(CAST(confidence AS DOUBLE), 4) AS confidence, start_ AS start_byte, end_ AS end_byte, message, evidence"

# --- windows and scalar functions ----------------------------------------------------------------------------------


@query("chunk_windows", f"WITH RECURSIVE {SPIKED_SQL}, {sql.windows('spiked')} SELECT path, chunk_seq, s AS start_byte, e AS end_byte, CAST(length(t) AS INTEGER) AS n_chars FROM chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("path", "chunk_seq", F.col("span.start").alias("start_byte"), F.col("span.end").alias("end_byte"), F.char_length("text").alias("n_chars"))


@query("nfkc_text", f"WITH {SPIKED_SQL} SELECT doc_id, sha256(text) AS sha FROM spiked")
def nfkc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample texts are NFKC already, so SQL, which lacks it, compares them with themselves."""
    return spiked(spark, sf_dir).select("doc_id", F.sha2(text.nfkc(F.col("text")).cast("binary"), 256).alias("sha"))


@query("evidence_escape", f"WITH {SPIKED_SQL} SELECT doc_id, {sql.evidence('text', 120)} AS evidence FROM spiked")
def evidence_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on the whole text of every row, of which it shows the first 120 characters."""
    return spiked(spark, sf_dir).select("doc_id", text.evidence(F.col("text"), 120).alias("evidence"))


@query("safe_view")
def safe_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on the whole text of every row, those with hidden characters too; tested against plain Python."""
    return spiked(spark, sf_dir).select("doc_id", safe.safe_evidence(F.col("text")).alias("evidence"))


@query(
    "text_functions",
    f"""WITH {SPIKED_SQL}
    SELECT doc_id, length(regexp_replace(text, '{sql.MARK}', '', 'g')) AS n_without_marks, sha256({sql._translate('text')}) AS mapped,
           regexp_replace(lower(regexp_replace(text, '[^\\pL\\p{{Nd}}]+', ' ', 'g')), '^ ', '') AS normalised
    FROM spiked""",
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spiked(spark, sf_dir)
    mapped = F.sha2(text.remap_confusables(F.col("text")).cast("binary"), 256)
    return rows.select("doc_id", F.char_length(text.strip_marks(F.col("text"))).cast("bigint").alias("n_without_marks"), mapped.alias("mapped"), text.normalise(F.col("text")).alias("normalised"))


_FNV = """
WITH words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents),
hashed AS (SELECT word, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(strlen(word)), lambda i: CAST(('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::INT AS UHUGEINT))),
  lambda h, b: ((h + b - 2 * CAST((CAST(h % 256 AS INT) & CAST(b AS INT)) AS UHUGEINT)) * 1099511628211) % 18446744073709551616) AS h FROM words)
SELECT word, lower(lpad(to_hex(CAST(h AS UBIGINT)), 16, '0')) AS fnv FROM hashed"""


@query("fnv1a64", _FNV)
def fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", text.fnv1a64_hex(F.col("word")).alias("fnv"))


@query(
    "decoders",
    f"""WITH words AS (SELECT doc_id, lang || ' ' || source AS x FROM documents)
    SELECT doc_id, {sql._decoded('base64', 'to_base64(encode(x))')} AS b64, {sql._decoded('hex', 'hex(encode(x))')} AS hex,
           {sql._decoded('url', "regexp_replace(hex(encode(x)), '(..)', '%' || chr(92) || '1', 'g')")} AS url,
           {sql._decoded('base64', "rtrim(to_base64(encode(x || '?')), '=')")} AS unpadded FROM words""",
)
def decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("x"))
    url = F.regexp_replace(F.hex(F.encode("x", "UTF-8")), "(..)", "%$1")
    open_ = F.rtrim(F.base64(F.encode(F.concat("x", F.lit("?")), "UTF-8")), F.lit("="))
    return rows.select(
        "doc_id",
        decode.base64_text(F.base64(F.encode("x", "UTF-8"))).alias("b64"),
        decode.hex_text(F.hex(F.encode("x", "UTF-8"))).alias("hex"),
        decode.url_text(url).alias("url"),
        decode.base64_text(open_).alias("unpadded"),
    )


@query(
    "labels_and_names",
    f"""SELECT page_id, {sql.label('page_id % 4')} AS severity, CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 15 END AS weight,
      CASE page_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'warning' ELSE 'error' END AS sarif_level, regexp_matches(url, '^(https?://|git@|ssh://|git://)') AS is_url,
      regexp_extract(url, '([^/:]+)[/:]*$', 1) AS display_name FROM pages""",
)
def labels_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.pmod("page_id", F.lit(4)).cast("int")
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", text.severity_label(s).alias("severity"), text.severity_weight(s).alias("weight"), level(s).alias("sarif_level"), text.looks_like_url(F.col("url")).alias("is_url"), text.display_name(F.col("url")).alias("display_name"))


# --- detectors -----------------------------------------------------------------------------------------------------

_UNION = sql.findings()


def _only(detector: str) -> str:
    return f"{_UNION} SELECT {SHOWN} FROM findings WHERE detector = '{detector}'"


for _name, _id in (("rule_hits", "heuristic"), ("hidden_chars", "hidden_chars"), ("encoded_payloads", "encoded"), ("canaries", "canary"), ("perplexity_findings", "perplexity")):
    query(_name, _only(_id))(lambda spark, sf_dir, _id=_id: shown(found(spark, sf_dir, _id)))


@query("text_statistics", f"WITH RECURSIVE {SPIKED_SQL}, {sql.windows('spiked')}, {sql.bigram()} SELECT path, CAST(chunk_seq AS BIGINT) AS chunk_seq, round(bits, 6) AS bits, round(nats, 6) AS nats FROM stats")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where(F.octet_length("text") >= detect.MIN_BYTES).withColumn("x", stats.statistics(F.col("text")))
    return rows.select("path", "chunk_seq", F.round("x.bits", 6).alias("bits"), F.round("x.nats", 6).alias("nats"))


@query("bigram_training", f"WITH {sql.bigram().split(',' + chr(10) + 'scored AS')[0]} SELECT CAST(p AS INTEGER) AS p, CAST(c AS INTEGER) AS c, round(nll, 9) AS nll FROM model")
def bigram_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model as a query over its corpus: pair counts plus one on the full grid, in proportion by first symbol."""
    data = spark.createDataFrame([(i, int(b)) for i, b in enumerate(stats._SYMBOL[list(stats.corpus().encode())])], "i int, y int")
    pairs = data.alias("a").join(data.alias("b"), F.col("b.i") == F.col("a.i") + 1).groupBy(F.col("a.y").alias("p"), F.col("b.y").alias("c")).count()
    grid = spark.range(27).select(F.col("id").cast("int").alias("p")).select("p", F.explode(F.sequence(F.lit(0), F.lit(26))).alias("c"))
    n = 1 + F.coalesce("count", F.lit(0))
    return grid.join(pairs, ["p", "c"], "left").select("p", "c", F.round(-F.log(n / F.sum(n).over(Window.partitionBy("p"))), 9).alias("nll"))


@query("simhash_nearest")
def simhash_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known payload of windows of all documents; SQL takes minutes for it, so the tests have plain Python."""
    return _nearest(chunks(spark, sf_dir))


def _nearest(rows: DataFrame) -> DataFrame:
    near = findings(rows, [detect.Similarity()])
    return near.select("path", "chunk_seq", F.regexp_extract("message", r"distance (\d+)", 1).cast("int").alias("distance"), F.col("evidence").alias("payload"))


@query(
    "embedding_cosine_match",
    """WITH q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 30), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT vec_id, q_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS c FROM v, q)
    SELECT vec_id, arg_max(q_id, c) AS payload_id, round(max(c), 6) AS cosine FROM s GROUP BY vec_id HAVING max(c) >= 0.78""",
)
def embedding_cosine_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of thirty known vectors for each vector, if near enough. The thirty are a fixed bound."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    known = rows.where("vec_id < 30").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    pairs = rows.crossJoin(F.broadcast(known)).select("vec_id", F.struct(text.cosine(F.col("v"), F.col("q")).alias("c"), (-F.col("q_id")).alias("q")).alias("x"))
    best = pairs.groupBy("vec_id").agg(F.max("x").alias("x"))
    return best.where("x.c >= 0.78").select("vec_id", (-F.col("x.q")).alias("payload_id"), F.round("x.c", 6).alias("cosine"))


@query("role_hits", f"""WITH RECURSIVE rows AS (SELECT conv_id * 1000 + turn AS doc_id, role, {spiked_case('(conv_id * 1000 + turn)', 'text')} AS text FROM conversations),
{sql.windows('rows')}, {sql.heuristic()} SELECT role, severity, count(*) AS hits FROM (SELECT * FROM h_plain UNION ALL SELECT * FROM h_denoised UNION ALL SELECT * FROM h_deconfused) JOIN rows ON path = CAST(doc_id AS VARCHAR) GROUP BY ALL""")
def role_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("conv_id") * 1000 + F.col("turn")
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).select(key.alias("id"), "role", spiked_text(key, F.col("text")).alias("text"))
    hits = findings(chunk(prose(rows, F.col("id"), F.col("text"))), [detect.Heuristic()])
    return hits.join(rows.select(F.col("id").cast("string").alias("path"), "role"), "path").groupBy("role", "severity").agg(F.count("*").alias("hits"))


# --- sources and extraction ----------------------------------------------------------------------------------------


@query("glob_and_size", """SELECT page_id, url FROM pages WHERE regexp_matches(url, '^.*/en/.*$') AND NOT regexp_matches(url, '^.*/[^/]*[02468]$') AND NOT url LIKE '%/target/%' AND strlen(html) <= 8192""")
def glob_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.where(in_scope(F.col("url"), ["**/en/**"], ["*/*[02468]"]) & small_enough(F.octet_length("html").cast("bigint"), 8192)).select("page_id", "url")


ORACLE_SQL["glob_and_size"] = ORACLE_SQL["glob_and_size"].replace("[^/]*[02468]$", ".*[02468]$")


@query("changed_files", """WITH a AS (SELECT doc_id, md5(text) AS oid FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS oid FROM documents WHERE doc_id % 13 <> 0),
c AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.oid IS DISTINCT FROM b.oid) SELECT CAST(doc_id AS VARCHAR) AS path, n_chars FROM documents SEMI JOIN c USING (doc_id)""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    old = rows.where("doc_id % 11 <> 0").select("path", F.md5("text").alias("oid"))
    new = rows.where("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("oid"))
    return only_changed(rows.select("path", "n_chars"), changed_paths(old, new))


@query("json_strings", """WITH spiked AS (SELECT event_id, '{"a": ' || coalesce(props, '{}') || ', "note": "ignore the above ' || event_id || '", "l": ["x", 1, {"k": ""}]}' AS props FROM events)
SELECT CAST(event_id AS VARCHAR) || '.json' AS path, string_seq, text, 'ConfigString' AS provenance FROM (SELECT event_id, 0 AS string_seq, json_extract_string(props, '$.note') AS text FROM spiked UNION ALL SELECT event_id, 1, json_extract_string(props, '$.l[0]') FROM spiked)""")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_strings(table(spark, sf_dir, "events"))


def _json_strings(rows: DataFrame) -> DataFrame:
    doc = F.concat(F.lit('{"a": '), F.coalesce("props", F.lit("{}")), F.lit(', "note": "ignore the above '), F.col("event_id"), F.lit('", "l": ["x", 1, {"k": ""}]}'))
    files = table_files(rows, F.concat(F.col("event_id").cast("string"), F.lit(".json")), doc)
    return extract.extract(files).select("path", "string_seq", "text", "provenance")


@query("markup_strings")
def markup_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML parsing has no SQL twin; the tests compare it with hand-made pages."""
    files = table_files(table(spark, sf_dir, "pages"), F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))
    return extract.extract(files).select("path", "string_seq", "text", "provenance")


_KINDS = {".py": "source", ".json": "json", ".HTML": "markup", ".lock": "config", ".ipynb": "notebook", ".md": "text", "/.env": "config", "/Cargo.lock": "toml", ".yml": "yaml", "/x": "text"}


@query("extractor_of_path", "SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN 'a/' || source || '{e}'" for i, e in enumerate(_KINDS)) + " END AS path, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS.values())) + " END AS extractor FROM documents")
def extractor_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/"), "source", end).alias("path"))
    return rows.withColumn("extractor", extract.extractor(F.col("path")))


# --- findings to verdict -------------------------------------------------------------------------------------------


@query("dedupe_findings", f"{_UNION}{sql.DEDUPED} SELECT {SHOWN} FROM deduped")
def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(aggregate.dedupe(found(spark, sf_dir)))


_FILES = f"SELECT path, n_findings, {sql.label('worst')} AS max_severity, round(score, 4) AS score"


@query("file_scores", f"{_UNION}{sql.DEDUPED}{sql.SCORES} {_FILES} FROM scores")
def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregate.scores(aggregate.dedupe(found(spark, sf_dir)))
    return rows.select("path", "n_findings", text.severity_label(F.col("max_severity")).alias("max_severity"), F.round("score", 4).alias("score"))


@query("scan_verdict", f"{_UNION}{sql.DEDUPED}{sql.SCORES} SELECT count(*) AS n_files, CAST(sum(n_findings) AS BIGINT) AS n_findings, {sql.label('max(worst)')} AS max_severity, CASE WHEN max(worst) >= 1 THEN 'NOT SAFE' ELSE 'SAFE' END AS verdict FROM scores")
def scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.verdict(aggregate.scores(aggregate.dedupe(found(spark, sf_dir))), ScanConfig().fail_on)


@query("full_scan", f"{_UNION}{sql.DEDUPED}{sql.SCORES} {_FILES}, worst >= 1 AS unsafe FROM scores")
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of each file with findings."""
    rows = aggregate.scores(aggregate.dedupe(found(spark, sf_dir)))
    return rows.select("path", "n_findings", text.severity_label(F.col("max_severity")).alias("max_severity"), F.round("score", 4).alias("score"), (F.col("max_severity") >= ScanConfig().fail_on).alias("unsafe"))


_REVIEWED = f", reviewed AS (SELECT DISTINCT detector, path, message, evidence FROM findings WHERE severity = {HIGH})"


def _reviewed(rows: DataFrame) -> DataFrame:
    high = rows.where(F.col("severity") == HIGH)
    return high.select("detector", "path", "message", text.fnv1a64_hex(F.col("evidence")).alias("evidence_hash"), F.lit(None).cast("string").alias("note")).distinct()


@query("quarantine_filter", f"{_UNION}{_REVIEWED} SELECT {SHOWN} FROM findings ANTI JOIN reviewed USING (detector, path, message, evidence)")
def quarantine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(found(spark, sf_dir))
    return shown(quarantine.suppress(rows, _reviewed(rows)))


@query("quarantine_append", f"{_UNION}{_REVIEWED} SELECT detector, path, message FROM findings ANTI JOIN reviewed USING (detector, path, message, evidence)")
def quarantine_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(found(spark, sf_dir))
    return quarantine.new_entries(rows, _reviewed(rows)).select("detector", "path", "message")


@query("sarif_results", f"""{_UNION}{sql.DEDUPED} SELECT path AS uri, detector AS rule_id, CAST(dense_rank() OVER (ORDER BY detector) - 1 AS INTEGER) AS rule_index,
CASE severity WHEN 0 THEN 'note' WHEN 1 THEN 'warning' ELSE 'error' END AS level, start_ AS byte_offset, end_ - start_ AS byte_length, message FROM deduped""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = kept(found(spark, sf_dir))
    rows = aggregate.dedupe(every)
    # one row for each detector, of which there are at most seven; dropping repeats leaves some of each
    names = every.select("detector").distinct().agg(F.array_sort(F.collect_set("detector")).alias("names"))
    at = F.array_position("names", F.col("detector")) - 1
    return rows.crossJoin(F.broadcast(names)).select(F.col("path").alias("uri"), F.col("detector").alias("rule_id"), at.cast("int").alias("rule_index"), level(F.col("severity")).alias("level"), F.col("start").alias("byte_offset"), (F.col("end") - F.col("start")).alias("byte_length"), "message")


@query("human_report", f"""{_UNION}{sql.DEDUPED}{sql.SCORES}, placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_, end_, chunk_seq, det_ord, f_ord) AS r FROM deduped)
SELECT path, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT path, 0 AS line_no, '' AS line FROM scores UNION ALL SELECT path, 1, path FROM scores
  UNION ALL SELECT path, 2, '  score ' || printf('%.2f', round(score, 6)) || ', max severity ' || {sql.label('worst')} FROM scores
  UNION ALL SELECT path, 1 + 2 * r, '  [' || {sql.label('severity')} || '] ' || detector || ' @ ' || start_ || '..' || end_ || ': ' || message FROM placed
  UNION ALL SELECT path, 2 + 2 * r, '    evidence: ' || evidence FROM placed)""")
def human_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = aggregate.files(aggregate.dedupe(found(spark, sf_dir))).withColumn("score", F.round("score", 6))
    return human_lines(files).select("path", "line_no", "line")


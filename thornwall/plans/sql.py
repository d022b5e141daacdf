"""SQL twins of the operators, built from the same tables of fixed values."""

from __future__ import annotations

import re

from ..functions import stats
from ..functions.safe import BROKEN
from ..functions.text import CONFUSABLES, CYRILLIC, GREEK
from ..operators import detect
from ..operators.aggregate import CAP
from ..rules import PACK
from ..schema import SEVERITIES, WEIGHTS, parse_severity
from .spike import SPIKED_SQL, TOKEN, sql_string

MARK = r"[\x{0300}-\x{036F}]"


def located(text: str, pattern: str) -> str:
    """Matches as a list of {s, e, m} in bytes; `pattern` is an SQL expression."""
    found, parts = f"regexp_extract_all({text}, {pattern})", f"regexp_split_to_array({text}, {pattern})"
    start = f"coalesce(list_sum(list_transform({parts}[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: strlen(x))), 0)"
    return f"list_transform(generate_series(1, len({found})), lambda i: {{'s': CAST({start} AS BIGINT), 'e': CAST({start} + strlen({found}[i]) AS BIGINT), 'm': {found}[i]}})"


def evidence(text: str, most: int) -> str:
    out = f"replace(replace(replace(left({text}, {most}), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    for c in (*range(1, 9), 11, 12, *range(14, 32), *range(127, 160)):
        out = f"replace({out}, chr({c}), '\\u{{{c:04x}}}')"
    return f"({out} || CASE WHEN length({text}) > {most} THEN '…' ELSE '' END)"


def windows(source: str) -> str:
    """CTE win(doc_id, w, s, e): windows of the texts of `source`(doc_id, text)."""

    def inside(p: str) -> str:
        return f"hex(array_slice(b, {p} + 1, {p} + 1)) BETWEEN '80' AND 'BF'"

    def floor(p: str) -> str:
        return f"CASE WHEN {p} >= n OR NOT {inside(p)} THEN {p} WHEN NOT {inside(p + ' - 1')} THEN {p} - 1 WHEN NOT {inside(p + ' - 2')} THEN {p} - 2 ELSE {p} - 3 END"

    def ceil(p: str) -> str:
        return f"CASE WHEN NOT {inside(p)} THEN {p} WHEN NOT {inside(p + ' + 1')} THEN {p} + 1 WHEN NOT {inside(p + ' + 2')} THEN {p} + 2 ELSE {p} + 3 END"

    return f"""
sized AS (SELECT doc_id, encode(text) AS b, CAST(strlen(text) AS BIGINT) AS n FROM {source}),
win AS (
  SELECT doc_id, b, n, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS s, CAST({floor('least(2048, n)')} AS BIGINT) AS e FROM sized WHERE n > 0
  UNION ALL
  SELECT doc_id, b, n, w + 1, s2, CAST({floor('least(s2 + 2048, n)')} AS BIGINT)
  FROM (SELECT doc_id, b, n, w, CAST({ceil('(e - 256)')} AS BIGINT) AS s2 FROM win WHERE e < n)
),
chunks AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id, w AS chunk_seq, s, e, decode(array_slice(b, s + 1, e)) AS t FROM win)"""


def _rules() -> str:
    rows = []
    for i, (name, (severity, confidence, message, exact, strings)) in enumerate(PACK.items()):
        for j, text in enumerate(strings):
            pattern = ("" if exact else "(?i)") + re.sub(r"([][\\.^$*+?(){}|])", r"\\\1", text)
            rows.append(f"({i}, {j}, {sql_string(name)}, {parse_severity(severity)}, {confidence}, {sql_string(message)}, {sql_string(pattern)})")
    return "rules(rule_ord, pat_ord, rule, sev, conf, msg, pattern) AS (VALUES " + ", ".join(rows) + ")"


def _scan(alias: str, text: str, where: str, suffix: str, precise: bool, pass_no: int) -> str:
    place = ("s + (m).s", "s + (m).e") if precise else ("s", "e")
    return f"""
{alias} AS (
  SELECT path, chunk_seq, 0 AS det_ord, 'heuristic' AS detector, sev AS severity, conf::DOUBLE AS confidence, {place[0]} AS start_, {place[1]} AS end_,
         msg || ' (' || rule || '){suffix}' AS message, {evidence('(m).m', 120)} AS evidence, {pass_no} * 1000000 + rule_ord * 10000 + pat_ord * 1000 + k AS f_ord
  FROM (
    SELECT path, chunk_seq, s, e, rule, sev, conf, msg, rule_ord, pat_ord, unnest(l) AS m, generate_subscripts(l, 1) AS k
    FROM (SELECT path, chunk_seq, s, e, rule, sev, conf, msg, rule_ord, pat_ord, {located('tt', 'pattern')} AS l
          FROM (SELECT path, chunk_seq, s, e, {text} AS tt FROM chunks WHERE {where}) JOIN rules ON regexp_matches(tt, pattern))
  )
)"""


def _translate(text: str) -> str:
    return f"translate({text}, {sql_string(''.join(CONFUSABLES))}, {sql_string(''.join(CONFUSABLES.values()))})"


def heuristic() -> str:
    return ",\n".join(
        [
            _rules(),
            _scan("h_plain", "t", "true", "", True, 0),
            _scan("h_denoised", f"regexp_replace(t, '{MARK}', '', 'g')", f"regexp_matches(t, '{MARK}')", " (denoised)", False, 1),
            _scan("h_deconfused", _translate("t"), f"{_translate('t')} <> t", " (deconfused)", False, 2),
        ]
    )


KIND = " ".join(f"WHEN regexp_matches(c, '^[{cls}]$') THEN '{name}'" for cls, name in (
    (detect.ZERO_WIDTH, "zero-width"), (detect.BIDI, "bidi-override"), (detect.TAGS, "tag-character"), (detect.SELECTORS, "variation-selector"), (detect.MORE_SELECTORS, "variation-selector-supplement")))


def _each(columns: str, made: str, where: str) -> str:
    """Rows of a list made from each chunk, with its number k."""
    return f"SELECT {columns}, unnest(l) AS m, generate_subscripts(l, 1) AS k FROM (SELECT {columns}, {made} AS l FROM chunks WHERE {where})"


def hidden() -> str:
    runs = f"regexp_extract_all(t, '{MARK}+')"
    word = r"[\pL\x{200C}\x{200D}]+"
    like = f"[{CYRILLIC}{GREEK}]"
    base = "path, chunk_seq, s, e"
    return f"""
marks AS (
  SELECT {base}, list_max(list_transform({runs}, lambda x: length(x))) AS stack, length(t) - length(regexp_replace(t, '{MARK}', '', 'g')) AS total,
         length(t) - length(regexp_replace(t, '[\\x{{0336}}\\x{{0332}}]', '', 'g')) AS overlay
  FROM chunks WHERE regexp_matches(t, '{MARK}')
),
x_zalgo AS (
  SELECT path, chunk_seq, 1 AS det_ord, 'hidden_chars' AS detector, 2 AS severity, 0.9::DOUBLE AS confidence, s AS start_, e AS end_,
         'stacked combining marks (zalgo-style obfuscation, max stack ' || stack || ', ' || total || ' marks total)' AS message,
         'max_stack=' || stack || ', total_marks=' || total AS evidence, 0 AS f_ord FROM marks WHERE stack >= 2
),
x_overlay AS (
  SELECT path, chunk_seq, 1, 'hidden_chars', 1, 0.85::DOUBLE, s, e, 'combining overlay marks (strikethrough/underline obfuscation, ' || overlay || ' overlay marks)',
         'overlay_marks=' || overlay, 1 FROM marks WHERE overlay >= 5
),
x_invisible AS (
  SELECT path, chunk_seq, 1, 'hidden_chars', CASE WHEN kind = 'zero-width' THEN 1 ELSE 3 END, 0.95::DOUBLE, s + (m).s, s + (m).e,
         'hidden ' || kind || ' ' || code, code, 1000 + k
  FROM (SELECT *, CASE {KIND.replace('(c,', '((m).m,')} END AS kind, 'U+' || format('{{:04X}}', unicode((m).m)) AS code
        FROM ({_each(base, located('t', sql_string(detect.INVISIBLE)), f"regexp_matches(t, '{detect.INVISIBLE}')")}))
  WHERE NOT (unicode((m).m) = 65279 AND s + (m).s = 0)
),
x_homoglyph AS (
  SELECT path, chunk_seq, 1, 'hidden_chars', 2, 0.85::DOUBLE, s + (m).s, s + (m).e,
         'homoglyph cluster: Latin word with ' || CASE WHEN regexp_matches(regexp_extract_all((m).m, '{like}')[-1], '[{CYRILLIC}]') THEN 'cyrillic' ELSE 'greek' END || ' look-alike character',
         {evidence('(m).m', 60)}, 100000 + k
  FROM ({_each(base, located('t', sql_string(word)), f"regexp_matches(t, '{like}')")})
  WHERE regexp_matches((m).m, '{like}') AND length(regexp_replace((m).m, '[^A-Za-z]', '', 'g')) >= 2
)"""


def _decoded(kind: str, run: str) -> str:
    """A decoded run, null unless it is well formed."""
    if kind == "hex":
        return f"try(decode(unhex(left({run}, length({run}) - length({run}) % 2))))"
    if kind == "url":
        return f"try(decode(unhex(replace({run}, '%', ''))))"
    canonical = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?$"
    other = f"translate(rtrim({run}, '='), '-_', '+/')"
    return f"CASE WHEN regexp_matches({run}, '{canonical}') THEN try(decode(from_base64({run}))) WHEN regexp_matches({other}, '{canonical}') THEN try(decode(from_base64({other}))) END"


def _needle(text: str) -> str:
    pattern = "(?i)" + "|".join(re.sub(r"([][\\.^$*+?(){}|])", r"\\\1", n) for n in sorted(detect.NEEDLES, key=len, reverse=True))
    cases = " ".join(f"WHEN {sql_string(k.lower())} THEN {sql_string(v)}" for k, v in detect.NEEDLES.items())
    return f"CASE lower(regexp_extract({text}, {sql_string(pattern)})) {cases} END"


def encoded() -> str:
    kinds = (("base64", detect.BASE64_RUN), ("hex", detect.HEX_RUN), ("url", detect.URL_RUN))
    base = "path, chunk_seq, s, e"
    first = " UNION ALL ".join(f"SELECT *, '{kind}' AS kind, {n} AS kind_ord, {_decoded(kind, '(m).m')} AS d FROM ({_each(base, located('t', sql_string(run)), f'regexp_matches(t, {sql_string(run)})')})" for n, (kind, run) in enumerate(kinds))

    def deeper(source: str) -> str:
        return " UNION ALL ".join(
            f"SELECT path, chunk_seq, kind, k, o * 100000 + {n} * 10000 + i AS o, {_decoded(kind, 'r')} AS d FROM (SELECT path, chunk_seq, kind, k, o, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(d, {sql_string(run)}) AS l FROM {source}))"
            for n, (kind, run) in enumerate(kinds[:2])
        )

    return f"""
enc0 AS (SELECT path, chunk_seq, s, e, kind, kind_ord, k, m, d, 0 AS o FROM ({first}) WHERE d IS NOT NULL AND length((m).m) >= 24),
enc1 AS (SELECT * FROM ({deeper('enc0')}) WHERE d IS NOT NULL),
enc2 AS (SELECT * FROM ({deeper('enc1')}) WHERE d IS NOT NULL),
enc_what AS (
  SELECT path, chunk_seq, kind, k, arg_min(what, o) AS what FROM (
    SELECT path, chunk_seq, kind, k, CAST(-1 AS HUGEINT) AS o, {_needle('d')} AS what FROM enc0
    UNION ALL SELECT path, chunk_seq, kind, k, CAST(o AS HUGEINT) * 100000, {_needle('d')} FROM enc1
    UNION ALL SELECT path, chunk_seq, kind, k, CAST(o AS HUGEINT), {_needle('d')} FROM enc2
  ) WHERE what IS NOT NULL GROUP BY ALL
),
x_encoded AS (
  SELECT path, chunk_seq, 2, 'encoded', 3, 0.9::DOUBLE, s + (m).s, s + (m).e, kind || '-encoded injection payload: ' || what, {evidence('d', 120)}, kind_ord * 1000 + k
  FROM enc0 JOIN enc_what USING (path, chunk_seq, kind, k)
)"""


def canary() -> str:
    base, parts = "path, chunk_seq, s, e", []
    for i, (pattern, confidence, message) in enumerate(((detect.CANARY, 0.9, "'Rebuff-style canary token committed to repo'"), (re.escape(TOKEN).replace("\\-", "-"), 0.95, "'user-defined canary token leaked: ' || (m).m"))):
        rows = _each(base, located("t", sql_string(pattern)), f"regexp_matches(t, {sql_string(pattern)})")
        parts.append(f"SELECT path, chunk_seq, 3, 'canary', 2, {confidence}::DOUBLE, s + (m).s, s + (m).e, {message}, {evidence('(m).m', 120)}, {i} * 1000 + k FROM ({rows})")
    return f"x_canary AS ({' UNION ALL '.join(parts)})"


def _symbol(byte_hex: str) -> str:
    return f"CASE WHEN {byte_hex} BETWEEN '61' AND '7A' THEN ('0x' || {byte_hex})::INT - 97 WHEN {byte_hex} BETWEEN '41' AND '5A' THEN ('0x' || {byte_hex})::INT - 65 ELSE 26 END"


def bigram() -> str:
    """CTEs model(p, c, nll) and stats(path, chunk_seq, bits, nats) of chunks with `ok`."""
    return f"""
prose AS (SELECT hex(encode({sql_string(stats.corpus())})) AS h),
corpus_bytes AS (SELECT i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT h, unnest(range(length(h) // 2)) AS i FROM prose)),
corpus_symbols AS (SELECT i, {_symbol('x')} AS y FROM corpus_bytes),
pairs AS (SELECT a.y AS p, b.y AS c, count(*) AS n FROM corpus_symbols a JOIN corpus_symbols b ON b.i = a.i + 1 GROUP BY ALL),
grid AS (SELECT p, c, 1 + coalesce(n, 0) AS n FROM (SELECT a.i AS p, b.i AS c FROM range(27) a(i), range(27) b(i)) LEFT JOIN pairs USING (p, c)),
model AS (SELECT p, c, -ln(n / sum(n) OVER (PARTITION BY p)) AS nll FROM grid),
scored AS (SELECT path, chunk_seq, hex(encode(t)) AS h, t FROM chunks WHERE strlen(t) >= 256),
text_pairs AS (
  SELECT path, chunk_seq, {_symbol('substr(h, 2 * i + 1, 2)')} AS p, {_symbol('substr(h, 2 * i + 3, 2)')} AS c
  FROM (SELECT path, chunk_seq, h, unnest(range(length(h) // 2 - 1)) AS i FROM scored)
),
nats AS (SELECT path, chunk_seq, sum(nll * n) / sum(n) AS nats FROM (SELECT path, chunk_seq, p, c, count(*) AS n FROM text_pairs GROUP BY ALL) JOIN model USING (p, c) GROUP BY ALL),
chars AS (SELECT path, chunk_seq, x, count(*) AS n FROM (SELECT path, chunk_seq, unnest(string_split(t, '')) AS x FROM scored) GROUP BY ALL),
bits AS (SELECT path, chunk_seq, -sum(n / total * log2(n / total)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY path, chunk_seq) AS total FROM chars) GROUP BY ALL),
stats AS (SELECT path, chunk_seq, bits, nats FROM nats JOIN bits USING (path, chunk_seq))"""


def perplexity() -> str:
    return f"""{bigram()},
x_perplexity AS (
  SELECT path, chunk_seq, 4, 'perplexity', CASE WHEN nats >= 5.6 THEN 2 ELSE 1 END, least(greatest((nats - 5.0) / 0.6, 0.3::DOUBLE), 0.9::DOUBLE), s, e,
         'anomalous bigram cross-entropy ' || printf('%.2f', nats) || ' nats/symbol — likely encoded or obfuscated content', {evidence('t', 80)}, 0
  FROM stats JOIN chunks USING (path, chunk_seq) WHERE bits >= 4.5 AND nats >= 5.0
)"""


FINDINGS = ("h_plain", "h_denoised", "h_deconfused", "x_zalgo", "x_overlay", "x_invisible", "x_homoglyph", "x_encoded", "x_canary", "x_perplexity")


def findings() -> str:
    """All CTEs up to findings(path, chunk_seq, det_ord, detector, severity, confidence, start_, end_, message, evidence, f_ord)."""
    parts = [SPIKED_SQL, windows("spiked"), heuristic(), hidden(), encoded(), canary(), perplexity()]
    return "WITH RECURSIVE " + ",\n".join(parts) + ",\nfindings AS (" + " UNION ALL ".join(f"SELECT * FROM {x}" for x in FINDINGS) + ")"


DEDUPED = """,
ranked AS (
  SELECT *, lag({'d': detector, 's': start_, 'e': end_}) OVER (PARTITION BY path ORDER BY start_, end_, chunk_seq, det_ord, f_ord) AS before FROM findings
),
deduped AS (SELECT * EXCLUDE (before) FROM ranked WHERE before IS DISTINCT FROM {'d': detector, 's': start_, 'e': end_})"""

WEIGHT = "CASE severity " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"


def label(severity: str) -> str:
    return f"CASE {severity} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEVERITIES)) + " END"


SCORES = f""",
by_detector AS (SELECT path, detector, sum({WEIGHT} * CAST(confidence AS DOUBLE)) AS s, max(severity) AS worst, count(*) AS n FROM deduped GROUP BY ALL),
scores AS (SELECT path, CAST(sum(n) AS BIGINT) AS n_findings, max(worst) AS worst, sum(least(s, {CAP})) AS score FROM by_detector GROUP BY path)"""


def broken(text: str) -> str:
    for old, new in BROKEN:
        text = f"replace({text}, {sql_string(old)}, {sql_string(new)})"
    return text

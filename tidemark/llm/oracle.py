"""The queries of the subpackage that SQL can state, in DuckDB's dialect."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
WORDS = f"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents"

SUBSTRINGS = f"""
WITH w AS ({WORDS}),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
again AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM windows)
  WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

# Bytes are pairs of hexadecimal digits.
SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS k
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM strings)
  WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM again),
runs AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before < p - 1) AS spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone)
  GROUP BY doc_id),
touched AS (
  SELECT d.doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d SEMI JOIN gone g ON d.doc_id = g.doc_id),
kept AS (
  SELECT t.doc_id, string_agg(substr(h, CAST(2 * t.p + 1 AS BIGINT), 2), '' ORDER BY t.p) AS h
  FROM touched t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(r.n, 0) AS n_removed, coalesce(r.spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN r.n IS NULL THEN d.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM d LEFT JOIN runs r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM each a JOIN each b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, any_value(len(s)) AS n_shingles, min(other) AS component_id,
  s.doc_id = min(other) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""


def _rate(name: str, value: str, slack: float, both: bool) -> tuple[str, str]:
    """(rates as rows of a sketch, the test of a row against its fences)."""
    rows = f"SELECT lang, source, '{name}' AS rate, {value} AS value FROM base WHERE NOT base_failed"
    span = f"(4.0 * (q3 - q1) + {slack})"
    low = f"AND f.value >= q1 - {span}" if both else ""
    return rows, f"WHEN f.rate = '{name}' THEN f.value <= q3 + {span} {low}"


_RATES = [
    ("word_length", "word_chars / greatest(n_words, 1)", 2.0, True),
    ("symbols", "n_symbols / greatest(n_words, 1)", 0.1, False),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.2, False),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 0.15, False),
]
_SKETCH = " UNION ALL ".join(_rate(*r)[0] for r in _RATES)
_TESTS = " ".join(_rate(*r)[1] for r in _RATES)
_VALUES = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{n}' AS rate, {v} AS value FROM base" for n, v, _, _ in _RATES)


def _quartiles(keys: str) -> str:
    """Quartiles of the sketches merged by ``keys``: bins are powers of 1.02."""
    by = f"{keys}, rate" if keys else "rate"
    middle = "CASE WHEN bin IS NULL THEN 0.0 ELSE pow(1.02, bin - 0.5) END"
    return f"""
    SELECT {by}, max(al) AS docs, min({middle}) FILTER (upto >= 0.25 * al) AS q1,
      min({middle}) FILTER (upto >= 0.75 * al) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin NULLS FIRST) AS upto,
        sum(n) OVER (PARTITION BY {by}) AS al
      FROM (SELECT {by}, bin, count(*) AS n FROM sketch GROUP BY {by}, bin))
    GROUP BY {by}"""


QUALITY = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    [x FOR x IN str_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{WORD}')] AS ls FROM documents),
fives AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM fives WHERE n > 1) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, lang, source, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN again a ON w.doc_id = a.doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
sketch AS (
  SELECT lang, source, rate, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / ln(1.02)) AS BIGINT) END AS bin
  FROM ({_SKETCH})),
fences AS (
  SELECT a.lang, a.source, a.rate,
    CASE WHEN a.docs >= 200 THEN a.q1 WHEN b.docs >= 200 THEN b.q1 ELSE c.q1 END AS q1,
    CASE WHEN a.docs >= 200 THEN a.q3 WHEN b.docs >= 200 THEN b.q3 ELSE c.q3 END AS q3
  FROM ({_quartiles("lang, source")}) a
  JOIN ({_quartiles("lang")}) b ON a.rate = b.rate AND a.lang IS NOT DISTINCT FROM b.lang
  JOIN ({_quartiles("")}) c ON a.rate = c.rate),
inside AS (
  SELECT doc_id, bool_and(CASE {_TESTS} END) AS ok
  FROM ({_VALUES}) f JOIN fences q
    ON f.rate = q.rate AND f.lang IS NOT DISTINCT FROM q.lang AND f.source IS NOT DISTINCT FROM q.source
  GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND coalesce(ok, false) AS kept
FROM base b LEFT JOIN inside i ON b.doc_id = i.doc_id
"""

# Five hexadecimal digits of a digest are four base-32 symbols.
BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST((CAST(concat('0x', substr(s, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '')"""
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s,
  min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRINGS,
    "op5_minmax_hash": NEAR,
    "op9_quality_rules": QUALITY,
    "op10_suffix_dedup": SUFFIXES,
    "op11_warc": WARC,
}

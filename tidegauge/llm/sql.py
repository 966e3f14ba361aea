"""DuckDB SQL for the queries that SQL can express."""

from tidegauge.llm.quality_rules import BOILERPLATE

ORACLES: dict[str, str] = {}

_PHRASES = ", ".join(f"'{p}'" for p in BOILERPLATE)

ORACLES["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, sum(c) AS n FROM (
  SELECT r, least(3, i - lag(i, 1, i - 3) OVER (PARTITION BY r ORDER BY i)) AS c FROM again) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[|»›•·]')) AS bars,
  len(regexp_extract_all(line, '[!?]')) AS shouts, regexp_matches(line, '[.!?…:;。！？।॥؟۔։።]') AS marked,
  len(list_filter([{_PHRASES}], lambda p: contains(lower(line), p))) > 0 AS furniture FROM l),
j AS (SELECT r, sum(symbols) AS n_symbols, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup,
  coalesce(sum(n) FILTER ((bars >= 2 AND bars * 4 >= n) OR symbols > n * 0.5 OR shouts > n * 0.5
    OR (n > 12 AND NOT marked) OR furniture), 0) AS lost FROM m GROUP BY r),
a AS (SELECT d.doc_id, len(w.ws) AS n_words, length(array_to_string(w.ws, '')) AS word_chars, j.n_symbols,
  j.n_dup, coalesce(repeats.n, 0) AS n_repeat, j.lost
  FROM d JOIN w USING (r) JOIN j USING (r) LEFT JOIN repeats USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines,
  CAST(n_repeat AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat > 50 * n_words) AND lost <= 0.5 * n_words AS kept,
  CAST(lost AS BIGINT) AS lost_words
FROM a"""


ORACLES["op6_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)"""

ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS lowest FROM p GROUP BY s)
SELECT p.page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (('0x' || substr(s, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)),
    lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = lowest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lowest THEN lowest END AS refers_to
FROM p JOIN f USING (s)"""


def _levels(name: str, leaves: str, by: str, n: int) -> str:
    """``n`` levels of runs of eight over ``leaves`` (``by``, ``i``, ``h``), and ``{name}_top``."""
    parts, last = [], leaves
    for k in range(1, n + 1):
        parts.append(f"""{name}_r{k} AS (SELECT {by} AS g, i // 8 AS j, list(h ORDER BY i) AS run FROM
  (SELECT *, count(*) OVER (PARTITION BY {by}) AS c FROM {last}) WHERE c > 1 GROUP BY 1, 2),
{name}_l{k} AS (SELECT g AS {by}, j AS i, sha256(array_to_string(run, '')) AS h FROM {name}_r{k}
  UNION ALL SELECT {by}, i, h FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS c FROM {last}) WHERE c = 1)""")
        last = f"{name}_l{k}"
    return ",\n".join(parts)


def _walk(name: str, start: str, n: int, out: str) -> str:
    """From rows with ``g``, ``i``, ``proof``, ``cur`` up ``n`` levels: siblings appended, ``cur`` folded."""
    parts, last = [], start
    for k in range(1, n + 1):
        step = f"{out}{k}"
        left, right = "array_to_string(run[1:(i % 8)::INT], '')", "array_to_string(run[(i % 8 + 2)::INT:], '')"
        parts.append(f"""{step} AS (SELECT s.* REPLACE (CASE WHEN run IS NULL THEN i ELSE i // 8 END AS i,
  CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof,
  CASE WHEN run IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur)
  FROM {last} s LEFT JOIN {name}_r{k} r ON r.g = s.g AND r.j = s.i // 8)""")
        last = step
    return ",\n".join(parts)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::UBIGINT),
  lambda a, b: list_reduce(range(8)::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(a, b)),
  4294967295::UBIGINT))"""
_LANG_LEVELS, _TOP_LEVELS = 8, 4

ORACLES["op11_merkle_manifest"] = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_HEAD} || {_field("text")}) AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})
  END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d),
{_levels("t", "leaves", "g", _LANG_LEVELS)},
subs AS (SELECT 0 AS w, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i FROM t_l{_LANG_LEVELS}),
{_levels("w", "subs", "w", _TOP_LEVELS)},
u0 AS (SELECT doc_id, leaf, g, i, '' AS proof, coalesce(other, leaf) AS cur FROM leaves),
{_walk("t", "u0", _LANG_LEVELS, "u")},
v0 AS (SELECT u.doc_id, u.leaf, s.h AS subroot, 0 AS g, s.i, u.proof, u.cur FROM u{_LANG_LEVELS} u JOIN subs s ON s.name = u.g),
{_walk("w", "v0", _TOP_LEVELS, "v")}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified
FROM v{_TOP_LEVELS} CROSS JOIN w_l{_TOP_LEVELS} t"""

ORACLES["op13_minhash"] = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM w, unnest(range(1, greatest(len(ws), 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS t FROM w UNION SELECT reach.r, ends.y FROM reach JOIN ends ON ends.x = reach.t),
least_id AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.t GROUP BY reach.r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w LEFT JOIN n USING (r) JOIN least_id USING (r)"""

ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
  CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER)
  AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5"""

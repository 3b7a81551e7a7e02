"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from tidewatch.llm import collocations
from tidewatch.llm.chat_format import CLOSE, OPEN, TURN, TURN_END
from tidewatch.llm.decontaminate import MIN_SHARE, WIDTH
from tidewatch.llm.quality_rules import RULES, STOP_WORDS, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[\x20\x09-\x0D]+"
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, between: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{between}'), lambda x: x <> '')"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _kept(rule: Rule) -> str:
    tests = []
    if rule.low is not None:
        tests.append(f"1000 * {rule.measure} < {rule.low} * {rule.per}")
    if rule.high is not None:
        tests.append(f"1000 * {rule.measure} > {rule.high} * {rule.per}")
    return f"NOT (n_words >= {rule.least_words} AND ({' OR '.join(tests)}))"


_stop = ", ".join(sorted({f"'{w}'" for word in STOP_WORDS for w in (word, word.capitalize())}))

QUALITY = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')", _BLANKS)} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM base) b),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows) w WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, 5)) AS j) o GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(words, lambda w: w IN ({_stop}))) AS n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[-*•]\\s'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipsis_lines
  FROM base LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_kept(r) for r in RULES)} AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured) m
"""

JACCARD = f"""
WITH RECURSIVE base AS (SELECT doc_id, {_words(_low("text"), _BLANKS)} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM base WHERE len(words) > 0) b),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_words(_low("text"), _MARKS)} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_low("text"), _MARKS)} AS words FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (
    SELECT item, words, least(len(words), {WIDTH}) AS k, unnest(range(1, greatest(len(words) - {WIDTH - 2}, 2))) AS i
    FROM items WHERE len(words) > 0) w),
grams AS (
  SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (
    SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) ks) g),
found AS (SELECT g.doc_id, g.i, g.k, w.item FROM grams g JOIN windows w ON w.gram = g.gram AND w.k = g.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) f GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND {MIN_SHARE} * coalesce(h.n, 0) >= len(words) AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN named i ON i.doc_id = d.doc_id
"""

_escaped = lambda c: f"length(regexp_replace({c}, '([\\\\<\\[{{\\]])', 'xx', 'g'))"

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped("role")} + {_escaped("text")} + {len(TURN) + 1 + len(TURN_END)}) + {len(OPEN) + len(CLOSE)} AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT lang, {_words("piece", "[ \\x09]+")} AS words FROM (
    SELECT coalesce(lang, '{collocations.UNKNOWN_LANGUAGE}') AS lang,
      unnest(regexp_split_to_array({_low("text")}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents) p),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(words) AS x FROM pieces) w GROUP BY lang, x),
f2 AS (
  SELECT lang, x, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' '))) AS x FROM pieces) w
  GROUP BY lang, x),
f3 AS (
  SELECT lang, x, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS x FROM pieces) w
  GROUP BY lang, x HAVING count(*) >= {collocations.LEAST}),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT p.lang, p.x AS phrase, 1 AS k, p.f AS a, l.f AS l, r.f AS r FROM f2 p
  JOIN f1 l ON l.lang = p.lang AND l.x = split_part(p.x, ' ', 1) JOIN f1 r ON r.lang = p.lang AND r.x = split_part(p.x, ' ', 2)
  WHERE p.f >= {collocations.LEAST}
  UNION ALL
  SELECT p.lang, p.x, 1, p.f, l.f, r.f FROM f3 p
  JOIN f1 l ON l.lang = p.lang AND l.x = split_part(p.x, ' ', 1)
  JOIN f2 r ON r.lang = p.lang AND r.x = split_part(p.x, ' ', 2) || ' ' || split_part(p.x, ' ', 3)
  UNION ALL
  SELECT p.lang, p.x, 2, p.f, l.f, r.f FROM f3 p
  JOIN f2 l ON l.lang = p.lang AND l.x = split_part(p.x, ' ', 1) || ' ' || split_part(p.x, ' ', 2)
  JOIN f1 r ON r.lang = p.lang AND r.x = split_part(p.x, ' ', 3)),
scores AS (
  SELECT *, CAST({collocations.SCALE} AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
worst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scores) s WHERE i = 1),
longer AS (
  SELECT lang, x, max(f) AS f FROM (
    SELECT lang, split_part(x, ' ', 1) || ' ' || split_part(x, ' ', 2) AS x, f FROM f3
    UNION ALL SELECT lang, split_part(x, ' ', 2) || ' ' || split_part(x, ' ', 3), f FROM f3) t GROUP BY lang, x),
final AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank,
    w.phrase, w.a, w.l, w.r, CAST(w.score AS BIGINT) AS score
  FROM worst w LEFT JOIN longer g ON g.lang = w.lang AND g.x = w.phrase
  WHERE g.f IS NULL OR 100 * g.f < {collocations.INSIDE_PERCENT} * w.a)
SELECT f.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM final f JOIN n ON n.lang = f.lang WHERE rank <= {collocations.BEST}
"""

ORACLES = {
    "op3_quality_rules": QUALITY,
    "op4_jaccard_join": JACCARD,
    "op6_decontamination": DECONTAMINATION,
    "op10_chat_format": CHAT,
    "op12_collocations": COLLOCATIONS,
}

"""DuckDB SQL of the queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

from lotlight.llm.line_dedup import LineDedupParams
from lotlight.llm.quality_rules import COMMON_WORDS, LANGUAGES, N_COMMON, QualityParams
from lotlight.llm.warc import WarcParams

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

_L = LineDedupParams()
LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM split
), bare AS (
  SELECT *, trim(raw, {_WS}) AS line FROM lines
), spread AS (
  SELECT line FROM bare WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {_L.min_sites}
), full_lines AS (
  SELECT b.doc_id, b.pos, s.line IS NOT NULL AS hit, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS place
  FROM bare b LEFT JOIN spread s ON b.line = s.line WHERE b.line <> ''
), islands AS (
  SELECT doc_id, pos, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM full_lines WHERE hit
), short_runs AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS n FROM islands
), counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit FROM full_lines GROUP BY doc_id
), gone AS (
  SELECT r.doc_id, r.pos FROM short_runs r JOIN counts c ON c.doc_id = r.doc_id WHERE r.n < {_L.mirror_run} AND c.n_hit < c.n_lines
), per_doc AS (
  SELECT b.doc_id, count(g.pos) AS n_gone, string_agg(raw, chr(10) ORDER BY b.pos) FILTER (g.pos IS NULL) AS rest
  FROM bare b LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.pos = b.pos GROUP BY b.doc_id
), clean AS (
  SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(p.n_gone, 0) AS n_gone, CASE WHEN p.n_gone > 0 THEN coalesce(p.rest, '') ELSE coalesce(d.text, '') END AS t
  FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_gone AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS clean_chars, md5(t) AS clean_md5
FROM clean
"""

_R = WarcParams()
WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT *, sha1(t) AS d, max(page_id) OVER (PARTITION BY t) AS last FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= {_R.revisit_bytes} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {_R.revisit_bytes} AND page_id <> last THEN last END AS refers_to
FROM g
"""


def quality_rules(p: QualityParams = QualityParams()) -> str:
    w = p.repeat_window
    words = " UNION ALL ".join(f"SELECT '{lang}' AS known, {k} AS bin, '{word}' AS word" for lang in LANGUAGES for k, word in enumerate(COMMON_WORDS[lang]))
    words += " UNION ALL " + " UNION ALL ".join(f"SELECT '' AS known, {k} AS bin, '{word}' AS word" for k, word in enumerate(COMMON_WORDS[LANGUAGES[0]]))
    known = f"CASE WHEN lang IN ({', '.join(repr(x) for x in LANGUAGES)}) THEN lang ELSE '' END"
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "punctuation": "[!-/:-@\\[-`{-~]", "space": "[\\x09-\\x0D ]"}
    counts = ", ".join(f"CAST(length(regexp_replace(t, '[^' || '{c[1:]}', '', 'g')) AS BIGINT) AS c_{k}" for k, c in classes.items())
    return f"""
WITH d AS (
  SELECT doc_id, {known} AS known, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, known, t, list_filter(regexp_split_to_array(t, '[\\x09-\\x0D ]+'), lambda x: x <> '') AS ws FROM d
), wl AS (
  SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w
), win AS (
  SELECT doc_id, unnest(range(len(ws) - {w - 1})) AS i, ws FROM w WHERE len(ws) > {w}
), win2 AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i + 1 : i + {w}]) AS n FROM win
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM win2, range({w}) r(k) WHERE n >= 2 GROUP BY doc_id
), ls AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM ls WHERE trim(line, {_WS}) <> '' GROUP BY doc_id
), c AS (
  SELECT w.doc_id, w.known, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, {counts},
         CAST(strlen(t) - length(t) AS BIGINT) AS beyond
  FROM w
), cc AS (
  SELECT *, greatest(length(t) - c_lower - c_space - c_upper - c_digit - c_punctuation, beyond) AS c_wide, c_punctuation - c_symbol AS c_punct FROM c
), chars AS (
  SELECT doc_id, known, n_words, unnest(range(7)) AS bin, unnest([c_lower, c_upper, c_digit, c_punct, c_symbol, c_space, c_wide]) AS n FROM cc
), common(known, bin, word) AS ({words}), hits AS (
  SELECT wl.doc_id, c.bin, count(*) AS n FROM wl JOIN d USING (doc_id) JOIN common c ON c.known = d.known AND c.word = wl.word GROUP BY ALL
), freq AS (
  SELECT g.doc_id, g.known, g.n_words, g.bin, CASE WHEN g.bin < {N_COMMON} THEN coalesce(h.n, 0) ELSE g.n_words - coalesce(s.n, 0) END AS n
  FROM (SELECT doc_id, known, n_words, unnest(range({N_COMMON + 1})) AS bin FROM c) g
  LEFT JOIN hits h ON g.doc_id = h.doc_id AND g.bin = h.bin
  LEFT JOIN (SELECT doc_id, sum(n) AS n FROM hits GROUP BY doc_id) s ON g.doc_id = s.doc_id
), ok AS (
  SELECT doc_id FROM chars GROUP BY doc_id, n_words HAVING n_words >= {p.guard_words} AND sum(n) >= {p.guard_chars}
), hist AS (
  SELECT 'c' AS what, doc_id, known, bin, n FROM chars SEMI JOIN ok USING (doc_id) UNION ALL SELECT 'w', doc_id, known, bin, n FROM freq SEMI JOIN ok USING (doc_id)
), p AS (
  SELECT what, doc_id, known, bin, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY what, doc_id) AS p FROM hist
), q AS (
  SELECT what, known, bin, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY what, known) AS q FROM hist GROUP BY what, known, bin
), js AS (
  SELECT what, doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM p JOIN q USING (what, known, bin) GROUP BY what, doc_id
), b AS (
  SELECT c.doc_id, n_words, word_chars, c_symbol AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM c LEFT JOIN dup ON c.doc_id = dup.doc_id LEFT JOIN cover ON c.doc_id = cover.doc_id
), f AS (
  SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed FROM b
)
SELECT f.*, NOT base_failed AND coalesce(j.js, 0) <= {p.max_char_distance}
       AND coalesce(k.js, 0) <= {p.max_word_distance} + {p.noise_share} * sqrt({N_COMMON} / (8 * ln(2)) / greatest(n_words, 1)) AS kept
FROM f LEFT JOIN js j ON f.doc_id = j.doc_id AND j.what = 'c' LEFT JOIN js k ON f.doc_id = k.doc_id AND k.what = 'w'
"""

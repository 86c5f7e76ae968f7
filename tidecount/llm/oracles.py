"""The results of operators that SQL can express, written for another engine from their definitions."""

from __future__ import annotations

from . import mixing

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DOCS = f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents)"


def _windows(width: int, source: str = "d") -> str:
    """Every window of ``width`` words: text, first word, words joined by a space."""
    return f"SELECT r, doc_id, i, array_to_string(w[i : i + {width - 1}], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - {width - 1})) AS i FROM {source} WHERE len(w) >= {width})"


QUALITY = rf"""
WITH {DOCS}, win AS ({_windows(8)}), twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
ln AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY o) AS again, {WORDS.format('line')} AS w
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), mk AS (
  SELECT r, line, again, w, len(w) AS n, regexp_matches(line, '[.!?:;…。！？؟।"”»'')\]][\x20\x09-\x0D]*$') AS ended,
         len(regexp_extract_all(line, '\p{{Lu}}')) AS up, len(regexp_extract_all(line, '\p{{Ll}}')) AS low FROM ln
), jd AS (
  SELECT r, line, n, again > 1
    OR 5 * len([x FOR x IN w IF x IN ('|', '»', '›', '•', '·')]) >= n
    OR len(regexp_extract_all(line, '[#*$%&|<>{{}}~^]')) * 100 > 30 * n OR len(regexp_extract_all(line, '!!|\?\?')) * 100 > 30 * n
    OR n <= 6 AND NOT ended AND regexp_matches(line, '(?i)\b(?:home|menu|login|log in|sign (?:in|up)|register|subscribe|search|next|previous|share|contact|sitemap|read more|click here|back to top|accueil|connexion|startseite|anmelden|inicio|buscar)\b')
    OR n <= 40 AND regexp_matches(line, '(?i)\b(?:cookies?|privacy policy|all rights reserved|terms of (?:use|service)|lorem ipsum|javascript|newsletter|advertisement|powered by)\b')
    OR n >= 25 AND NOT regexp_matches(line, '[.,;:!?…。，、；：！？؟।]')
    OR n >= 10 AND (up * 10 > 7 * (up + low) OR list_max(map_values(list_histogram(w))) * 2 > n OR len([i FOR i IN range(1, n) IF w[i] = w[i + 1]]) * 100 > 30 * n)
    OR n < 3 AND NOT ended AS failed
  FROM mk
), sums AS (
  SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (failed) AS bad, coalesce(sum(n) FILTER (failed), 0)::BIGINT AS lost FROM jd GROUP BY r
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed, coalesce(lines, 0)::BIGINT AS n_lines, coalesce(bad, 0)::BIGINT AS bad, coalesce(lost, 0)::BIGINT AS lost
  FROM d LEFT JOIN rep USING (r) LEFT JOIN sums USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost * 2 <= n_words AS kept, n_lines,
       bad AS n_failed_lines, lost AS n_failed_words
FROM base
"""

REPEATS = rf"""
WITH {DOCS}, win AS ({_windows(50)}), own AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win WHERE doc_id IS NOT NULL),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM own WHERE first < doc_id),
kept AS (
  SELECT a.r, string_agg(a.x, ' ' ORDER BY a.p) AS s, count(*) AS n
  FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) a ANTI JOIN gone g ON g.r = a.r AND g.p = a.p GROUP BY a.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, x AS w, len(x) AS k FROM (SELECT item, unnest([w[i : i + 9] FOR i IN generate_series(1, greatest(1, len(w) - 9))]) AS x FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT DISTINCT p.r, p.i, win.k, win.item
  FROM (SELECT r, k, i, w[i : i + k - 1] AS x FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, size WHERE len(w) >= k)) p JOIN win ON win.k = p.k AND win.w = p.x
),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM occ GROUP BY r),
pos AS (SELECT r, x, list(p) AS ps FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) GROUP BY r, x),
three AS (SELECT DISTINCT item, list_sort(list_distinct(w)) AS v FROM win),
cnt AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM d) GROUP BY x),
tv AS (SELECT row_number() OVER () AS t, item, v FROM three),
tx AS (SELECT t, item, x, row_number() OVER (PARTITION BY t ORDER BY coalesce(c, 0), x) AS k FROM (SELECT t, item, unnest(v) AS x FROM tv) LEFT JOIN cnt USING (x)),
terms AS (SELECT DISTINCT item, v FROM (SELECT t, item, list(x ORDER BY k) AS v FROM tx WHERE k <= 3 GROUP BY t, item)),
near AS (
  SELECT DISTINCT t.item, a.r FROM terms t JOIN pos a ON a.x = t.v[1] LEFT JOIN pos b ON b.r = a.r AND b.x = t.v[2] LEFT JOIN pos c ON c.r = a.r AND c.x = t.v[3]
  WHERE len([p FOR p IN a.ps IF (len(t.v) < 2 OR len([q FOR q IN b.ps IF abs(q - p) < 20]) > 0) AND (len(t.v) < 3 OR len([q FOR q IN c.ps IF abs(q - p) < 20]) > 0)]) > 0
),
nears AS (SELECT r, count(DISTINCT item) AS n FROM near GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated, coalesce(nears.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN nears USING (r)
"""

COMPONENTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
co AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM co JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id FROM d LEFT JOIN sz USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY,
        "op2_substring_dedup": REPEATS,
        "op5_decontamination": CONTAMINATION,
        "op7_source_mixing": mixing.ORACLE,
        "op10_ngram_join": COMPONENTS,
    }

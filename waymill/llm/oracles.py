"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import FROM, LEAST_KEPT, LEAST_WORDS, LINE_DOCS, LINE_SHARE, TO

_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

EXACT = rf"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM k
"""

LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.i, k.line, c.holder IS NOT NULL AND c.holder <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""

#: Measures of every row of documents, and the verdict.
QUALITY = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
v AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
b AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN v USING (doc_id)),
h AS (SELECT doc_id, source, translate(unnest(l), '{FROM[:-6]}' || {_BLANKS}, '{TO}') AS x, len(regexp_extract_all(unnest(l), '[^\x20\x09-\x0D]+')) AS k FROM w),
y AS (SELECT doc_id, source, list_transform(l, lambda x: translate(x, '{FROM[:-6]}' || {_BLANKS}, '{TO}')) AS text FROM w WHERE len(l) > 0),
z AS (SELECT y.source, text, unnest(list_distinct(text)) AS x FROM y GROUP BY y.source, text),
o AS (SELECT source, x, count(*) AS n FROM z GROUP BY source, x HAVING n > {LINE_DOCS}),
s AS (SELECT source, count(DISTINCT text) AS n_docs FROM y GROUP BY source),
c AS (SELECT o.source, x FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source WHERE n > {LINE_SHARE} * n_docs),
m AS (SELECT doc_id, sum(length(h.x)) AS removed, sum(k) AS words FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source AND h.x = c.x GROUP BY doc_id),
a AS (SELECT b.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(removed, 0) AS removed, coalesce(words, 0) AS words FROM b LEFT JOIN m USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words - words < {LEAST_WORDS} OR word_chars - removed < {LEAST_KEPT} * word_chars) AS kept FROM a
"""

#: Words under a 13-word window that a document with a smaller id holds too go.
PHRASES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS s FROM w),
l AS (SELECT s, min(doc_id) AS low FROM s GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM s JOIN l USING (s) WHERE low < doc_id),
a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n_removed FROM a LEFT JOIN g USING (doc_id, i) GROUP BY a.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

#: Distinct 4-word shingles, links of similarity 0.85 or more, and the least id that links lead to.
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i : i + 3], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id) USING (doc_id)
"""

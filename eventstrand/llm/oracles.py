"""The same questions in DuckDB's SQL, where SQL can express them."""

_DOCS = r"""
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM d)
"""

OP1 = rf"""
WITH {_DOCS},
p AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
t AS (SELECT r, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM t WHERE c IS NOT NULL),
k AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
s AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words,
             len(regexp_extract_all(text, '[!?]')) AS n_marks,
             len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals
      FROM w LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * n_marks > n_words
            OR 2 * n_capitals > word_chars) AS kept
FROM b
"""

OP3 = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS g
      FROM d, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c ON a = doc_id LEFT JOIN n USING (doc_id)
"""

OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i)
      WHERE len(ws) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE place > 1),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept
      FROM p ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f
      FROM w, unnest([1, 2, 3, 4, 5]) AS s(m), unnest(range(1, len(ws) - m + 2)) AS t(i) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 100),
i AS (SELECT DISTINCT lang, array_to_string(ws[j : j + k - 1], ' ') AS phrase, a
      FROM c, unnest(range(2, m)) AS s(k), unnest(range(1, m - k + 2)) AS t(j)),
q AS (SELECT * FROM c ANTI JOIN i USING (lang, phrase, a)),
k AS (SELECT q.lang, q.phrase, q.a, x.f AS l, y.f AS r, n.n, k,
             (1000::HUGEINT * q.a * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM q CROSS JOIN unnest([1, 2, 3, 4]) AS s(k) JOIN n ON n.lang = q.lang
      JOIN g x ON x.lang = q.lang AND x.phrase = array_to_string(q.ws[1 : k], ' ')
      JOIN g y ON y.lang = q.lang AND y.phrase = array_to_string(q.ws[k + 1 :], ' ')
      WHERE k < q.m),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM k),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000
"""

SQL = {"op1_quality_rules": OP1, "op3_minhash_near_dedup": OP3, "op6_substring_dedup": OP6, "op12_phrase_collocations": OP12}

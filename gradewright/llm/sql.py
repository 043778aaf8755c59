"""SQL of the training-data queries, where SQL can express them on whole tables."""

from __future__ import annotations

_P1 = r"""
WITH rec AS (
  SELECT 'chunks' AS rec_table, chunk_id AS rec_id, min(content) AS text FROM chunks WHERE content IS NOT NULL GROUP BY chunk_id
  UNION ALL SELECT 'extra_caselets_1mark', caselet_id, min(scenario) FROM extra_caselets_1mark WHERE scenario IS NOT NULL GROUP BY caselet_id
  UNION ALL SELECT 'questions', question_id, min(stem) FROM questions WHERE stem IS NOT NULL GROUP BY question_id
), w AS (
  SELECT rec_table, rec_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM rec
), grams AS (
  SELECT rec_table, rec_id, i - 1 AS pos, array_to_string(words[i:i + 24], ' ') AS gram
  FROM (SELECT rec_table, rec_id, words, unnest(generate_series(1, len(words) - 24)) AS i FROM w WHERE len(words) >= 25)
), shared AS (
  SELECT rec_table, rec_id, pos FROM grams
  WHERE gram IN (SELECT gram FROM grams GROUP BY gram HAVING count(DISTINCT rec_table || ':' || rec_id) > 1)
), marked AS (
  SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY rec_table, rec_id ORDER BY pos) + 25 OR lag(pos) OVER (PARTITION BY rec_table, rec_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS new FROM shared
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY rec_table, rec_id ORDER BY pos) AS no FROM marked
), stretches AS (
  SELECT rec_table, rec_id, min(pos)::BIGINT AS first_word, (max(pos) + 24)::BIGINT AS last_word FROM numbered GROUP BY rec_table, rec_id, no
)
"""

_P4 = r"""
WITH RECURSIVE rec AS (
  SELECT 'questions' AS rec_table, question_id AS id, min(stem) AS text FROM questions WHERE stem IS NOT NULL GROUP BY question_id
  UNION ALL SELECT 'extra_caselets_1mark', caselet_id, min(scenario) FROM extra_caselets_1mark WHERE scenario IS NOT NULL GROUP BY caselet_id
), w AS (SELECT rec_table, id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM rec),
sh AS (
  SELECT DISTINCT rec_table, id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
  FROM (SELECT rec_table, id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)
), n AS (SELECT rec_table, id, count(*) AS n FROM sh GROUP BY rec_table, id),
common AS (
  SELECT a.rec_table, a.id AS id_a, b.id AS id_b, count(*) AS c
  FROM sh a JOIN sh b ON a.rec_table = b.rec_table AND a.s = b.s AND a.id < b.id GROUP BY a.rec_table, a.id, b.id
), pairs AS (
  SELECT c.rec_table, c.id_a, c.id_b, x.n AS na, y.n AS nb FROM common c
  JOIN n x ON x.rec_table = c.rec_table AND x.id = c.id_a JOIN n y ON y.rec_table = c.rec_table AND y.id = c.id_b
  WHERE c.c * 5 >= (x.n + y.n - c.c) * 3
)
"""

_P5 = r"""
WITH RECURSIVE latest AS (
  SELECT concept_id, course_id, title, keywords, source_pages FROM (
    SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts WHERE concept_id IS NOT NULL
  ) WHERE rn = 1
), form AS (
  SELECT concept_id AS id, course_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t,
    list_distinct(list_filter(list_transform(keywords, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS k,
    list_distinct(list_filter(source_pages, lambda x: x IS NOT NULL)) AS p
  FROM latest
), pages AS (SELECT DISTINCT course_id, id, unnest(p) AS page FROM form),
cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM pages a JOIN pages b ON a.course_id = b.course_id AND a.page = b.page AND a.id <> b.id),
links AS (
  SELECT a.id AS x, b.id AS y FROM form a JOIN form b ON a.course_id = b.course_id AND a.t = b.t AND a.id <> b.id
  UNION
  SELECT c.x, c.y FROM cand c JOIN form a ON a.id = c.x JOIN form b ON b.id = c.y WHERE len(list_intersect(a.k, b.k)) >= 2
), reach AS (
  SELECT x AS id, x AS r FROM links
  UNION
  SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.r
)
"""

SQL = {
    "p1_found": _P1 + "SELECT * FROM stretches",
    "p1_share": _P1 + """
SELECT w.rec_table, w.rec_id, len(w.words)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS shared_words,
  coalesce(s.n, 0)::DOUBLE / nullif(len(w.words), 0) AS share
FROM w LEFT JOIN (SELECT rec_table, rec_id, sum(last_word - first_word + 1) AS n FROM stretches GROUP BY rec_table, rec_id) s USING (rec_table, rec_id)""",
    "p3_found": r"""
SELECT DISTINCT chunk_id FROM chunks
WHERE len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) > 1400""",
    "p4_found": _P4 + "SELECT rec_table, id_a, id_b FROM pairs",
    "p4_groups": _P4 + """, hs AS (SELECT rec_table, id, string_agg(s, '|' ORDER BY s) AS h FROM sh GROUP BY 1, 2),
l AS (SELECT rec_table, id_a AS x, id_b AS y FROM pairs UNION ALL SELECT rec_table, id_b, id_a FROM pairs),
r AS (SELECT rec_table, id, id AS o FROM hs UNION SELECT r.rec_table, r.id, l.y FROM r JOIN l ON l.rec_table = r.rec_table AND l.x = r.o),
nn AS (SELECT l.rec_table, l.x AS id, count(DISTINCT b.h) AS links FROM l JOIN hs a ON a.rec_table = l.rec_table AND a.id = l.x JOIN hs b ON b.rec_table = l.rec_table AND b.id = l.y WHERE a.h <> b.h GROUP BY 1, 2)
SELECT r.rec_table, r.id AS rec_id, min(o) AS group_id, coalesce(any_value(links), 0)::BIGINT AS links FROM r LEFT JOIN nn ON nn.rec_table = r.rec_table AND nn.id = r.id GROUP BY r.rec_table, r.id""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p5_found": _P5 + "SELECT id AS concept_id, min(r) AS group_id FROM reach GROUP BY id",
}

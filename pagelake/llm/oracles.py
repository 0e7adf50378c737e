"""SQL over the same tables for the queries that SQL can express."""

P4 = r"""
WITH pages AS (
  SELECT page_id, content_format, content,
    regexp_replace(lower(regexp_extract(coalesce(final_url, url, ''), '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)', 1)), '^www\.', '') AS site
  FROM source_pages WHERE content IS NOT NULL),
parts AS (SELECT page_id, site, content_format, string_split(content, chr(10)) AS ls FROM pages),
lines AS (SELECT page_id, site, content_format, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM parts),
forms AS (
  SELECT page_id, site, line_no,
    trim(regexp_replace(regexp_replace(lower(CASE WHEN content_format = 'html' THEN regexp_replace(line, '<[^>]*>', '', 'g') ELSE line END), '[0-9]', '', 'g'), '[\s\x{00a0}\x{2000}-\x{200a}\x{3000}\x{202f}\x{2028}\x{2029}\x{0085}\x{205f}\x{1680}\x{000b}\x{001c}-\x{001f}]+', ' ', 'g')) AS form
  FROM lines),
long AS (SELECT * FROM forms WHERE length(form) >= 15),
sites AS (SELECT site, count(DISTINCT page_id) AS pages FROM pages GROUP BY site),
hot AS (
  SELECT site, form FROM (SELECT site, form, count(DISTINCT page_id) AS n FROM long GROUP BY site, form) JOIN sites USING (site)
  WHERE n >= 6 AND n >= 0.2 * pages)
SELECT page_id, CAST(line_no AS BIGINT) AS line_no FROM long JOIN hot USING (site, form)
"""

P5 = r"""
WITH words AS (SELECT page_id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM source_pages WHERE content IS NOT NULL),
grams AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words WHERE len(w) >= 100),
sizes AS (SELECT page_id, count(*) AS n FROM grams GROUP BY page_id),
common AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.page_id < y.page_id GROUP BY 1, 2)
SELECT a AS page_id_a, b AS page_id_b FROM common JOIN sizes s ON s.page_id = a JOIN sizes t ON t.page_id = b WHERE c >= 0.5 * (s.n + t.n - c)
"""

P7 = r"""
WITH clean AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL),
words AS (SELECT side, id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z]+|#[0-9]+|#x[0-9A-Fa-f]+);|\]\([^()\s]*\)', ' ', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM clean),
runs AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS run FROM words WHERE len(w) >= 13)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run WHERE d.side = 'd' AND i.side = 'i'
"""

P1 = r"""
WITH RECURSIVE placed AS (
  SELECT s.section_key, s.text,
    coalesce(CASE WHEN s.char_start >= 0 AND substring(a.content, s.char_start + 1, length(s.text)) = s.text THEN s.char_start END,
             CASE WHEN instr(a.content, s.text) > 0 THEN instr(a.content, s.text) - 1 END, s.char_start, 0) AS base
  FROM (SELECT DISTINCT section_key, artifact_id, text, char_start FROM sections WHERE length(text) > 1200) s LEFT JOIN source_artifacts a ON a.artifact_id = s.artifact_id),
steps AS (
  SELECT section_key, text, base, CAST(1 AS BIGINT) AS piece_no, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS dummy FROM placed
  UNION ALL
  SELECT section_key, text, base, piece_no + 1,
    e - 150 + CASE WHEN regexp_matches(substring(text, e - 150, 150), '[ \n]') THEN length(regexp_extract(substring(text, e - 150, 150), '^([^ \n]*)[ \n]', 1)) ELSE 0 END, NULL
  FROM (
    SELECT *, s + CASE
      WHEN regexp_matches(win, '(?s)^.{599}.*\n\n') THEN length(regexp_extract(win, '(?s)^(.{599}.*\n\n)', 1))
      WHEN regexp_matches(win, '(?s)^.{600}.*\n') THEN length(regexp_extract(win, '(?s)^(.{600}.*\n)', 1))
      WHEN regexp_matches(win, '(?s)^(.{600}.*[。！？]|.{599}.*[.!?] )') THEN greatest(length(regexp_extract(win, '(?s)^(.{600}.*[。！？])', 1)), length(regexp_extract(win, '(?s)^(.{599}.*[.!?] )', 1)))
      WHEN regexp_matches(win, '(?s)^.{600}.* ') THEN length(regexp_extract(win, '(?s)^(.{600}.* )', 1))
      ELSE 1200 END AS e
    FROM (SELECT *, substring(text, s + 1, 1200) AS win FROM steps WHERE length(text) - s > 1200)))
SELECT section_key, piece_no, CAST(base + s AS BIGINT) AS piece_start,
  CAST(base + CASE WHEN length(text) - s <= 1200 THEN length(text) ELSE s + CASE
      WHEN regexp_matches(win, '(?s)^.{599}.*\n\n') THEN length(regexp_extract(win, '(?s)^(.{599}.*\n\n)', 1))
      WHEN regexp_matches(win, '(?s)^.{600}.*\n') THEN length(regexp_extract(win, '(?s)^(.{600}.*\n)', 1))
      WHEN regexp_matches(win, '(?s)^(.{600}.*[。！？]|.{599}.*[.!?] )') THEN greatest(length(regexp_extract(win, '(?s)^(.{600}.*[。！？])', 1)), length(regexp_extract(win, '(?s)^(.{599}.*[.!?] )', 1)))
      WHEN regexp_matches(win, '(?s)^.{600}.* ') THEN length(regexp_extract(win, '(?s)^(.{600}.* )', 1))
      ELSE 1200 END END AS BIGINT) AS piece_end
FROM (SELECT *, substring(text, s + 1, 1200) AS win FROM steps)
"""

ORACLES = {"p1_found": P1, "p4_found": P4, "p5_found": P5, "p7_found": P7}

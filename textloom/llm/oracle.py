"""SQL twins of the training-data queries that SQL can express."""

_LINES = r"""
WITH page AS (
  SELECT web_id, url, content,
         regexp_replace(lower(trim(coalesce(domain, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)', 1)))), '^(www\.|m\.)+', '') AS site
  FROM web_content WHERE content IS NOT NULL),
line AS (
  SELECT web_id, url, site, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM page),
lettered AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS letters FROM line),
repeated AS (SELECT site, letters FROM lettered WHERE letters <> '' GROUP BY site, letters HAVING count(DISTINCT url) >= 5)
"""

P2_FOUND = _LINES + """
SELECT DISTINCT l.web_id, CAST(l.line_no AS INTEGER) AS line_no
FROM lettered l JOIN repeated r ON l.site IS NOT DISTINCT FROM r.site AND l.letters = r.letters
"""

P2_REMOVED = _LINES + """,
marked AS (
  SELECT l.web_id, l.line_no, l.line, r.letters IS NOT NULL AS gone
  FROM lettered l LEFT JOIN repeated r ON l.site IS NOT DISTINCT FROM r.site AND l.letters = r.letters),
kept AS (SELECT web_id, count(*) FILTER (gone) AS removed_lines, sum(length(line)) FILTER (NOT gone) AS chars, count(*) FILTER (NOT gone) AS lines FROM marked GROUP BY web_id)
SELECT w.web_id, CAST(coalesce(k.removed_lines, 0) AS BIGINT) AS removed_lines,
       CAST(CASE WHEN w.content IS NULL THEN NULL ELSE coalesce(k.chars, 0) + greatest(coalesce(k.lines, 0) - 1, 0) END AS BIGINT) AS kept_chars
FROM web_content w LEFT JOIN kept k ON w.web_id = k.web_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_removed": P2_REMOVED}

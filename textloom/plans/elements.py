"""Queries over source elements, imported modules and the head of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import elements as el
from textloom.sources.tables import table


def _files(spark, sf):
    return table(spark, sf, "code_files")


def brace_elements(spark, sf):
    return el.brace_elements(_files(spark, sf))


def block_sizes(spark, sf):
    """How many elements of each type there are in each repository, and how many lines they take."""
    size = F.col("end_line") - F.col("start_line") + 1
    found = el.brace_elements(_files(spark, sf)).groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("repo"), "type")
    return found.agg(F.count("*").alias("elements"), F.sum(size).alias("lines"), F.max(size).alias("longest"))


def import_modules(spark, sf):
    rows = _files(spark, sf).where("content is not null")
    return rows.select("file_path", F.array_join(el.modules_of(F.col("content"), F.col("language")), ",").alias("modules"))


def external_packages(spark, sf):
    """How many files of each repository import each package in their source."""
    rows = _files(spark, sf).where("content is not null").select(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("repo"), F.explode(el.packages_of(el.modules_of(F.col("content"), F.col("language")))).alias("package"))
    return rows.groupBy("repo", "package").agg(F.count("*").alias("files"))


def head_documentation(spark, sf):
    return _files(spark, sf).where("content is not null").select("file_path", el.head_documentation(F.col("content"), F.col("language")).alias("documentation"))


def module_graph(spark, sf):
    return el.module_edges(_files(spark, sf))


def readme_lookup(spark, sf):
    return el.readmes(_files(spark, sf))


def repository_advice(spark, sf):
    return el.repository_advice(_files(spark, sf), table(spark, sf, "code_elements"))


QUERIES = {f.__name__: f for f in (brace_elements, block_sizes, import_modules, external_packages, head_documentation, module_graph, readme_lookup, repository_advice)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STARTS = "CASE " + " ".join(
    f"WHEN language = '{known}' AND regexp_extract(text, {_q(p)}, 1) NOT IN ('', {', '.join(map(_q, el.NO_NAMES))}) THEN {{'type': '{kind}', 'name': regexp_extract(text, {_q(p)}, 1)}}"
    for known, patterns in el.STARTS.items() for kind, p in patterns
) + " END"
_ELEMENTS = f"""f AS (SELECT file_path, language, content FROM code_files WHERE content IS NOT NULL AND language IN ({', '.join(map(_q, el.STARTS))})),
t0 AS (SELECT file_path, unnest(regexp_extract_all(content, {_q(el.TOKEN)})) AS token, generate_subscripts(regexp_extract_all(content, {_q(el.TOKEN)}), 1) AS place FROM f),
t AS (SELECT file_path, place, token, length(token) - length(replace(token, chr(10), '')) AS ends,
  1 + coalesce(sum(length(token) - length(replace(token, chr(10), ''))) OVER (PARTITION BY file_path ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM t0),
c AS (SELECT file_path, unnest(range(CAST(line AS BIGINT) + 1, CAST(line + ends AS BIGINT) + 1)) AS line FROM t WHERE token NOT IN ('{{', '}}', chr(10)) AND ends > 0),
l AS (SELECT file_path, language, unnest(string_split(content, chr(10))) AS text, len(string_split(content, chr(10))) AS lines, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM f),
s AS (SELECT file_path, line, lines, {_STARTS} AS start FROM l),
m AS (SELECT file_path, line, 0 AS place, 0 AS step, start.type AS type, start.name AS name, lines FROM s ANTI JOIN c USING (file_path, line) WHERE start IS NOT NULL
  UNION ALL SELECT file_path, line, place, CASE token WHEN '{{' THEN 1 ELSE -1 END, NULL, NULL, 0 FROM t WHERE token IN ('{{', '}}')),
d AS (SELECT *, sum(step) OVER (PARTITION BY file_path ORDER BY line, place) AS depth FROM m),
b AS (SELECT *, min(CASE WHEN step = -1 THEN line END) OVER (PARTITION BY file_path, depth ORDER BY line, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS closes FROM d),
g AS (SELECT file_path, type, name, CAST(line AS INT) AS start_line, CAST(coalesce(closes, least(line + {el.OPEN_LINES - 1}, lines)) AS INT) AS end_line FROM b WHERE type IS NOT NULL),
e AS (SELECT file_path, CASE WHEN type = 'function' AND within THEN 'method' ELSE type END AS type, name, start_line, end_line, within AS in_class FROM (SELECT *,
  coalesce(max(CASE WHEN type = 'class' THEN end_line END) OVER (PARTITION BY file_path ORDER BY start_line, end_line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_line, false) AS within FROM g))"""


def _bare(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({x}, '#[^\n]*|[()\n\r\t]', ' ', 'g')), '[ ]+as[ ]+[^ ]+$', '')"


def _all(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({x}, {_q(pattern)}, {group})"


_PYTHON = f"""list_concat(flatten([[{_bare('n')} for n in string_split(x, ',')] for x in {_all('content', el._PLAIN)}]),
  flatten([[CASE WHEN {_bare('n')} = '' THEN '' ELSE regexp_replace(regexp_extract(x, {_q(el._FROM)}, 1), '([^.])$', '\\1.') || {_bare('n')} END for n in string_split(regexp_extract(x, {_q(el._FROM)}, 2), ',')] for x in {_all('content', el._FROM, 0)}]))"""
_GO = f"list_concat({_all('content', el.MODULES['go'][0])}, flatten([{_all('b', el.GO_PATH)} for b in {_all('content', el.GO_BLOCK)}]))"
_SCRIPT = f"flatten([{', '.join(_all('content', p) for p in el.MODULES['javascript'])}])"
_MODULES = f"""SELECT file_path, list_sort(list_distinct([m for m in CASE language WHEN 'python' THEN {_PYTHON} WHEN 'go' THEN {_GO} WHEN 'javascript' THEN {_SCRIPT} WHEN 'typescript' THEN {_SCRIPT}
  WHEN 'java' THEN {_all('content', el.MODULES['java'][0])} WHEN 'rust' THEN {_all('content', el.MODULES['rust'][0])} ELSE [] END
  if m <> '' AND (language = 'python' OR NOT regexp_matches(m, '^[./]'))])) AS modules FROM code_files WHERE content IS NOT NULL"""


def _head(*patterns: str, strip: str | None = None) -> str:
    got = [f"nullif(regexp_extract(content, {_q(p)}, 1), '')" for p in patterns]
    return ", ".join(f"regexp_replace({g}, {_q(strip)}, '', 'g')" if strip else g for g in got)


SQL = {
    "brace_elements": f"WITH {_ELEMENTS} SELECT * FROM e",
    "block_sizes": f"""WITH {_ELEMENTS} SELECT split_part(file_path, '/', 1) AS repo, type, count(*) AS elements, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines, max(end_line - start_line + 1) AS longest FROM e GROUP BY 1, 2""",
    "import_modules": f"SELECT file_path, coalesce(array_to_string(modules, ','), '') AS modules FROM ({_MODULES})",
    "external_packages": f"""SELECT split_part(file_path, '/', 1) AS repo, package, count(*) AS files FROM (SELECT file_path, unnest(list_distinct([split_part(m, '.', 1) for m in modules if NOT starts_with(m, '.') AND NOT contains(m, '/')])) AS package FROM ({_MODULES})) GROUP BY 1, 2""",
    "head_documentation": rf"""SELECT file_path, nullif(regexp_replace(CASE WHEN language = 'python' THEN coalesce({_head(*el.HEADS)}, {_head(el.HASH_HEAD, strip=r'(?m)^[ \t]*#+ ?')}, '')
        ELSE coalesce({_head(el.BLOCK_HEAD, strip=r'(?m)^[ \t]*\*+ ?')}, {_head(el.LINE_HEAD, strip=r'(?m)^[ \t]*//+ ?')}, '') END, '^\s+|\s+$', '', 'g'), '') AS documentation FROM code_files WHERE content IS NOT NULL""",
    "module_graph": r"""WITH n AS (SELECT file_path, split_part(file_path, '/', 1) AS repo, regexp_extract(file_path, '([^/]*?)(?:\.[A-Za-z0-9]+)?$', 1) AS stem, imports FROM code_files),
        a AS (SELECT DISTINCT file_path AS src, repo, module, string_split_regex(regexp_replace(module, '^[./]+', ''), '[./]') AS parts FROM (SELECT file_path, repo, unnest(imports) AS module FROM n) WHERE module IS NOT NULL),
        k AS (SELECT src, repo, module, 0 AS nth, parts[-1] AS stem FROM a UNION ALL SELECT src, repo, module, 1, parts[-2] FROM a WHERE len(parts) > 1),
        h AS (SELECT src, module, nth, min(file_path) AS dst FROM k JOIN n USING (repo, stem) WHERE file_path <> src GROUP BY 1, 2, 3),
        b AS (SELECT a.src, a.module, min_by(dst, nth) AS dst FROM a LEFT JOIN h USING (src, module) GROUP BY 1, 2)
        SELECT DISTINCT src, coalesce(dst, 'pkg:' || split_part(regexp_replace(module, '^[./]+', ''), '.', 1)) AS dst, CASE WHEN dst IS NULL THEN 'package' ELSE 'file' END AS kind FROM b""",
    "readme_lookup": f"""SELECT split_part(file_path, '/', 1) AS repo, min_by(file_path, list_position([{', '.join(map(_q, el.README_NAMES))}], name)) FILTER (name IN ({', '.join(map(_q, el.README_NAMES))})) AS readme
        FROM (SELECT file_path, regexp_extract(file_path, '^[^/]+/([^/]+)$', 1) AS name FROM code_files) GROUP BY 1""",
    "repository_advice": """WITH s AS (SELECT split_part(file_path, '/', 1) AS repo, sum(line_count) / count(*) AS length, count(DISTINCT language) AS languages FROM code_files GROUP BY 1),
        k AS (SELECT split_part(file_path, '/', 1) AS repo, count(*) FILTER (complexity > 10) AS hard, max(complexity) AS most, count(*) FILTER (contains(lower(type), 'function')) AS functions, count(*) FILTER (lower(type) = 'class') AS classes FROM code_elements GROUP BY 1)
        SELECT repo, concat_ws('; ', CASE WHEN hard > 0 THEN 'refactor ' || hard || ' complex elements' END, CASE WHEN most > 20 THEN 'break down the most complex element' END, CASE WHEN functions / greatest(classes, 1) > 10 THEN 'gather functions in classes' END,
        CASE WHEN length > 500 THEN 'split long files' END, CASE WHEN languages > 3 THEN 'keep practices alike across languages' END) AS advice FROM s LEFT JOIN k USING (repo)""",
}

"""Code queries over code_files and code_elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.operators import code
from textloom.sources.tables import table


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_files")


def file_language(spark, sf):
    path = F.col("file_path")
    return _files(spark, sf).select("file_path", code.language_of(path).alias("language"), code.is_excluded(path).alias("excluded"), code.stem(path).alias("stem"))


def import_extract(spark, sf):
    files = _files(spark, sf).where("content is not null")
    return files.select("file_path", F.array_join(code.imports_of(F.col("content"), F.col("language")), ",").alias("imports"))


def complexity_keywords(spark, sf):
    return _files(spark, sf).where("content is not null").select("file_path", F.round(code.keyword_complexity(F.col("content")), 6).alias("complexity"))


def line_declarations(spark, sf):
    return code.declarations(_files(spark, sf)).select("file_path", F.col("line_no").cast("bigint").alias("line_no"), "name")


def brace_depth(spark, sf):
    depth = code.brace_depth(_files(spark, sf).where("language <> 'python'"))
    return depth.groupBy("file_path").agg(F.count("*").alias("lines"), F.max("depth").alias("deepest"), F.max_by("depth", "line_no").alias("at_end"))


def dep_graph(spark, sf):
    return code.dependency_edges(_files(spark, sf))


def two_cycles(spark, sf):
    return code.two_cycles(code.dependency_edges(_files(spark, sf)))


def reach(spark, sf):
    return code.reachable(code.dependency_edges(_files(spark, sf)), 3).select("src", "dst", F.col("hops").cast("bigint").alias("hops"))


def repo_summary(spark, sf):
    """Files, lines, languages and share of documented elements of each repository."""
    files = _files(spark, sf).groupBy(code.repository(F.col("file_path")).alias("repo")).agg(
        F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.round(F.avg("complexity_score"), 4).alias("mean_complexity"), F.concat_ws(",", F.array_sort(F.collect_set("language"))).alias("languages")
    )
    elements = table(spark, sf, "code_elements").groupBy(code.repository(F.col("file_path")).alias("repo")).agg(
        F.count("*").alias("elements"), F.round(F.avg((F.coalesce(F.trim("docstring"), F.lit("")) != "").cast("double")), 6).alias("documented")
    )
    return files.join(elements, "repo", "left").select("repo", "files", "lines", "mean_complexity", "languages", F.coalesce("elements", F.lit(0)).alias("elements"), "documented")


def folder_topk(spark, sf):
    """The five folders of each repository with most files."""
    folder = F.regexp_extract("file_path", r"^[^/]+/((?:[^/]+/)?[^/]+)/[^/]*$", 1)
    counts = _files(spark, sf).select(code.repository(F.col("file_path")).alias("repo"), folder.alias("folder")).groupBy("repo", "folder").agg(F.count("*").alias("files"))
    nth = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("files").desc(), "folder"))
    return counts.withColumn("nth", nth.cast("bigint")).where("nth <= 5")


def complex_files(spark, sf):
    """The three most complex files of each repository."""
    files = _files(spark, sf).select(code.repository(F.col("file_path")).alias("repo"), "file_path", "complexity_score").where("complexity_score is not null")
    nth = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("complexity_score").desc(), "file_path"))
    return files.withColumn("nth", nth.cast("bigint")).where("nth <= 3")


def code_insights(spark, sf):
    elements = table(spark, sf, "code_elements").select(F.lower("type").alias("type"), "complexity", "name")
    return elements.groupBy("type").agg(
        F.count("*").alias("elements"), F.max("complexity").alias("most"), F.round(F.avg("complexity"), 6).alias("mean"), F.sum((F.col("complexity") > 10).cast("int")).alias("over_ten")
    )


def element_texts(spark, sf):
    return code.element_text(table(spark, sf, "code_elements")).select("element_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def element_filter(spark, sf):
    """Elements by the default filter (functions), overlaid by a language."""
    return table(spark, sf, "code_elements").where("lower(type) = 'function' and lower(language) = 'python'").select("element_id", "name", "file_path")


def python_elements(spark, sf):
    return code.python_elements(_files(spark, sf))


def package_use(spark, sf):
    """How many files and repositories use each package."""
    used = _files(spark, sf).select("file_path", F.explode(F.array_distinct("imports")).alias("package"))
    return used.groupBy("package").agg(F.count("*").alias("files"), F.countDistinct(code.repository(F.col("file_path"))).alias("repos"))


def _arms(x: str, patterns: dict[str, str], template: str, other: str) -> str:
    return "CASE language " + " ".join("WHEN '{}' THEN {}".format(k, template.format(p=p.replace("'", "''"))) for k, p in patterns.items()) + f" ELSE {other} END"


_LANGUAGE = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in known)}) THEN '{name}'" for name, known in code.EXTENSIONS) + " END"
_EDGES = r"""n AS (SELECT file_path, split_part(file_path, '/', 1) AS repo, regexp_replace(regexp_extract(file_path, '([^/]*?)(?:\.[A-Za-z0-9]+)?$', 1), '_[0-9]+$', '') AS base, imports FROM code_files),
a AS (SELECT DISTINCT file_path AS src, repo, name, regexp_replace(name, '(?:lib|kit|io)$', '') AS base FROM (SELECT file_path, repo, unnest(imports) AS name FROM n) WHERE name IS NOT NULL),
t AS (SELECT a.src, a.name, min(n.file_path) AS dst FROM a LEFT JOIN n ON a.repo = n.repo AND a.base = n.base AND a.src <> n.file_path GROUP BY a.src, a.name),
e AS (SELECT DISTINCT src, coalesce(dst, 'pkg:' || name) AS dst, CASE WHEN dst IS NULL THEN 'package' ELSE 'file' END AS kind FROM t)"""

QUERIES = {f.__name__: f for f in (file_language, import_extract, complexity_keywords, line_declarations, brace_depth, dep_graph, two_cycles, reach, repo_summary, folder_topk, complex_files, code_insights, element_texts, element_filter, python_elements, package_use)}

SQL = {
    "file_language": rf"""SELECT file_path, {_LANGUAGE} AS language, len(list_intersect(string_split(file_path, '/'), {list(code.EXCLUDED_PARTS)})) > 0 AS excluded,
        regexp_extract(file_path, '([^/]*?)(?:\.[A-Za-z0-9]+)?$', 1) AS stem FROM (SELECT *, lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM code_files)""",
    "import_extract": "SELECT file_path, coalesce(array_to_string(list_sort(list_distinct(" + _arms("content", code.IMPORTS, "regexp_extract_all(content, '{p}', 1)", "[]") + ")), ','), '') AS imports FROM code_files WHERE content IS NOT NULL",
    "complexity_keywords": "SELECT file_path, round(greatest(1.0::DOUBLE, (1 + len(regexp_extract_all(content, '(?m)" + code.DECISIONS + "'))) / 20.0::DOUBLE), 6) AS complexity FROM code_files WHERE content IS NOT NULL",
    "line_declarations": "SELECT * FROM (SELECT file_path, line_no, " + _arms("line", code.DECLARATIONS, "regexp_extract(line, '{p}', 1)", "''") + """ AS name
        FROM (SELECT file_path, language, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM code_files WHERE content IS NOT NULL)) WHERE name <> ''""",
    "brace_depth": """WITH l AS (SELECT file_path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM code_files WHERE content IS NOT NULL AND language <> 'python'),
        d AS (SELECT file_path, line_no, sum(len(regexp_extract_all(line, '\\{')) - len(regexp_extract_all(line, '\\}'))) OVER (PARTITION BY file_path ORDER BY line_no) AS depth FROM l)
        SELECT file_path, count(*) AS lines, CAST(max(depth) AS BIGINT) AS deepest, CAST(max_by(depth, line_no) AS BIGINT) AS at_end FROM d GROUP BY file_path""",
    "dep_graph": f"WITH {_EDGES} SELECT src, dst, kind FROM e",
    "two_cycles": f"WITH {_EDGES} SELECT DISTINCT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.kind = 'file' AND b.kind = 'file' AND a.src < a.dst",
    "reach": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst, 1 AS hops FROM e WHERE kind = 'file' UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON r.dst = e.src WHERE e.kind = 'file' AND r.hops < 3 AND e.dst <> r.src)
        SELECT src, dst, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY src, dst""",
    "repo_summary": """WITH f AS (SELECT split_part(file_path, '/', 1) AS repo, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, round(avg(complexity_score), 4) AS mean_complexity,
          coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages FROM code_files GROUP BY 1),
        e AS (SELECT split_part(file_path, '/', 1) AS repo, count(*) AS elements, round(avg(CASE WHEN coalesce(trim(docstring), '') <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS documented FROM code_elements GROUP BY 1)
        SELECT f.repo, files, lines, mean_complexity, languages, coalesce(elements, 0) AS elements, documented FROM f LEFT JOIN e USING (repo)""",
    "folder_topk": """SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, folder) AS nth FROM (SELECT split_part(file_path, '/', 1) AS repo, regexp_extract(file_path, '^[^/]+/((?:[^/]+/)?[^/]+)/[^/]*$', 1) AS folder, count(*) AS files
        FROM code_files GROUP BY 1, 2) QUALIFY nth <= 5""",
    "complex_files": """SELECT split_part(file_path, '/', 1) AS repo, file_path, complexity_score, row_number() OVER (PARTITION BY split_part(file_path, '/', 1) ORDER BY complexity_score DESC, file_path) AS nth
        FROM code_files WHERE complexity_score IS NOT NULL QUALIFY nth <= 3""",
    "code_insights": "SELECT lower(type) AS type, count(*) AS elements, max(complexity) AS most, round(avg(complexity), 6) AS mean, count(*) FILTER (complexity > 10) AS over_ten FROM code_elements GROUP BY 1",
    "element_texts": r"""WITH t AS (SELECT element_id, concat_ws(chr(10), type, name, language, substr(docstring, 1, 250), array_to_string(parameters, ', '), return_type,
          substr(array_to_string(list_slice(string_split(content, chr(10)), 1, 5), chr(10)), 1, 500)) AS text FROM code_elements)
        SELECT element_id, length(text) AS chars, md5(text) AS digest FROM t""",
    "element_filter": "SELECT element_id, name, file_path FROM code_elements WHERE lower(type) = 'function' AND lower(language) = 'python'",
    "package_use": "SELECT package, count(*) AS files, count(DISTINCT split_part(file_path, '/', 1)) AS repos FROM (SELECT file_path, unnest(list_distinct(imports)) AS package FROM code_files) GROUP BY package",
}

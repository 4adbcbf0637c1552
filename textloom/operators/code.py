"""Source code: languages, imports, dependency graph, complexity, elements, structure."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.session import checkpointed

#: Languages by extension; the first that lists it wins, so .h is C++.
EXTENSIONS = (
    ("python", ("py", "pyi")), ("javascript", ("js", "jsx", "mjs")), ("typescript", ("ts", "tsx")), ("java", ("java",)), ("cpp", ("cpp", "cc", "cxx", "hpp", "h")),
    ("c", ("c", "h")), ("go", ("go",)), ("rust", ("rs",)), ("ruby", ("rb",)), ("markdown", ("md",)), ("config", ("json", "yaml", "yml", "toml")),
)
EXCLUDED_PARTS = ("vendor", "node_modules", "third_party", "dist", "build", "__pycache__", ".git")
DECISIONS = r"(?:^|[^A-Za-z0-9_])(?:if|elif|for|while|case|catch|except|switch)(?:[^A-Za-z0-9_]|$)|&&|\|\|"
#: How a declaration of each language starts; group 1 is the name.
DECLARATIONS = {
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)",
    "javascript": r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+|class\s+|const\s+)([A-Za-z_$][A-Za-z0-9_$]*)",
    "java": r"^\s*(?:public|private|protected)\s+(?:static\s+)?(?:class\s+|[A-Za-z<>\[\]]+\s+)([A-Za-z_][A-Za-z0-9_]*)\s*[({]",
    "go": r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)",
}
IMPORTS = {
    "python": r"(?m)^\s*(?:import|from)\s+([A-Za-z_][A-Za-z0-9_.]*)",
    "javascript": r"(?m)^\s*import\s+([A-Za-z_$][A-Za-z0-9_$]*)",
    "java": r"(?m)^\s*import\s+(?:static\s+)?[a-z.]*?([A-Za-z_][A-Za-z0-9_]*);",
    "go": r"(?m)^\s*import\s+\"([^\"]+)\"",
}


def language_of(path: Column) -> Column:
    """Language by file extension, null for unknown ones."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ext.isin(*known), F.lit(language)) for language, known in EXTENSIONS])


def is_excluded(path: Column) -> Column:
    """Whether any part of a path is a vendored or built folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in EXCLUDED_PARTS]))


def repository(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def stem(path: Column) -> Column:
    """File name without extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)


def imports_of(content: Column, language: Column) -> Column:
    """Sorted different imports by the language's pattern; empty for other languages."""
    arms = F.coalesce(*[F.when(language == name, F.regexp_extract_all(content, F.lit(p), F.lit(1))) for name, p in IMPORTS.items()], F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(arms))


def keyword_complexity(content: Column) -> Column:
    """One more than the decisions of a file, over twenty, at least 1."""
    return F.greatest(F.lit(1.0), (1 + F.regexp_count(content, F.lit("(?m)" + DECISIONS))) / 20)


def declarations(files: DataFrame) -> DataFrame:
    """(file_path, line_no, name) of the declarations a line pattern finds."""
    lines = files.where("content is not null").select("file_path", "language", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    found = F.coalesce(*[F.when(F.col("language") == name, F.regexp_extract("line", p, 1)) for name, p in DECLARATIONS.items()], F.lit(""))
    return lines.select("file_path", (F.col("at") + 1).alias("line_no"), found.alias("name")).where("name <> ''")


def brace_depth(files: DataFrame) -> DataFrame:
    """(file_path, line_no, depth): open braces after each line of a file; strings are not told apart."""
    lines = files.where("content is not null").select("file_path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    step = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    upto = Window.partitionBy("file_path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("file_path", (F.col("at") + 1).alias("line_no"), F.sum(step).over(upto).alias("depth"))


def dependency_edges(files: DataFrame) -> DataFrame:
    """(src, dst, kind): each import to the first file of the repository its name fits, else to ``pkg:name``.

    A name fits a file if it is its stem, both without number and library endings.
    Only the two first files of each repository and name take part, so an import
    has at most one row however many files fit.
    """
    named = files.select("file_path", repository(F.col("file_path")).alias("repo"), F.regexp_replace(stem(F.col("file_path")), r"_[0-9]+$", "").alias("base"), "imports")
    asked = named.select(F.col("file_path").alias("src"), "repo", F.explode(F.array_distinct("imports")).alias("name")).where("name is not null")
    asked = asked.withColumn("base", F.regexp_replace("name", r"(?:lib|kit|io)$", ""))
    nth = F.row_number().over(Window.partitionBy("repo", "base").orderBy("file_path"))
    first = named.select("repo", "base", "file_path").withColumn("nth", nth).where("nth <= 2").groupBy("repo", "base").agg(F.min("file_path").alias("one"), F.max("file_path").alias("two"))
    joined = asked.join(first, ["repo", "base"], "left")
    target = F.when(F.col("one") != F.col("src"), F.col("one")).when(F.col("two") != F.col("src"), F.col("two"))
    return joined.select("src", F.coalesce(target, F.concat(F.lit("pkg:"), "name")).alias("dst"), F.when(target.isNotNull(), "file").otherwise("package").alias("kind")).distinct()


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of files that depend on each other, each once."""
    files = edges.where("kind = 'file'").select("src", "dst")
    back = files.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return files.join(back, ["src", "dst"], "left_semi").where("src < dst").distinct()


def reachable(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hops): files within so many steps, with the fewest."""
    step = edges.where("kind = 'file'").select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    found = edges.where("kind = 'file'").select("src", "dst", F.lit(1).alias("hops"))
    front = found
    for hop in range(2, hops + 1):
        grown = front.select("src", F.col("dst").alias("mid")).join(step, "mid").select("src", F.col("next").alias("dst")).where("src <> dst").distinct()
        front = checkpointed(edges.sparkSession, grown.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hop)))
        found = found.unionByName(front)
    return found.groupBy("src", "dst").agg(F.min("hops").alias("hops"))


def python_elements(files: DataFrame) -> DataFrame:
    """(file_path, type, name, start_line, end_line, docstring, complexity) of Python files by their syntax trees.

    Functions at any depth, classes and constants in capitals; a file that does not
    parse gives one row of type ``error``.
    """

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["file_path"], batch["content"]):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
                    rows.append((path, "error", type(error).__name__, 0, 0, None, 0))
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        kind = "class" if isinstance(node, ast.ClassDef) else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
                        branches = 1 + sum(isinstance(n, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)) for n in ast.walk(node))
                        rows.append((path, kind, node.name, node.lineno, node.end_lineno, ast.get_docstring(node), branches))
                    elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id.isupper():
                        rows.append((path, "constant", node.targets[0].id, node.lineno, node.end_lineno, None, 0))
            yield pd.DataFrame(rows, columns=["file_path", "type", "name", "start_line", "end_line", "docstring", "complexity"])

    schema = "file_path string, type string, name string, start_line int, end_line int, docstring string, complexity int"
    return files.where("language = 'python' and content is not null").select("file_path", "content").mapInPandas(visit, schema)


def element_text(element: DataFrame) -> DataFrame:
    """(element_id, text) to embed: type, name, language, start of the documentation, parameters, return type, first five lines."""
    snippet = F.substring(F.array_join(F.slice(F.split("content", "\n"), 1, 5), "\n"), 1, 500)
    parts = [F.col("type"), F.col("name"), F.col("language"), F.substring("docstring", 1, 250), F.array_join("parameters", ", "), F.col("return_type"), snippet]
    return element.select("element_id", F.concat_ws("\n", *parts).alias("text"))

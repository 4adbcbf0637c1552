"""Source elements of languages with braces, modules that files import, and documentation at the head of files.

Everything is regular expressions and windows on the JVM.  Strings and comments
are read as tokens of their own, so signs inside them count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.code import repository, stem

#: A comment, a string, a brace or a line end; what stands between them has no meaning for blocks.
TOKEN = r"""/\*(?s:.*?)\*/|//[^\n]*|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`]*`|[{}\n]"""
_SCRIPT = (
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\("),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>|[A-Za-z0-9_$]+\s*=>)"),
    ("function", r"^\s*(?:static\s+)?(?:async\s+)?\*?([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*\{"),
)
#: How an element of each language starts its line; group 1 is the name, the first that fits wins.
STARTS = {
    "javascript": _SCRIPT,
    "typescript": (*_SCRIPT, ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][A-Za-z0-9_$]*)")),
    "java": (
        *((kind, rf"^\s*(?:(?:public|private|protected|abstract|static|final)\s+)*{kind}\s+([A-Za-z0-9_]+)") for kind in ("class", "interface", "enum")),
        ("constructor", r"^\s*(?:public|private|protected)\s+([A-Z][A-Za-z0-9_]*)\s*\([^)]*\)\s*(?:throws\s[^{]*)?\{"),
        ("method", r"^\s*(?:(?:public|private|protected|abstract|static|final|synchronized)\s+)+(?:<[^>]*>\s+)?[A-Za-z0-9_.<>,?\[\]]+\s+([A-Za-z0-9_]+)\s*\([^)]*\)\s*(?:throws\s[^{]*)?\{"),
    ),
    "go": (
        ("method", r"^func\s+\([^)]*\)\s*([A-Za-z0-9_]+)"), ("function", r"^func\s+([A-Za-z0-9_]+)"), ("struct", r"^\s*type\s+([A-Za-z0-9_]+)\s+struct"), ("interface", r"^\s*type\s+([A-Za-z0-9_]+)\s+interface"),
    ),
    "rust": (
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)"), *((kind, rf"^\s*(?:pub(?:\([^)]*\))?\s+)?{kind}\s+([A-Za-z0-9_]+)") for kind in ("struct", "enum", "trait")),
    ),
}
#: Words that stand before a bracket and a block without naming an element.
NO_NAMES = ("if", "for", "while", "switch", "catch", "function", "return", "with")
#: An element whose block is never closed ends after so many lines, or with its file.
OPEN_LINES = 50


def _start_of(language: Column, line: Column) -> Column:
    """struct(type, name) of the element that starts on a line, else null."""
    arms = []
    for known, patterns in STARTS.items():
        for kind, pattern in patterns:
            name = F.regexp_extract(line, pattern, 1)
            arms.append(F.when((language == known) & (name != "") & ~name.isin(*NO_NAMES), F.struct(F.lit(kind).alias("type"), name.alias("name"))))
    return F.coalesce(*arms)


def brace_elements(files: DataFrame) -> DataFrame:
    """(file_path, type, name, start_line, end_line, in_class) of classes, functions and the like in languages with braces.

    An element ends with the brace that brings its file back to the depth it had
    before; without one after ``OPEN_LINES`` lines or with the file.  Functions of
    scripts within a class are methods.  Null content gives no rows; a file's
    tokens meet in one task, as a file is one row.
    """
    given = files.where(F.col("content").isNotNull() & F.col("language").isin(*STARTS)).select("file_path", "language", "content")
    by_place = Window.partitionBy("file_path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    tokens = given.select("file_path", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    tokens = tokens.withColumn("line", (1 + F.coalesce(F.sum(ends).over(by_place), F.lit(0))).cast("int"))
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1)
    braces = tokens.where("token in ('{', '}')").select("file_path", "line", "at", step.alias("step"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("lines"))
    # lines inside a comment or string that runs over several start nothing
    covered = tokens.where("token not in ('{', '}', '\n') and instr(token, '\n') > 0").select("file_path", F.explode(F.sequence(F.col("line") + 1, F.col("line") + ends)).alias("line"))
    lines = given.select("file_path", "language", F.size(F.split("content", "\n")).alias("lines"), F.posexplode(F.split("content", "\n")).alias("nth", "text"))
    starts = lines.select("file_path", (F.col("nth") + 1).alias("line"), _start_of(F.col("language"), F.col("text")).alias("start"), "lines").where("start is not null").join(covered, ["file_path", "line"], "left_anti")
    marks = starts.select("file_path", "line", F.lit(-1).alias("at"), F.lit(0).alias("step"), "start.type", "start.name", "lines").unionByName(braces)
    depth = F.sum("step").over(Window.partitionBy("file_path").orderBy("line", "at").rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("file_path", "depth").orderBy(F.col("line").desc(), F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    closed = marks.withColumn("depth", depth).withColumn("closes", F.last(F.when(F.col("step") == -1, F.col("line")), ignorenulls=True).over(back))
    found = closed.where("type is not null").withColumn("end_line", F.coalesce("closes", F.least(F.col("line") + OPEN_LINES - 1, "lines")))
    before = Window.partitionBy("file_path").orderBy("line", F.col("end_line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    in_class = F.coalesce(F.max(F.when(F.col("type") == "class", F.col("end_line"))).over(before) >= F.col("line"), F.lit(False))
    kind = F.when((F.col("type") == "function") & in_class, "method").otherwise(F.col("type"))
    return found.select("file_path", kind.alias("type"), "name", F.col("line").alias("start_line"), "end_line", in_class.alias("in_class"))


_PLAIN = r"(?m)^[ \t]*import[ \t]+([^\n#;]+)"
_FROM = r"(?m)^[ \t]*from[ \t]+([.A-Za-z0-9_]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;(]+)"
#: The module an import statement names, group 1, for languages other than Python.
MODULES = {
    "javascript": (r"""(?m)^[ \t]*import[ \t]+(?:[^'"\n;]*?[ \t]from[ \t]+)?['"]([^'"\n]+)['"]""", r"""(?:import|require)[ \t]*\([ \t]*['"]([^'"\n]+)['"]""", r"""(?m)^[ \t]*export[ \t][^'"\n;]*?from[ \t]+['"]([^'"\n]+)['"]""", r"(?m)^[ \t]*import[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*;?[ \t]*$"),
    "java": (r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([A-Za-z0-9_.]+\*?)[ \t]*;",),
    "go": (r"""(?m)^[ \t]*import[ \t]+(?:[A-Za-z0-9_.]+[ \t]+)?"([^"\n]+)\"""",),
    "rust": (r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([A-Za-z0-9_:]+)",),
}
GO_BLOCK, GO_PATH = r"(?m)^import[ \t]*\(([^)]*)\)", r'"([^"\n]+)"'


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"#[^\n]*|[()\n\r\t]", " ")), r"[ ]+as[ ]+[^ ]+$", "")


def modules_of(content: Column, language: Column) -> Column:
    """Sorted different modules a file imports: ``a.b`` and ``x.name`` in Python, module paths that are not relative elsewhere."""
    plain = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(_PLAIN), F.lit(1)), lambda x: F.transform(F.split(x, ","), _bare)))
    named = F.flatten(
        F.transform(
            F.regexp_extract_all(content, F.lit(_FROM), F.lit(0)),
            lambda x: F.transform(F.split(F.regexp_extract(x, _FROM, 2), ","), lambda n: F.when(_bare(n) != "", F.concat(F.regexp_replace(F.regexp_extract(x, _FROM, 1), r"([^.])$", "$1."), _bare(n))).otherwise("")),
        )
    )
    script = F.coalesce(F.when(language == "typescript", "javascript"), language)
    arms = [F.when(script == known, F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])) for known, patterns in MODULES.items() if known != "go"]
    blocks = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(GO_BLOCK), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(GO_PATH), F.lit(1))))
    go = F.when(language == "go", F.concat(F.regexp_extract_all(content, F.lit(MODULES["go"][0]), F.lit(1)), blocks))
    every = F.coalesce(F.when(language == "python", F.concat(plain, named)), *arms, go, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(every, lambda m: (m != "") & ((language == "python") | ~m.rlike("^[./]")))))


def packages_of(modules: Column) -> Column:
    """First parts of the modules that are neither relative nor paths."""
    outside = F.filter(modules, lambda m: ~F.startswith(m, F.lit(".")) & ~F.contains(m, F.lit("/")))
    return F.array_sort(F.array_distinct(F.transform(outside, lambda m: F.split_part(m, F.lit("."), F.lit(1)))))


#: Documentation at the head of a file, below an interpreter line: docstring, block comment, run of line comments.
HEADS = (r'''\A(?:#![^\n]*\n)?\s*[rRuU]?"""((?s:.*?))"""''', r"""\A(?:#![^\n]*\n)?\s*[rRuU]?'''((?s:.*?))'''""")
BLOCK_HEAD, LINE_HEAD, HASH_HEAD = r"\A\s*/\*+((?s:.*?))\*+/", r"\A\s*((?://[^\n]*(?:\n[ \t]*)?)+)", r"\A(?:#![^\n]*\n)?\s*((?:#[^\n]*(?:\n[ \t]*)?)+)"


def head_documentation(content: Column, language: Column) -> Column:
    """The documentation a file starts with, without comment signs; null without one."""
    quoted = [F.regexp_extract(content, p, 1) for p in HEADS]
    hashed = F.regexp_replace(F.regexp_extract(content, HASH_HEAD, 1), r"(?m)^[ \t]*#+ ?", "")
    block = F.regexp_replace(F.regexp_extract(content, BLOCK_HEAD, 1), r"(?m)^[ \t]*\*+ ?", "")
    lined = F.regexp_replace(F.regexp_extract(content, LINE_HEAD, 1), r"(?m)^[ \t]*//+ ?", "")
    chosen = F.when(language == "python", _first(*quoted, hashed)).otherwise(_first(block, lined))
    return F.nullif(F.regexp_replace(chosen, r"^\s+|\s+$", ""), F.lit(""))


def _first(*texts: Column) -> Column:
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))


def module_edges(files: DataFrame) -> DataFrame:
    """(src, dst, kind): each import to a file of its repository by file name, else to ``pkg:`` and its first part.

    The last part of a module names the file, or else the part before it (then the
    last is a symbol); of several files the first path but the importing file's own
    counts.  Null imports give no rows.
    """
    named = files.select("file_path", repository(F.col("file_path")).alias("repo"), stem(F.col("file_path")).alias("stem"), "imports")
    asked = named.select(F.col("file_path").alias("src"), "repo", F.explode(F.array_distinct("imports")).alias("module")).where("module is not null")
    parts = F.split(F.regexp_replace("module", r"^[./]+", ""), r"[./]")
    tried = asked.select("src", "repo", "module", F.posexplode(F.array_distinct(F.array(F.element_at(parts, -1), F.coalesce(F.get(parts, F.size(parts) - 2), F.element_at(parts, -1))))).alias("nth", "stem"))
    # the two first files of a name are enough to find one that is not the importing file
    order = Window.partitionBy("repo", "stem").orderBy("file_path")
    first = named.select("repo", "stem", "file_path").withColumn("place", F.row_number().over(order)).where("place <= 2").groupBy("repo", "stem").agg(F.min("file_path").alias("one"), F.max("file_path").alias("two"))
    hit = tried.join(first, ["repo", "stem"], "left").withColumn("dst", F.when(F.col("one") != F.col("src"), F.col("one")).when(F.col("two") != F.col("src"), F.col("two")))
    best = hit.groupBy("src", "module").agg(F.min_by("dst", F.when(F.col("dst").isNotNull(), F.col("nth"))).alias("dst"))
    package = F.concat(F.lit("pkg:"), F.split_part(F.regexp_replace("module", r"^[./]+", ""), F.lit("."), F.lit(1)))
    return best.select("src", F.coalesce("dst", package).alias("dst"), F.when(F.col("dst").isNull(), "package").otherwise("file").alias("kind")).distinct()


#: Names of a repository's introduction, the first that exists counts.
README_NAMES = ("README.md", "README.rst", "README.txt", "README", "readme.md")


def readmes(files: DataFrame) -> DataFrame:
    """(repo, readme): the introduction at the top of each repository, null without one."""
    name = F.regexp_extract("file_path", r"^[^/]+/([^/]+)$", 1)
    place = F.array_position(F.array(*[F.lit(n) for n in README_NAMES]), name)
    ranked = files.select(repository(F.col("file_path")).alias("repo"), "file_path", F.when(place > 0, place).alias("place"))
    return ranked.groupBy("repo").agg(F.min_by("file_path", "place").alias("readme"))


def repository_advice(files: DataFrame, elements: DataFrame) -> DataFrame:
    """(repo, advice): what stands out in each repository: complex elements (over 10, over 20), functions without classes, long files, many languages."""
    shape = files.groupBy(repository(F.col("file_path")).alias("repo")).agg((F.sum("line_count") / F.count("*")).alias("length"), F.countDistinct("language").alias("languages"))
    kind = F.lower("type")
    known = elements.groupBy(repository(F.col("file_path")).alias("repo")).agg(
        F.sum((F.col("complexity") > 10).cast("int")).alias("hard"), F.max("complexity").alias("most"),
        F.sum(kind.contains("function").cast("int")).alias("functions"), F.sum((kind == "class").cast("int")).alias("classes"),
    )
    advice = F.concat_ws(
        "; ", F.when(F.col("hard") > 0, F.concat(F.lit("refactor "), F.col("hard").cast("string"), F.lit(" complex elements"))), F.when(F.col("most") > 20, "break down the most complex element"),
        F.when(F.col("functions") / F.greatest("classes", F.lit(1)) > 10, "gather functions in classes"), F.when(F.col("length") > 500, "split long files"), F.when(F.col("languages") > 3, "keep practices alike across languages"),
    )
    return shape.join(known, "repo", "left").select("repo", advice.alias("advice"))

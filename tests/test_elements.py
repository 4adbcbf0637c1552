import ast

from pyspark.sql import functions as F

from textloom.operators import elements as el

SCRIPT = """/* class Ghost {
function ghost() {
*/
export class Map extends Base {
    async read(a) {
        const s = "}}}"; // }
        if (a) { return `}
class Inner {`; }
    }
}
const add = (a, b) => {
    return a + b;
};
function tail() {
"""
JAVA = "public class A {\n    public A(int x) {\n    }\n    private static List<String> go(String a) throws IOException {\n        return null; // {\n    }\n}\ninterface B { }\n"
GO = 'package x\n\nimport (\n\t"fmt"\n\tm "net/http"\n)\nimport "os"\n\nfunc (s *S) Do() error {\n\tx := \'{\'\n}\nfunc New() {}\ntype S struct { a int }\n'


def files(spark, rows):
    return spark.createDataFrame(rows, "file_path string, language string, content string, imports array<string>")


def test_elements_end_where_their_braces_do(spark):
    rows = [("a.js", "javascript", SCRIPT, None), ("A.java", "java", JAVA, None), ("x.go", "go", GO, None), ("n.js", "javascript", None, None), ("e.js", "javascript", "", None), ("p.py", "python", "def f(): pass", None)]
    found = {tuple(r) for r in el.brace_elements(files(spark, rows)).collect()}
    assert found == {
        ("a.js", "class", "Map", 4, 10, False), ("a.js", "method", "read", 5, 9, True), ("a.js", "function", "add", 11, 13, False), ("a.js", "function", "tail", 14, 15, False),
        ("A.java", "class", "A", 1, 7, False), ("A.java", "constructor", "A", 2, 3, True), ("A.java", "method", "go", 4, 6, True), ("A.java", "interface", "B", 8, 8, False),
        ("x.go", "method", "Do", 9, 11, False), ("x.go", "function", "New", 12, 12, False), ("x.go", "struct", "S", 13, 13, False),
    }
    assert el.brace_elements(files(spark, [])).count() == 0


def test_long_block_is_not_cut(spark):
    text = "function f() {\n" + "  g({});\n" * 3000 + "}\n"
    assert [tuple(r)[1:5] for r in el.brace_elements(files(spark, [("f.js", "javascript", text, None)])).collect()] == [("function", "f", 1, 3002)]


def modules(spark, language, content):
    return files(spark, [("f", language, content, None)]).select(el.modules_of(F.col("content"), F.col("language"))).first()[0]


def test_python_modules_are_those_of_the_syntax_tree(spark):
    source = "import os, sys as s\nimport a.b\nfrom x.y import z as q, w\nfrom . import near\nfrom .m import (one,\n    two as t,  # why\n)\nfrom all import *\nif x:\n    import late\n"
    wanted = set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            wanted |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            head = "." * node.level + (node.module or "")
            wanted |= {head + ("" if head.endswith(".") else ".") + a.name for a in node.names}
    assert modules(spark, "python", source) == sorted(wanted)


def test_modules_of_other_languages(spark):
    script = "import a from 'one';\nimport {b} from \"two\";\nimport './side';\nconst c = require('three');\nconst d = await import('four');\nexport * from 'five';\nimport six\n"
    assert modules(spark, "javascript", script) == ["five", "four", "one", "six", "three", "two"]
    assert modules(spark, "go", GO) == ["fmt", "net/http", "os"]
    assert modules(spark, "java", "import a.b.C;\nimport static d.E.f;\nimport g.*;\n") == ["a.b.C", "d.E.f", "g.*"]
    assert modules(spark, "cobol", "import x") == [] and modules(spark, "python", "") == []


def test_head_documentation(spark):
    rows = [
        ("a", "python", '#!/usr/bin/env python\n"""Module\n  text."""\nx = 1', None), ("b", "python", "# one\n# two\n\nx = 1\n# three", None), ("c", "java", "/** Top.\n * More.\n */\nclass A {}", None),
        ("d", "go", "// A\n// B\npackage x // C", None), ("e", "go", "package x\n// late", None), ("f", "java", "", None), ("g", None, "// A", None),
    ]
    got = {r[0]: r[1] for r in files(spark, rows).select("file_path", el.head_documentation(F.col("content"), F.col("language"))).collect()}
    assert got == {"a": "Module\n  text.", "b": "one\ntwo", "c": "Top.\nMore.", "d": "A\nB", "e": None, "f": None, "g": "A"}


def test_module_edges_prefer_the_file_and_fall_back_to_the_package(spark):
    rows = [("r/util.py", "python", "", ["util", "lib.util", "os.path", None]), ("r/main.py", "python", "", ["util", "util.helper", "./util", "util"]), ("q/util.py", "python", "", None)]
    got = {tuple(r) for r in el.module_edges(files(spark, rows)).collect()}
    assert got == {("r/util.py", "pkg:util", "package"), ("r/util.py", "pkg:lib", "package"), ("r/util.py", "pkg:os", "package"), ("r/main.py", "r/util.py", "file")}


def test_readme_takes_the_first_name_at_the_top(spark):
    rows = [("r/readme.md", None, None, None), ("r/README.rst", None, None, None), ("q/docs/README.md", None, None, None)]
    assert {tuple(r) for r in el.readmes(files(spark, rows)).collect()} == {("r", "r/README.rst"), ("q", None)}

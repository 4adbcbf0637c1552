import pytest

from textloom.llm.code_pairs import code_description_pairs, pair_of, ranged_pair_of, says_something, strip_markers

NOTHING = [
    None, "", "  ", "TODO", "TODO: write docs", "FIXME later", "XXX", "WIP", "n/a", "...", "???", "-", "-----", "See above.", "{@inheritDoc}", "noqa", "eslint-disable-next-line no-console",
    "Auto-generated method stub", "Generated code, do not edit.", "(undocumented)", "self-explanatory", ":return:", ":param page_map:\n:param limit:", "@param pageMap", "Description of load_page.",
    "This is the load_page function.", "load page", "Load page.", "Function load_page", "load_page()", "load_page = None\nreturn load_page(x)", "/** TODO */", "# type: ignore", "see README",
]
SOMETHING = [
    "Walk over the pages and return them in order.", "Prüft, ob die Seiten noch vollständig sind.", "TODO list support is missing, but otherwise: decide whether the pages still match.",
    "/**\n * Collects the entries of a page.\n */", "load_page: Retries the transfer when the page cannot be reached.", "Loads a page from disk unless it is cached", "数据处理的例子返回页面",
]


@pytest.mark.parametrize("doc", NOTHING)
def test_says_nothing(doc):
    assert not says_something(doc, "load_page", ("page_map", "limit", "pageMap"))


@pytest.mark.parametrize("doc", SOMETHING)
def test_says_something(doc):
    assert says_something(doc, "load_page", ("page_map",))


def test_python_docstring_is_cut_out():
    src = 'def load(x):\n    """Read a page from the store.\n\n    More.\n    """\n    # inner note\n    return x\n'
    code, description, where = pair_of(src, None, "load", "python", None)
    assert where == "docstring" and description.startswith("Read a page") and '"""' not in code and "inner note" in code


DOC = '"""Reads ä page from the störe."""'


@pytest.mark.parametrize(
    "source, code",
    [
        (f"def load(x): {DOC}", "def load(x):"), (f"def load(x): {DOC}; return x\n", "def load(x): return x"),
        (f"    def load(x, é='é'):\n        {DOC}; return x\n", "def load(x, é='é'):\n    return x"),
        (f"def load(x):\n    {DOC}  # note\n    return x\n", "def load(x):\n    # note\n    return x"),
        (f"\n# Old.\n\n    @cached\n    def load(x):\n\n        {DOC}\n\n        return x\n", None), (f"def load(x):\n    {DOC}\n    return (x +", None),
    ],
)
def test_docstring_is_cut_by_its_exact_range(source, code):
    pair = ranged_pair_of(source, None, "load", "python", None)
    assert source[pair[3] : pair[4]] == DOC and pair[0] == code if code else source[pair[3] : pair[4]] == DOC
    assert source[pair[5] : pair[6]].lstrip().startswith(("def", "@cached")) and pair[6] == len(source.rstrip("\n"))


def test_ranges_of_comment_and_field():
    source = "// Reads a page from the store.\nint load() { return 1; }\n"
    pair = ranged_pair_of(source, None, "load", "java", None)
    assert source[pair[3] : pair[4]].strip() == "// Reads a page from the store." and source[pair[5] : pair[6]] == "int load() { return 1; }"
    assert ranged_pair_of(None, "Reads a page from the store.", "load", "java", None)[3:] == (None,) * 4


def test_inner_comments_are_no_documentation():
    assert pair_of("def load(x):\n    # Reads the page from the store.\n    return x\n", None, "load", "python", None) is None


def test_cut_source_is_scanned():
    assert pair_of('def load(x):\n    """Read a page from the store."""\n    return (x +', None, "load", "python", None)[2] == "docstring"


@pytest.mark.parametrize("language", ["java", "javascript", "go", None])
def test_leading_comments(language):
    src = "/**\n * Reads a page from the store.\n */\npublic int load(String x) {\n    // inner\n    return 1;\n}"
    code, description, where = pair_of(src, None, "load", language, None)
    assert where == "comment" and description == "Reads a page from the store." and code.startswith("public int")


def test_strip_markers():
    assert strip_markers('"""\n    Two\n      lines\n    """') .splitlines()[0] == "Two"
    assert strip_markers("// a\n// b") == "a\nb"


def test_operator_edges(spark):
    schema = "element_id long, type string, name string, content string, docstring string, language string, parameters array<string>, code string, pair int"
    rows = [
        (1, "function", "f", None, None, None, None, "c", 1),
        (2, "Async_Method", "f", None, "Counts the open entries.", None, None, "c", 1),
        (3, "class", "F", None, "Counts the open entries.", None, None, "c", 1),
        (4, None, "f", "x", "Counts the open entries.", "python", [], "c", 1),
        (5, "METHOD", None, 'def f():\n    """Counts the open entries."""\n    return ' + "1+" * 20_000 + "1", None, "python", [None], "c", 1),
        (2, "Async_Method", "f", None, "Counts the open entries.", None, None, "c", 1),
    ]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.element_id for r in code_description_pairs(df).collect()) == [2, 2, 5]
    assert code_description_pairs(df.limit(0)).count() == 0

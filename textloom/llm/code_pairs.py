"""Functions paired with their documentation.

Each element's source is parsed: Python into its abstract syntax tree; of the brace
languages, and of Python that does not parse, regular expressions take the leading
comments.  The documentation attached to the declaration (leading comment, or
docstring of the body) and its exact source range are taken, and pairs whose
documentation says nothing go.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_PAIR = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("description", T.StringType()), T.StructField("found_in", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("doc_start", "doc_end", "code_start", "code_end")]
)

PLACEHOLDERS = frozenset(
    "wip tbd tba na n/a none nil null todo fixme xxx hack undocumented selfexplanatory self-explanatory obvious trivial docs doc "
    "documentation description comment placeholder dummy test empty missing unknown later pending deprecated nodoc".split()
)
#: Words that add nothing to the name of an element.
FILLER = frozenset(
    "a an the this that is are of for to and function method procedure routine func def fn class constructor getter setter helper "
    "description implementation implements does it its here simply just name named called die der das eine ein funktion methode "
    "la le une un fonction méthode el una función método o a uma função método de functie".split()
)
_TODO = re.compile(r"^(?:todo|fixme|xxx|hack|wip|tbd)\b[\s:\-–]*", re.I)
_POINTER = re.compile(
    r"^(?:\{?@?inherit-?docs?\}?|(?:please )?(?:see|cf|refer to|same as|as|ditto|like|described?|documented|defined|check|vgl|siehe|voir|ver|zie)\b.*"
    r"|@see\b.*|(?:copied|inherited) from\b.*|ditto)$",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^(?:noqa\b.*|type:\s*ignore.*|pylint\s*:.*|pragma\b.*|mypy\s*:.*|flake8\s*:.*|isort\s*:.*|fmt\s*:\s*\w+|yapf\s*:.*|nosec\b.*|ruff\s*:.*"
    r"|eslint-.*|tslint:.*|jshint\b.*|@?ts-(?:ignore|nocheck|expect-error).*|prettier-ignore.*|istanbul\b.*|c8 ignore.*|@?suppresswarnings.*"
    r"|noinspection\b.*|checkstyle\b.*|nopmd\b.*|nolint\b.*|go:\w+.*|\+build\b.*|export \w+|line \d+.*|(?:end)?region\b.*|global \w+"
    r"|@(?:override|deprecated|internal|private|public|static|async|hidden|ignore|nodoc)\b\W*|-\*-.*-\*-|vim:.*|coverage:.*|coding[:=].*)$",
    re.I,
)
_STUB = re.compile(
    r"^(?:this (?:file|code|method|function) (?:is|was) )?(?:auto-?\s?generated\b.*|generated (?:code|file|by|from)\b.*|code generated\b.*|do not (?:edit|modify)\b.*"
    r"|(?:method|function|constructor|class)? ?stub\b.*|not (?:yet )?(?:implemented|documented|written).*|no (?:docs?|documentation|description|comment)\b.*"
    r"|(?:documentation|docs|description|comment) (?:goes|to be|missing|pending|needed|required)\b.*|(?:to be|needs to be) (?:documented|written|done|added).*"
    r"|add (?:a )?(?:docs?|documentation|description|comment)s?\b.*|write (?:docs?|documentation|me)\b.*|lorem ipsum.*|insert .* here)$",
    re.I,
)
_TAG = re.compile(r"^(?:[:@\\]\s?(?P<tag>[A-Za-z]+)\b:?|(?P<head>args|arguments|parameters|params|returns?|raises|yields|throws|example|examples|note|notes|see also)\s*:\s*$)", re.I)
_CODE_LINE = re.compile(
    r"^(?:[\w.\[\]]+\s*(?:=|\+=|-=|:=)\s*\S.*|(?:return|yield|raise|throw|import|from|del|await|var|let|const|if|for|while|else|elif|try|catch|func|def|public|private)\b.*[\w\])};:]"
    r"|[\w.]+\([^)]*\)\s*[;{]?|.*[;{}]\s*)$"
)
_STARTS_CODE = re.compile(r"[=(){}\[\];]")


def is_function(kind: Column) -> Column:
    """Whether an element type names a function or method, in any spelling and also async."""
    return F.lower(F.trim(kind)).rlike(r"func|method|^(async[ _-]?)?(def|fn|procedure|constructor|lambda)$")


_QUOTED = re.compile(r"[rRbBuUfF]{0,2}(\"\"\"|''')(.*?)(?:\1)?", re.S)
_OPENING, _CLOSING, _STAR = re.compile(r"^/\*+!?"), re.compile(r"\*+/\s*$"), re.compile(r"^\s*\*(?!\*) ?")
_SIGN, _LINE_SIGN = re.compile(r"//|#"), re.compile(r"^\s*(?://+!?|#+) ?")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")
_MARKUP = re.compile(r"</?\w+[^>]*>|[`*_~]{1,3}(?=\w)|(?<=\w)[`*~]{1,3}")
_JOINTS, _SENTENCE, _WORD, _TOKEN = re.compile(r"[\s_-]+"), re.compile(r"[.:;]\s"), re.compile(r"[^\W_]+"), re.compile(r"[\w$]+")
_OWN_TEXT = re.compile(r"^[`*]*([\w$]+)[`*]*(?:\s*\([^)]*\))?\s*[:\-–]\s+(.*)$")
_PARAM_TEXT = re.compile(r"^[`*]*([\w$]+)[`*]*\s*[:\-–]\s*(.*)$")
_TAG_HEAD = re.compile(r"^(?:\{[^}]*\}\s*)?[\w$.*\[\]]+[\s:\-–]*")
_INHERIT = re.compile(r"\{?@inherit")


def strip_markers(doc: str) -> str:
    """A documentation text without comment signs, string quotes and common indentation."""
    text = doc.replace("\r\n", "\n").expandtabs(4).strip()
    quoted = _QUOTED.fullmatch(text)
    if quoted:
        text = quoted.group(2)
    if text.startswith("/*"):
        text = _CLOSING.sub("", _OPENING.sub("", text))
        text = "\n".join(_STAR.sub("", line) for line in text.split("\n"))
    elif _SIGN.match(text):
        text = "\n".join(_LINE_SIGN.sub("", line) for line in text.split("\n"))
    first, _, rest = text.partition("\n")
    return (first.strip() + "\n" + textwrap.dedent(rest)).strip()


@lru_cache(maxsize=100_000)
def name_words(name: str | None) -> frozenset[str]:
    return frozenset(p.lower() for p in _NAME_PART.findall(name or ""))


def _says(line: str, name: str, named: frozenset[str], params: set[str]) -> bool:
    line = _MARKUP.sub(" ", line).strip()
    bare = line.strip(" \t.!?:;,-–—()[]{}<>\"'`*_=/\\|#~")
    if not any(map(str.isalpha, bare)):
        return False
    if bare.lower() in PLACEHOLDERS or _JOINTS.sub("", bare.lower()) in PLACEHOLDERS:
        return False
    short = len(bare.split()) <= 9
    if _DIRECTIVE.match(line) or _DIRECTIVE.match(bare) or (short and (_STUB.match(bare) or (_POINTER.match(bare) and len(bare.split()) <= 7))):
        return False
    todo = _TODO.match(bare)
    if todo:
        rest = _SENTENCE.split(bare[todo.end() :], maxsplit=1)
        return len(rest) > 1 and len(rest[1].split()) >= 3
    known, own = named | FILLER, name.lower()
    words = _WORD.findall(bare)
    if all(name_words(w) <= known for w in words) or all((w.lower() in known or w.lower() == own) and all(p in known or p == own for p in name_words(w)) for w in words):
        return False
    return not {w.lower() for w in _TOKEN.findall(bare)} <= {p.lower() for p in params}


def says_something(doc: str | None, name: str | None = None, params: tuple[str, ...] = ()) -> bool:
    """Whether a documentation text says more than its element's name, tags, placeholders or code."""
    if doc is None:
        return False
    text = strip_markers(doc)
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    named, given = name_words(name), set(params)
    plain, tagged = [], []
    for line in lines:
        own = _OWN_TEXT.match(line)
        if own and own.group(1).lower() == (name or "").lower():
            line = own.group(2)
        tag = _TAG.match(line)
        if tag and not _INHERIT.match(line):
            rest = line[tag.end() :].strip(" :-–")
            if (tag.group("tag") or "").lower() in {"param", "parameter", "arg", "argument", "type", "throws", "raises", "raise", "exception"}:
                rest = _TAG_HEAD.sub("", rest)
            if len(rest.split()) >= 2:
                tagged.append(rest)
        else:
            own = _PARAM_TEXT.match(line)
            if own and own.group(1) in given:
                line = own.group(2)
            if line:
                plain.append(line)
    code = [bool(_CODE_LINE.match(line)) and bool(_STARTS_CODE.search(line) or line.startswith("return ")) for line in plain]
    prose = [line for line, is_code in zip(plain, code) if not is_code or (len(line.split()) > 5 and line[:1].isupper() and line[-1] in ".:")]
    if any(_says(line, name or "", named, given) for line in prose):
        return True
    return bool(prose or not plain) and any(_says(line, name or "", named, given) for line in tagged)


_LEADING = re.compile(r"\s*(?:(/\*.*?(?:\*/|\Z))|((?:[ \t]*//[^\n]*(?:\n|\Z))+)|((?:[ \t]*#(?!!)[^\n]*(?:\n|\Z))+))", re.S)
_DECORATORS = re.compile(r"(?:[ \t]*@\w[\w.]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?[ \t]*\n)+")
_PY_HEAD = re.compile(r"\s*(?:@[^\n]*\n\s*)*(?:async\s+)?(?:def|class)\b[^\n]*?(?:\([^)]*\)[^:\n]*)?:[ \t]*(?:#[^\n]*)?\n?", re.S)
_PY_DOC = re.compile(r"\s*[rRbBuU]{0,2}(\"\"\"|''')(.*?)(?:\1|\Z)|\s*(\"[^\"\n]*\"|'[^'\n]*')[ \t]*(?:\n|\Z)", re.S)


def _leading_comment(source: str, hash_comments: bool) -> tuple[str | None, str, tuple[int, int, int]]:
    """The comment right above a declaration, the source without it, and offsets: the comment's start and end, the code's start."""
    doc, at, decorated, start, end, code = None, 0, "", 0, 0, None
    while True:
        deco = _DECORATORS.match(source, at)
        if deco:
            decorated += deco.group()
            code = at if code is None else code
            at = deco.end()
            continue
        match = _LEADING.match(source, at)
        if not match or (match.group(3) and not hash_comments):
            break
        text = match.group(1) or match.group(2) or match.group(3)
        at = match.end()
        # a block above a blank line does not belong to the declaration if another one follows
        alone = doc is None or re.match(r"[ \t]*\n[ \t]*\n", source[at : at + 80])
        doc, start, end = (text, match.start(match.lastindex), at) if alone else (doc + "\n" + text, start, at)
    rest = source[at:].lstrip("\n")
    return doc, decorated + rest, (start, end, len(source) - len(rest) if code is None else code)


_LINE_END = re.compile(r"\r\n?|\n")


def _cut(text: str, start: int, end: int) -> str:
    """The text without a docstring: its whole lines where it has them to itself, else only it and a semicolon behind it."""
    before, after = text[:start], text[end:]
    after = after[re.match(r"[ \t]*(?:;[ \t]*)?", after).end() :]
    line = before[before.rfind("\n") + 1 :]
    closed = not after or after[0] in "\r\n"
    if closed and not line.strip():
        return before[: len(before) - len(line)] + _LINE_END.sub("", after, count=1) if after else before[: len(before) - len(line)]
    return (before.rstrip(" \t") if closed else before) + after


def _python_doc(source: str) -> tuple[str | None, str, tuple[int, int]]:
    """Docstring of the element, the source without it, and its start and end counted back from the end of the source.

    A cut source is scanned instead of parsed.
    """
    flat = textwrap.dedent(source)
    given, starts = source.split("\n"), [0, *(m.end() for m in _LINE_END.finditer(flat))]

    def back(at: int) -> int:
        # dedent keeps the number of lines and shortens only their starts
        left = flat.count("\n", at)
        return len(flat[at:].split("\n", 1)[0]) + sum(len(line) + 1 for line in given[len(given) - left :])

    try:
        node = ast.parse(flat).body[0]
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):

                def offset(line: int, column: int) -> int:
                    at = starts[line - 1]
                    return at + len(flat[at : at + column].encode()[:column].decode())

                start, end = offset(first.lineno, first.col_offset), offset(first.end_lineno, first.end_col_offset)
                return first.value.value, _cut(flat, start, end), (back(start), back(end))
            return None, flat, (0, 0)
    except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError):
        pass
    head = _PY_HEAD.match(flat)
    doc = head and _PY_DOC.match(flat, head.end())
    if doc:
        text = doc.group(2) if doc.group(1) else doc.group(3).strip("\"'")
        start = doc.start() + len(doc.group()) - len(doc.group().lstrip())
        return text, flat[: doc.start()].rstrip("\n") + "\n" + flat[doc.end() :].lstrip("\n"), (back(start), back(doc.start() + len(doc.group().rstrip())))
    return None, flat, (0, 0)


@lru_cache(maxsize=256)
def _language(label: str | None) -> str:
    return {"py": "python", "js": "javascript", "golang": "go"}.get((label or "").strip().lower(), (label or "").strip().lower())


def pair_of(content: str | None, docstring: str | None, name: str | None, language: str | None, params) -> tuple[str, str, str] | None:
    """(code, description, where it was found), or None if no documentation says anything."""
    pair = ranged_pair_of(content, docstring, name, language, params)
    return pair and pair[:3]


def ranged_pair_of(content: str | None, docstring: str | None, name: str | None, language: str | None, params) -> tuple | None:
    """The pair with the start and end of documentation and of code, as characters of the content.

    The code reaches from its first decorator or declaration to the last line and
    may hold the documentation; a documentation field has no range, nor has code
    that is not there.
    """
    source = content or ""
    python = _language(language) == "python" or (_language(language) not in {"javascript", "java", "go"} and bool(_PY_HEAD.match(_leading_comment(source, True)[1])))
    above, rest, (start, end, code) = _leading_comment(source, python)
    inner, back = None, (0, 0)
    if python:
        inner, rest, back = _python_doc(rest)
    given = tuple(p for p in (params if params is not None else ()) if p)
    size = len(source)
    whole = (code, max(code, len(source.rstrip("\n")))) if source else (None, None)
    for where, doc, at in (("docstring", inner, (size - back[0], size - back[1])), ("comment", above, (start, end)), ("field", docstring, (None, None))):
        if doc is not None and says_something(doc, name, given):
            return rest.strip("\n"), strip_markers(doc), where, *at, *whole
    return None


@F.pandas_udf(_PAIR)
def _pairs(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for columns in parts:
        rows = [ranged_pair_of(*row) or (None,) * 7 for row in zip(*columns)]
        found = pd.DataFrame(rows, columns=_PAIR.names)
        yield found.astype(dict.fromkeys(_PAIR.names[3:], "Int32"))


def code_description_pairs(elements: DataFrame) -> DataFrame:
    """One row (element_id, name, language, code, description, found_in, doc_start, doc_end, code_start, code_end) for each documented function or method.

    Null content leaves the docstring field as the only source; null in both, or a
    text that says nothing, gives no row.  Source that does not parse is scanned.
    Rows that repeat come out as often as they go in.
    """
    pair = _pairs("content", "docstring", "name", "language", "parameters")
    return (
        elements.where(is_function(F.col("type")))
        .where(F.col("content").isNotNull() | F.col("docstring").isNotNull())
        .select("element_id", "name", "language", pair.alias("pair"))
        .where("pair.description is not null")
        .select("element_id", "name", "language", "pair.code", "pair.description", "pair.found_in", "pair.doc_start", "pair.doc_end", "pair.code_start", "pair.code_end")
    )

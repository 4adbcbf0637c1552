"""Garbled text from wrong character decoding: find it and give back the original.

Method: best-first search over a graph whose nodes are texts and whose edges are
"encode with the codec it was read with, decode with the one it was written in",
unescape steps, and a step that gives a lost no-break space back.  A
character-plausibility cost orders the frontier, a visited set keeps states from
being expanded twice, and the cheapest text reached wins.  The search ends where
all that is left costs more than the best text by ``SLACK`` and half of what is won
so far.  A UTF-8 or unescape step shortens the text and a way holds one swap of two
single-byte codecs at most (a second could turn any text into any other), so the
graph is finite and the search ends by itself, without a cap on states or steps.

Each line is searched by itself, and a step rewrites only the runs of a line that
decode cleanly, so a document that is garbled in part is repaired in part.  Spark
keeps ASCII texts without escapes from reaching Python.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: (codec the bytes were read with, codec they were written in)
STEPS = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"),
    ("cp1251", "utf-8"), ("cp1250", "utf-8"), ("iso8859_15", "utf-8"), ("koi8_r", "utf-8"), ("cp866", "utf-8"),
    ("cp1253", "utf-8"), ("cp1254", "utf-8"), ("cp1257", "utf-8"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"),
    ("cp1253", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
    ("cp1252", "cp850"), ("cp1252", "cp437"),
)
#: What a step costs: clean UTF-8 is strong evidence by itself, a swap of two single-byte codecs is not.
STEP_COST, SWAP_COST = 0.05, 0.35
#: Each further character a swap reads anew is one more assumption, as a swap keeps their number and proves nothing.
SWAP_CHARACTER_COST = 0.15
#: States that cost this much more than the best text so far, and half of what that has won, are not expanded.
SLACK = 0.6
#: A repair counts if it lowers the cost of the line by at least this much.
MARGIN = 0.9
#: A state whose non-ASCII characters cost no more than this on average is sound and ends the search.
SOUND = 0.16

PLAIN_LETTERS = "äöüßàâæçéèêëîïôœùûüÿáíóúñãõìòëïÄÖÜẞÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸÁÍÓÚÑÃÕÌÒ"
PLAIN_MARKS = "–—‘’‚“”„«»‹›…•·¿¡§°€£≈→←×±½©®™²³ºª− ­​  ﻿"
PLAIN = frozenset(PLAIN_LETTERS + PLAIN_MARKS)
#: Marks that may stand between two letters of a word.
_JOINERS = frozenset("’–—·\xad\u200b\u200d…")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_RUN = re.compile(r"[^\x00-\x7f]+")
_QUOTED = re.compile(r"[\"'“”„«»‘’`‚‹›(\[]\s?([^\x00-\x7f]{1,8})\s?[\"'“”„«»‘’`›)\]]")


def searchable(text: Column) -> Column:
    """Whether a text can be garbled at all: it has a character beyond ASCII or an escape."""
    return (F.octet_length(text) != F.char_length(text)) | (F.contains(text, F.lit("&")) & text.rlike(_ENTITY.pattern))


@lru_cache(maxsize=65536)
def _odd(run: str) -> int:
    """0 for a run of usual characters, 1 for one usual only outside of words in small letters, 2 for an unusual one."""
    if not PLAIN.issuperset(run) or (len(run) > 1 and not (run.isalpha() and (run.islower() or run.isupper()))):
        return 2
    return int(len(run) == 1 and not run.islower() and run not in _JOINERS)


def suspicious(text: str) -> bool:
    """Whether any run of a text is unusual where it stands, or hidden behind an escape."""
    for m in _RUN.finditer(text):
        odd = _odd(m.group())
        if odd == 2 or (odd and (text[m.start() - 1 : m.start()].islower() or (m.group() == "Ã" and text[m.end() : m.end() + 1] == " "))):
            return True
    return "&" in text and _ENTITY.search(text) is not None


@lru_cache(maxsize=None)
def _reader(codec: str) -> tuple[dict[str, int], re.Pattern, frozenset[str]]:
    """Character to byte for a single-byte codec (unassigned bytes read as the control of that number), its runs, and what can lead a character in UTF-8."""
    table: dict[str, int] = {}
    for byte in range(0x80, 0x100):
        try:
            table[codecs.decode(bytes([byte]), codec)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    if codec != "latin-1":
        for byte in range(0x80, 0xA0):
            table.setdefault(chr(byte), byte)
    return table, re.compile("[" + "".join(map(re.escape, table)) + "]+"), frozenset(c for c, byte in table.items() if 0xC2 <= byte <= 0xF4)


@lru_cache(maxsize=65536)
def _turned(run: str, was: str, written: str) -> str:
    table = _reader(was)[0]
    try:
        return bytes(table[c] for c in run).decode(written)
    except UnicodeDecodeError:
        return run


def _reread(text: str, was: str, written: str) -> str:
    return _reader(was)[1].sub(lambda m: _turned(m.group(), was, written), text)


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "other"


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=65536)
def _char_cost(c: str) -> float:
    o = ord(c)
    if o < 0x80:
        return 0.0
    if 0x80 <= o < 0xA0:
        return 4.0
    if c == "�":
        return 3.0
    if c in PLAIN:
        return 0.08 if c.islower() else 0.15
    if 0x2500 <= o < 0x25A0:
        return 2.0
    if c.isalpha():
        return 0.12 if _script(c) != "latin" else 0.8
    return 0.9 if o < 0x2400 else 0.2


@lru_cache(maxsize=65536)
def _run_cost(before: str, run: str, after: str) -> tuple[float, bool]:
    """Cost of a run of characters beyond ASCII between two others, and whether it has letters that are not Latin."""
    inside = before.isalpha()
    total = sum(map(_char_cost, run))
    for i, c in enumerate(run):
        follows = run[i + 1 : i + 2]
        if not c.isalpha() and c not in _JOINERS and c not in "®™©°ºª" and (inside or follows.isalpha()) and c not in "“”„«»‘‚¿¡":
            total += 0.8
        if c in "ÃÂÄÅ√" and follows and not follows.isupper():
            total += 1.0
    if before.islower() and (run[0].isupper() or (after.islower() and len(run) == 1 and not run.isalpha() and run not in _JOINERS)):
        total += 1.0
    if run == "Ã" and after == " " and not inside:
        total += 1.0
    if len(run) > 2 and run.isalpha() and _script(run[0]) == "latin":
        total += 0.5 * (len(run) - 2)
    if inside and after.isalpha() and run.isalpha() and _script(run[0]) != "latin":
        total += 0.4
    return total, any(c.isalpha() and _script(c) != "latin" for c in run)


def plausibility_cost(text: str) -> float:
    """How implausible the characters of a text are; 0 for plain ASCII."""
    if text.isascii():
        return 0.0
    total, foreign = 0.0, False
    for m in _RUN.finditer(text):
        at, end = m.span()
        cost, other = _run_cost(text[at - 1 : at], m.group(), text[end : end + 1])
        total, foreign = total + cost, foreign or other
    return total + _mixture_cost(text) if foreign else total


def _mixture_cost(text: str) -> float:
    """What words in another script cost: mixed within a word, very short, or few among Latin ones."""
    total, latin, others = 0.0, 0, 0
    for part in text.split():
        for word in _WORD.findall(part) if not part.isascii() else ():
            kinds = {_script(c) for c in word}
            if len(kinds) > 1:
                total += 1.5
            elif kinds <= {"cyrillic", "greek"}:
                others += 1
                total += 1.0 if len(word) < 3 else 0.0
            else:
                latin += 1
        latin += part.isascii() and any(map(str.isalpha, part))
    return total + (0.3 * others if others and latin > 2 * others else 0.0)


def _state_cost(text: str) -> float:
    """Cost of a text as it reads when its escapes are undone."""
    return plausibility_cost(html.unescape(text) if "&" in text else text)


_LOST_SPACE = re.compile(r"(?<![A-ZÀ-Þ])Ã ")


def _is_swap(name: str) -> bool:
    return ">" in name and not name.endswith(">utf-8")


def _edges(text: str, swaps: bool = True) -> Iterator[tuple[str, str]]:
    present = set().union(*_RUN.findall(text))
    for was, written in STEPS:
        table, _, leads = _reader(was)
        if written != "utf-8" and not swaps:
            continue
        if not present.isdisjoint(leads if written == "utf-8" else table.keys()):
            turned = _reread(text, was, written)
            if turned != text:
                yield f"{was}>{written}", turned
    if "&" in text:
        yield "unescape", html.unescape(text)
    if "Ã " in text:
        yield "space", _LOST_SPACE.sub("Ã\xa0", text)


def search_line(line: str) -> tuple[str, tuple[str, ...], float]:
    """Cheapest text reachable from a line, the steps to it, and the cost saved."""
    return _search_short(line) if len(line) <= 2000 else _search(line)


def _search(line: str) -> tuple[str, tuple[str, ...], float]:
    start = _state_cost(line)
    if start < MARGIN:
        return line, (), 0.0
    best, best_cost, best_path = line, start, ()
    frontier: list[tuple[float, int, float, str, tuple[str, ...]]] = [(start, 0, 0.0, line, ())]
    visited, order = {line}, 0
    while frontier:
        cost, _, paid, state, path = heapq.heappop(frontier)
        if cost > best_cost + SLACK + (start - best_cost) / 2:
            break
        if cost < best_cost - 1e-9:
            best, best_cost, best_path = state, cost, path
        if cost - paid <= SOUND * sum(map(len, _RUN.findall(state))) and not ("&" in state and not path):
            break
        for name, turned in _edges(state, not any(map(_is_swap, path))):
            if turned in visited:
                continue
            visited.add(turned)
            order += 1
            toll = paid + (SWAP_COST + SWAP_CHARACTER_COST * (sum(map(str.__ne__, state, turned)) - 1) if _is_swap(name) else STEP_COST)
            heapq.heappush(frontier, (_state_cost(turned) + toll, order, toll, turned, (*path, name)))
    return best, best_path, start - best_cost


_search_short = lru_cache(maxsize=8192)(_search)


def walk(text: str, path: tuple[str, ...]) -> str:
    """Take the named steps one after the other."""
    for name in path:
        was, _, written = name.partition(">")
        text = _reread(text, was, written) if written else html.unescape(text) if name == "unescape" else _LOST_SPACE.sub("Ã\xa0", text)
    return text


def repair_text(text: str | None) -> tuple[str | None, bool, str]:
    """(text as far as it can be given back, whether any of it is garbled, the steps taken).

    A garbled sequence that a text quotes on purpose (alone inside quotation marks,
    in a line that is otherwise sound) is left as it is and does not count.
    """
    if not text or not suspicious(text):
        return text, False, ""
    lines = text.split("\n")
    found: dict[int, tuple[str, tuple[str, ...]]] = {}
    garbled, steps = False, {}
    for i, line in enumerate(lines):
        if not suspicious(line):
            continue
        plain = html.unescape(line) if "&" in line else line
        rest = _QUOTED.sub('""', plain)
        if rest != plain and "�" not in rest and search_line(rest)[2] < MARGIN:
            continue
        if "�" in line:
            garbled = True
            steps["replacement"] = None
        best, path, saved = search_line(line)
        if saved >= MARGIN and any(">" in p for p in path):
            garbled = True
            found[i] = (best, path)
    usual = Counter(path for _, path in found.values()).most_common(1)
    for i, (best, path) in found.items():
        # a short line alone can be read in several ways; the way of the document's other lines is tried on it too
        if path != usual[0][0]:
            turned = walk(lines[i], usual[0][0])
            if plausibility_cost(turned) <= plausibility_cost(best) + 1.0:
                best, path = turned, usual[0][0]
        lines[i] = best
        steps.update(dict.fromkeys(path))
    return "\n".join(lines), garbled, ",".join(steps)


_RESULT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("garbled", T.BooleanType()), T.StructField("steps", T.StringType())]
)


@F.pandas_udf(_RESULT)
def _repair(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        found = map(repair_text, texts)
        # a sound text stays where it is and does not travel back
        yield pd.DataFrame([(fixed if garbled else None, garbled, steps) for fixed, garbled, steps in found], columns=["text", "garbled", "steps"])


def repair_encoding(df: DataFrame, text: str = "text", out: str = "repaired") -> DataFrame:
    """Add a struct ``out`` of text, garbled and steps.

    Null, empty and sound texts come back as they are with garbled false and no
    steps.  A replacement character cannot be undone: the text counts as garbled,
    keeps the character, and steps says ``replacement``.  An existing column named
    ``out`` is replaced; other columns and repeated rows are untouched.
    """
    found = _repair(F.when(searchable(F.col(text)), F.col(text)))
    return df.withColumn(out, found).withColumn(
        out, F.struct(F.coalesce(F.col(out)["text"], F.col(text) if text != out else F.lit(None)).alias("text"), F.col(out)["garbled"].alias("garbled"), F.col(out)["steps"].alias("steps"))
    )

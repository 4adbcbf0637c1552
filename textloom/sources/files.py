"""Files as rows: discovery, text extraction by type, and a status for each file.

Extraction never fails a job: a file that cannot be read has null text and the
reason in ``error``.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators.code import is_excluded, language_of
from textloom.operators.text import file_type

MAX_BYTES = 50 << 20
MAX_SOURCE_BYTES = 1 << 20
_EXTRACTED = "path string, kind string, bytes long, text string, title string, meta string, error string"


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, language) of source files below a folder: known languages, not vendored, at most 1 MB, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    named = files.withColumn("language", language_of(F.col("path")))
    return named.where(F.col("language").isNotNull() & ~is_excluded(F.col("path")) & (F.col("bytes") <= MAX_SOURCE_BYTES)).orderBy("path")


def _html(text: str) -> tuple[str, str | None, dict]:
    title = re.search(r"<title[^>]*>(.*?)</title>", text, re.S | re.I)
    description = re.search(r"<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)", text, re.I)
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", text)
    bare = re.sub(r"\s*\n\s*", "\n", unescape(re.sub(r"<[^>]+>", "\n", bare))).strip()
    return bare, title and unescape(title.group(1)).strip(), {"description": description.group(1) if description else None}


def _markdown(text: str) -> tuple[str, str | None, dict]:
    title = re.search(r"^#\s+(.+)$", text, re.M)
    bare = re.sub(r"```.*?```", lambda m: m.group().strip("`"), text, flags=re.S)
    bare = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", bare)
    bare = re.sub(r"(?m)^\s{0,3}(?:#{1,6}|>|[-*+]|\d+\.)\s+", "", bare)
    return re.sub(r"[*_`]{1,3}(\S(?:.*?\S)?)[*_`]{1,3}", r"\1", bare).strip(), title and title.group(1).strip(), {"raw_chars": len(text)}


def _json(text: str) -> tuple[str, str | None, dict]:
    value = json.loads(text)
    return json.dumps(value, indent=2, ensure_ascii=False), None, {"root": type(value).__name__, "keys": sorted(value) if isinstance(value, dict) else None}


def _xml(text: str) -> tuple[str, str | None, dict]:
    root = ElementTree.fromstring(text)
    return " ".join(t.strip() for t in root.itertext() if t.strip()), None, {"root": root.tag}


def _docx(data: bytes) -> tuple[str, str | None, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p")]
    kept = [line for line in lines if line.strip()]
    return "\n".join(kept), None, {"paragraphs": len(kept)}


def _xlsx(data: bytes, sheets: int = 5) -> tuple[str, str | None, dict]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = sorted(n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        rows = []
        for name in names[:sheets]:
            for row in ElementTree.fromstring(archive.read(name)).iter(f"{ns}row"):
                cells = [(c.get("t"), (c.findtext(f"{ns}v") or c.findtext(f"{ns}is/{ns}t") or "")) for c in row.iter(f"{ns}c")]
                rows.append(" | ".join(shared[int(v)] if t == "s" and v else v for t, v in cells))
    return "\n".join(rows), None, {"sheets": len(names)}


def _csv(text: str) -> tuple[str, str | None, dict]:
    frame = pd.read_csv(io.StringIO(text))
    head = frame.head(10).to_csv(index=False)
    return head, None, {"rows": len(frame), "columns": list(map(str, frame.columns)), "types": [str(t) for t in frame.dtypes]}


_READERS = {"txt": lambda t: (t, None, {"lines": t.count("\n") + 1}), "md": _markdown, "html": _html, "json": _json, "xml": _xml, "csv": _csv}
_BINARY = {"docx": _docx, "xlsx": _xlsx}


def _extract(path: str, kind: str, size: int, data: bytes | None) -> tuple:
    if size > MAX_BYTES:
        return path, kind, size, None, None, None, f"larger than {MAX_BYTES} bytes"
    try:
        if kind in _BINARY:
            text, title, meta = _BINARY[kind](data)
        elif kind in _READERS:
            text, title, meta = _READERS[kind](data.decode("utf-8", "ignore"))
        else:
            return path, kind, size, None, None, None, f"no reader for {kind} is installed"
    except Exception as error:  # one bad file is a row, not a failed job
        return path, kind, size, None, None, None, f"{type(error).__name__}: {error}"[:300]
    return path, kind, size, text, title, json.dumps(meta, ensure_ascii=False, sort_keys=True), None


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, bytes, text, title, meta, error) of every file below a folder.

    text, Markdown, HTML, JSON, XML, CSV, DOCX and XLSX are read; other types give
    a row that says which reader is missing.  Files of no bytes have no row, as
    Spark's file scan passes over them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", file_type(F.col("path"), F.lit(None).cast("string")).alias("kind"), F.col("length").alias("bytes"), F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame([_extract(row.path, row.kind, row.bytes, row.content)], columns=["path", "kind", "bytes", "text", "title", "meta", "error"])

    return named.mapInPandas(extract, _EXTRACTED)

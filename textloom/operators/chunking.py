"""Chunkers: sentence and paragraph folds, and fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SIZE, WINDOW, OVERLAP = 512, 2000, 50


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, question or exclamation mark before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def folded(parts: Column, size: int = SIZE, joiner: str = " ", overlap: int = 0) -> Column:
    """Join parts in order while a chunk stays within ``size`` characters.

    A part longer than the size is a chunk of its own.  With an overlap every
    chunk but the first starts with the last characters of the one before.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, part: Column) -> Column:
        fits = (acc["cur"] == "") | (F.length(acc["cur"]) + len(joiner) + F.length(part) <= size)
        grown = F.when(acc["cur"] == "", part).otherwise(F.concat(acc["cur"], F.lit(joiner), part))
        fresh = F.concat(F.right(acc["cur"], F.lit(overlap)), F.lit(joiner), part) if overlap else part
        return F.when(fits, F.struct(acc["done"].alias("done"), grown.alias("cur"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), fresh.alias("cur"))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def chunked(documents: DataFrame, size: int = SIZE, overlap: int = 0, text: str = "text", long_text: int = 10_000) -> DataFrame:
    """Documents as chunks: (chunk_index, content) replace the text.

    Texts beyond ``long_text`` characters are folded by line, others by sentence.
    Null and blank texts have no chunks.
    """
    short = F.length(text) <= long_text
    lines = F.filter(F.split(F.col(text), r"\n+"), lambda s: F.trim(s) != "")
    parts = F.when(short, sentences(F.col(text))).otherwise(lines)
    given = documents.where(F.col(text).isNotNull() & (F.regexp_replace(F.col(text), r"\s+", "") != ""))
    return given.select(*[c for c in documents.columns if c != text], F.posexplode(folded(parts, size, overlap=overlap)).alias("chunk_index", "content"))


def windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters that share ``overlap`` with the next one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.struct(s.alias("start_char"), F.substring(text, s + 1, F.lit(size)).alias("content"))))


def snapped_windows(documents: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, start_char, content) of windows that break at a space where one lies past 70 % of the size."""
    if not 0 <= overlap < size * 0.7:
        raise ValueError("overlap must be smaller than 70 % of size")

    def cut(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for key, value in zip(batch[doc_id], batch[text]):
                at, n = 0, 0
                while value and at < len(value):
                    end = min(len(value), at + size)
                    if end < len(value) and not value[end].isspace():
                        space = value.rfind(" ", at, end)
                        end = space if space > at + 0.7 * size else end
                    rows.append((key, n, at, value[at:end]))
                    n += 1
                    if end >= len(value):
                        break
                    at = end - overlap
            yield pd.DataFrame(rows, columns=[doc_id, "chunk_index", "start_char", "content"])

    kind = dict(documents.dtypes)[doc_id]
    return documents.select(doc_id, text).mapInPandas(cut, f"{doc_id} {kind}, chunk_index int, start_char int, content string")

"""Encoding a corpus with a public byte-level tokenizer.

The rank file is read once per Python worker from a local path (a parameter, never
copied).  Long texts are split where the pre-tokenizer splits them in any case,
between a visible character and the white space after it, so no id changes.
Decoding joins the raw bytes of the ids, so any text comes back byte for byte.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Folder of the public tokenizers' files on every worker.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
#: Texts beyond this many characters are encoded piece by piece.
PIECE_CHARS = 100_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoding of a local rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut only before a space or line end that follows a visible character."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(path: str, text: str | None) -> list[int]:
    """Ids of one text; null and empty texts have none."""
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def token_ids(text: Column, path: str | None = None) -> Column:
    """Ids of a text column as array<int>; an empty array for null and empty texts."""
    path = path or rank_file()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([encode_text(path, t) for t in texts], dtype=object)

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of ids of a text column; 0 for null and empty texts."""
    path = path or rank_file()

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([len(encode_text(path, t)) for t in texts], dtype="int64")

    return count(text)


def token_text(ids: Column, path: str | None = None) -> Column:
    """The text of an id column: the raw bytes of its ids, joined, then read as UTF-8 once; null for null."""
    path = path or rank_file()

    @F.pandas_udf(T.StringType())
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            enc = encoder(path)
            yield pd.Series([None if r is None else enc.decode_bytes(list(map(int, r))).decode("utf-8", "replace") for r in rows], dtype=object)

    return texts(ids)


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document; repeated rows stay, null and empty texts get an empty array."""
    return documents.select("doc_id", token_ids(F.col("text"), path).alias("ids"))

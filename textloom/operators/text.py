"""Text statistics, phrases, entities, and the ingestion pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions import text as fx
from textloom.functions.once import computed_once
from textloom.operators.chunking import chunked

#: Supported file types, and media types of names without an extension.
FILE_TYPES = ("pdf", "docx", "doc", "txt", "md", "html", "csv", "xlsx", "json", "xml")
EMBED_DIM = 64


def file_type(filename: Column, declared: Column) -> Column:
    """The name's extension if supported, else the declared type without dot, else txt."""
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    given = F.lower(F.regexp_replace(F.trim(declared), r"^\.", ""))
    return F.when(ext.isin(*FILE_TYPES), ext).when(given.isin(*FILE_TYPES), given).otherwise(F.lit("txt"))


def key_phrases(documents: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, n, phrase, uses, rank): the k/2 most frequent pairs and triples of words of each document.

    Ties go to the phrase that comes first in the text.
    """
    tokens = documents.where("text is not null").select("doc_id", fx.words(F.col("text")).alias("w"))

    def grams(n: int) -> DataFrame:
        at = F.sequence(F.lit(0), F.size("w") - n)
        phrases = F.transform(at, lambda i: F.concat_ws(" ", *[F.col("w")[i + j] for j in range(n)]))
        long = tokens.where(F.size("w") >= n).select("doc_id", F.posexplode(phrases).alias("pos", "phrase"))
        return long.groupBy("doc_id", "phrase").agg(F.count("*").alias("uses"), F.min("pos").alias("first")).withColumn("n", F.lit(n))

    both = grams(2).unionByName(grams(3))
    order = Window.partitionBy("doc_id", "n").orderBy(F.col("uses").desc(), "first")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k // 2).select("doc_id", "n", "phrase", "uses", "rank")


# fixed values: patterns of the entity extractor
ENTITY_PATTERNS = {
    "dates": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "numbers": r"[0-9]+(?:\.[0-9]+)?",
    "urls": r"https?://[^\s<>()]+",
    "emails": fx.PII_PATTERNS["email"],
    "capitalised": r"\p{Lu}\p{Ll}{2,}",
}


def entities(text: Column) -> dict[str, Column]:
    """Arrays of the entities of a text: at most 20 numbers, 30 different capitalised words in alphabetical order, all others."""
    found = {name: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for name, p in ENTITY_PATTERNS.items()}
    found["numbers"] = F.slice(found["numbers"], 1, 20)
    found["capitalised"] = F.slice(F.array_sort(F.array_distinct(found["capitalised"])), 1, 30)
    return found


def ingested(documents: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Chunks of documents, redacted, with language and quality, those of at least the threshold.

    Sizes are those of the text before redaction; language and quality are judged after it.
    """
    content = F.col("content")
    clean = computed_once(chunked(documents), chars=F.length(content), words=fx.piece_count(content), contains_pii=fx.has_pii(content), content=fx.redacted(content))
    known = computed_once(clean, language=fx.detected_language(content))
    scored = computed_once(known, quality=fx.quality_score(content, F.col("contains_pii"), F.col("language")))
    return scored.where(F.col("quality") >= threshold)


def hash_vectors(texts: DataFrame, key: str, dim: int = EMBED_DIM) -> DataFrame:
    """(key, vector): unit vectors of word counts in md5 buckets, a deterministic stand-in for an embedding model.

    Every key gets a vector of its own, also where texts repeat; texts without words give no row.
    """
    tokens = texts.select(key, F.explode(fx.words(F.col("text"))).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % dim
    counts = tokens.groupBy(key, bucket.cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    folded = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return folded.select(key, dense.alias("vector"))

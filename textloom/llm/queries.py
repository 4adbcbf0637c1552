"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import code_pairs, encode, encoding_repair, language, main_body, mixture, pii, site_lines
from textloom.session import spread
from textloom.sources.tables import table


def _texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows take long each, over all cores if its file is small."""
    return spread(table(spark, sf, name))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return code_pairs.code_description_pairs(_texts(spark, sf, "code_elements")).select("element_id").distinct()


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return code_pairs.code_description_pairs(_texts(spark, sf, "code_elements"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return site_lines.mark_repeated(table(spark, sf, "web_content"))


def p2_removed(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = site_lines.without_repeated(table(spark, sf, "web_content"))
    return cleaned.select("web_id", F.col("removed_lines").cast("bigint").alias("removed_lines"), F.length("content").cast("bigint").alias("kept_chars"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    spans = pii.find_pii(_texts(spark, sf, "document_chunks"), table(spark, sf, "person_names"))
    return spans.select("chunk_id", "kind", (F.col("start") + 1).cast("int").alias("start_pos")).distinct()


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    done = pii.redact(_texts(spark, sf, "document_chunks"), table(spark, sf, "person_names"))
    return done.select("chunk_id", "content", "contains_pii")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pages = _texts(spark, sf, "web_content").where("content is not null and raw_html is not null")
    marked = main_body.mark_furniture(pages.select("web_id", "content", "raw_html", "title"))
    return marked.select("web_id", F.explode("furniture_lines").alias("line_no")).distinct()


def p4_body(spark: SparkSession, sf: str) -> DataFrame:
    return main_body.main_body(_texts(spark, sf, "web_content"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_texts(spark, sf, "web_content"), _texts(spark, sf, "document_chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.mislabelled(_judged(spark, sf)).distinct()


def p5_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("tab", "rec_id", "lang", F.round("confidence", 3).alias("confidence"), F.size("lines").alias("other_lines"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(_texts(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ids = _texts(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("ids", encode.token_ids(F.col("text")))
    back = ids.withColumn("back", encode.token_text(F.col("ids")))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("tokens"), (F.col("back") == F.col("text")).alias("same"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.share_report(_texts(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_marginals(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.marginal_report(_texts(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix_sources(_texts(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = _texts(spark, sf, "documents").select("doc_id", "text")
    return encoding_repair.repair_encoding(docs).where("repaired.garbled").select("doc_id").distinct()


def p8_repaired(spark: SparkSession, sf: str) -> DataFrame:
    docs = _texts(spark, sf, "documents").select("doc_id", "text")
    fixed = encoding_repair.repair_encoding(docs).where("repaired.garbled")
    return fixed.select("doc_id", F.col("repaired.text").alias("text"), F.col("repaired.steps").alias("steps"))


def queries() -> dict:
    names = (p1_found, p1_pairs, p2_found, p2_removed, p3_found, p3_redacted, p4_found, p4_body, p5_found, p5_documents, p6_ids, p6_roundtrip, p7_shares, p7_marginals, p7_mixture, p8_found, p8_repaired)
    return {f.__name__: f for f in names}

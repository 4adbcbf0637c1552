"""Queries over stored records: replies, prompts, knowledge records, metadata, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators import ranking, replies, store
from textloom.plans import search, sql
from textloom.sources.tables import table


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", "received_at", "role", "text")


def reply_clean(spark, sf):
    cleaned = replies.cleaned_reply(F.concat(F.lit("<|assistant|> "), F.coalesce("role", F.lit("")), F.lit(": "), "text"))
    return _replies(spark, sf).select("conv_id", "turn", "received_at", F.md5(cleaned).alias("digest"))


def follow_up_questions(spark, sf):
    rows = _replies(spark, sf).select("conv_id", "turn", "received_at", replies.follow_ups(F.col("text")).alias("asked")).where(F.size("asked") > 0)
    return rows.select("conv_id", "turn", "received_at", F.size("asked").cast("bigint").alias("questions"), F.get("asked", F.lit(0)).alias("first"))


def scoring_prompts(spark, sf, questions=search._queries):
    """Prompts for the twenty best documents of each question."""
    docs, asked = search._documents(spark, sf), questions(spark, sf)
    listed = ranking.top_k(ranking.bm25(docs, asked), 20).join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(asked, "qid")
    return listed.select("qid", "doc_id", F.md5(replies.scoring_prompt(F.col("text"), F.col("doc_text"))).alias("digest"))


def context_summary(spark, sf, questions=search._queries):
    """The two best documents of each question, as title and start of text."""
    docs, asked = search._documents(spark, sf), questions(spark, sf)
    titles = table(spark, sf, "documents").select("doc_id", "title", F.col("text").alias("doc_text"))
    listed = ranking.top_k(ranking.bm25(docs, asked), 2).join(titles, "doc_id")
    line = F.concat(F.coalesce("title", F.lit("untitled")), F.lit(": "), F.substring("doc_text", 1, 75))
    rows = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return rows.select("qid", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("summary"))


def knowledge_records(spark, sf):
    pages = table(spark, sf, "web_content").where("title is not null").select("web_id", "title", "content", "url", F.col("publish_date").alias("date"))
    named = store.knowledge_records(pages.select("title", F.concat_ws("\n", F.col("web_id").cast("string"), "content").alias("content"), "url", "date"))
    return named.select("name", F.length("markdown").cast("bigint").alias("chars"), F.md5("markdown").alias("digest"))


def metadata_pages(spark, sf):
    """Page counts inside the JSON metadata of uploads, by file type."""
    rows = table(spark, sf, "processing_results").select("file_type", F.get_json_object("metadata", "$.pages").cast("bigint").alias("pages"))
    return rows.groupBy("file_type").agg(F.count("*").alias("files"), F.count("pages").alias("with_pages"), F.sum("pages").alias("pages"))


def delete_preview(spark, sf):
    """Chunks each user keeps when every fiftieth document is deleted."""
    chunks = table(spark, sf, "document_chunks").select("user_id", "document_id", "chunk_id")
    doomed = table(spark, sf, "processing_results").where(F.substring("document_id", 5, 20).cast("bigint") % 50 == 0).select("document_id")
    return chunks.join(doomed, "document_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


def upload_status(spark, sf):
    """Progress of each day's uploads: files, failures, chunks promised and chunks stored."""
    files = table(spark, sf, "processing_results").select("document_id", F.to_date("uploaded_at").alias("day"), "total_chunks", (F.size("errors") > 0).cast("int").alias("failed"))
    stored = table(spark, sf, "document_chunks").groupBy("document_id").agg(F.countDistinct("chunk_index").alias("stored"))
    joined = files.join(stored, "document_id", "left")
    return joined.groupBy("day").agg(
        F.count("*").alias("files"), F.sum("failed").alias("failed"), F.sum("total_chunks").alias("promised"), F.sum(F.coalesce("stored", F.lit(0))).alias("stored"), F.sum((F.coalesce("stored", F.lit(0)) < F.col("total_chunks")).cast("int")).alias("short")
    )


def namespaces(spark, sf):
    return table(spark, sf, "documents").where("namespace is not null").groupBy("namespace").agg(F.count("*").alias("documents"), F.countDistinct("user_id").alias("users"))


QUERIES = {f.__name__: f for f in (reply_clean, follow_up_questions, scoring_prompts, context_summary, knowledge_records, metadata_pages, delete_preview, upload_status, namespaces)}

_QUESTIONS = r"""[q for q in [regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^(?:[-*•]|[0-9]+[.)])\s*', '') for x in string_split(regexp_replace(regexp_replace(text, '\?\s+', '?' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))] if length(q) > 10 AND ends_with(q, '?')]"""
_ECHOED = "'<|assistant|> ' || coalesce(role, '') || ': ' || text"
_UNTAGGED = sql.strip(rf"regexp_replace({_ECHOED}, '<\|[A-Za-z_]+\|>|</?s>', '', 'g')")
_UNROLED = rf"regexp_replace({_UNTAGGED}, '^(?:[Aa]ssistant|[Aa]nswer|[Bb]ot)\s*:\s*', '')"
SQL = {
    "reply_clean": f"SELECT conv_id, turn, received_at, md5({sql.strip(_UNROLED)}) AS digest FROM conversations WHERE text IS NOT NULL",
    "follow_up_questions": f"""SELECT conv_id, turn, received_at, len(asked) AS questions, asked[1] AS first FROM (SELECT conv_id, turn, received_at, list_slice({_QUESTIONS}, 1, 3) AS asked FROM conversations WHERE text IS NOT NULL) WHERE len(asked) > 0""",
    "scoring_prompts": f"""WITH {search._BASE}, r AS ({search._top('bm', 20)})
        SELECT qid, doc_id, md5('Rate from 0 to 10 how well the document answers the question.' || chr(10) || 'Question: ' || q.text || chr(10) || 'Document: ' || CASE WHEN length(t.text) > 500 THEN substr(t.text, 1, 500) || '...' ELSE t.text END || chr(10) || 'Score:') AS digest
        FROM r JOIN documents t USING (doc_id) JOIN q USING (qid)""",
    "context_summary": f"""WITH {search._BASE}, r AS ({search._top('bm', 2)})
        SELECT qid, string_agg(coalesce(title, 'untitled') || ': ' || substr(text, 1, 75), chr(10) ORDER BY rank) AS summary FROM r JOIN documents USING (doc_id) GROUP BY qid""",
    "knowledge_records": r"""WITH t AS (SELECT substr(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS name,
          concat_ws(chr(10) || chr(10), '# ' || title, concat_ws(chr(10), CAST(web_id AS VARCHAR), content), 'Source: ' || url, 'Date: ' || strftime(publish_date, '%Y-%m-%d')) AS markdown FROM web_content WHERE title IS NOT NULL)
        SELECT name, length(markdown) AS chars, md5(markdown) AS digest FROM t""",
    "metadata_pages": "SELECT file_type, count(*) AS files, count(json_extract(metadata, '$.pages')) AS with_pages, CAST(sum(CAST(json_extract(metadata, '$.pages') AS BIGINT)) AS BIGINT) AS pages FROM processing_results GROUP BY file_type",
    "delete_preview": """SELECT user_id, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM document_chunks
        WHERE document_id NOT IN (SELECT document_id FROM processing_results WHERE CAST(substr(document_id, 5) AS BIGINT) % 50 = 0) GROUP BY user_id""",
    "upload_status": """WITH s AS (SELECT document_id, count(DISTINCT chunk_index) AS stored FROM document_chunks GROUP BY document_id)
        SELECT CAST(uploaded_at AS DATE) AS day, count(*) AS files, count(*) FILTER (len(errors) > 0) AS failed, CAST(sum(total_chunks) AS BIGINT) AS promised, CAST(sum(coalesce(stored, 0)) AS BIGINT) AS stored,
        count(*) FILTER (coalesce(stored, 0) < total_chunks) AS short FROM processing_results LEFT JOIN s USING (document_id) GROUP BY 1""",
    "namespaces": "SELECT namespace, count(*) AS documents, count(DISTINCT user_id) AS users FROM documents WHERE namespace IS NOT NULL GROUP BY namespace",
}

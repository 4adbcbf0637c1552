"""The searches for every asking row: each row whose id is divisible by 50 gets its rows.

The queries of ``search`` and its like score one question for each different title
and leave out untitled rows.  ``X_each`` scores one question for each different
title or, where there is none, text, and joins the small table of who asks what
to the result, so work grows with the different questions and no row is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.plans import answers, rag, records, search, text, web
from textloom.sources.tables import table


def _asking(spark: SparkSession, sf: str, name: str, key: str, body: str) -> DataFrame:
    """(asker, qid, text): each asking row, its question, and the smallest id that asks the same.

    An untitled row asks with its text, one without either asks an empty text.
    """
    rows = table(spark, sf, name).where(F.col(key) % 50 == 0)
    asked = rows.select(F.col(key).alias("asker"), F.col("title").isNull().alias("untitled"), F.coalesce("title", body, F.lit("")).alias("text"))
    first = asked.groupBy("untitled", "text").agg(F.min("asker").alias("qid"))
    return asked.join(first, ["untitled", "text"]).select("asker", "qid", "text")


def _each(query, name: str, key: str, body: str):
    def each(spark: SparkSession, sf: str) -> DataFrame:
        """Rows of the query for every asking row; one whose question finds nothing has nulls."""

        def questions(spark: SparkSession, sf: str) -> DataFrame:
            return _asking(spark, sf, name, key, body).where("asker = qid").select("qid", "text")

        members = _asking(spark, sf, name, key, body).select("asker", "qid")
        return members.join(query(spark, sf, questions), "qid", "left")

    each.__name__ = f"{query.__name__}_each"
    return each


def _each_sql(statement: str, name: str, key: str, body: str) -> str:
    """The SQL twin of a query with the questions of all asking rows, joined to those rows."""
    titles = f"q AS (SELECT min({key}) AS qid, title AS text FROM {name} WHERE {key} % 50 = 0 AND title IS NOT NULL GROUP BY title)"
    if titles not in statement:
        raise ValueError("the statement has no such questions")
    found = statement.replace(titles, "q AS (SELECT qid, text FROM asking WHERE asker = qid)")
    return f"""WITH asking AS (SELECT {key} AS asker, coalesce(title, {body}, '') AS text, min({key}) OVER (PARTITION BY title IS NULL, coalesce(title, {body}, '')) AS qid FROM {name} WHERE {key} % 50 = 0),
        found AS ({found}) SELECT asker, asking.qid, found.* EXCLUDE (qid) FROM asking LEFT JOIN found ON asking.qid = found.qid"""


_DOCUMENTS = (
    (search, ("bm25_topk", "tfidf_topk", "bm25_with_prior", "tfidf_with_prior", "bm25_with_any_prior", "tfidf_with_any_prior", "hybrid_topk", "hybrid_diverse", "pairwise_tournament", "rerank_method_choice", "rerank_cache_key")),
    (text, ("hash_embed_search",)),
    (rag, ("context_budget", "rag_sources", "rag_prompt", "rag_confidence", "hybrid_mode_union")),
    (records, ("scoring_prompts", "context_summary")),
    (answers, ("pairwise_prompts", "reply_rerank", "reply_rerank_tops", "cited_context")),
)
_OVER = [(group, name, ("documents", "doc_id", "text")) for group, names in _DOCUMENTS for name in names] + [(web, "page_rerank", ("web_content", "web_id", "content"))]

QUERIES = {f"{name}_each": _each(group.QUERIES[name], *over) for group, name, over in _OVER}

SQL = {f"{name}_each": _each_sql(group.SQL[name], *over) for group, name, over in _OVER}

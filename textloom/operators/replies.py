"""Prompts for scoring and what comes back: cleaning, follow-up questions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import clipped, stripped
from textloom.operators.ranking import by_top, parsed_score

#: Documents of a question that a model scores; the others keep their order behind them.
SCORED = 20


def scoring_prompt(query: Column, document: Column, chars: int = 500) -> Column:
    """Question and document for a relevance score, the document cut to ``chars``."""
    return F.concat(F.lit("Rate from 0 to 10 how well the document answers the question.\nQuestion: "), query, F.lit("\nDocument: "), clipped(document, chars), F.lit("\nScore:"))


def cleaned_reply(reply: Column, prompt: Column | None = None) -> Column:
    """A reply without an echoed prompt, special tokens and a leading role word."""
    text = reply if prompt is None else F.when(F.startswith(reply, prompt), F.substr(reply, F.length(prompt) + 1)).otherwise(reply)
    text = F.regexp_replace(text, r"<\|[A-Za-z_]+\|>|</?s>", "")
    return stripped(F.regexp_replace(stripped(text), r"^(?:[Aa]ssistant|[Aa]nswer|[Bb]ot)\s*:\s*", ""))


def follow_ups(reply: Column, n: int = 3) -> Column:
    """At most ``n`` questions of a reply: pieces without bullet of more than ten characters that end in a question mark."""
    lines = F.split(reply, r"\n+|(?<=\?)\s+")
    bare = F.transform(lines, lambda x: F.regexp_replace(stripped(x), r"^(?:[-*•]|[0-9]+[.)])\s*", ""))
    return F.slice(F.filter(bare, lambda x: (F.length(x) > 10) & F.endswith(x, F.lit("?"))), 1, n)


def pairwise_prompt(query: Column, first: Column, second: Column, chars: int = 300) -> Column:
    """Question and two documents for a choice of A or B, both cut to ``chars``."""
    parts = [F.lit("Which document answers the question better?\nQuestion: "), query, F.lit("\nDocument A: "), clipped(first, chars), F.lit("\nDocument B: "), clipped(second, chars)]
    return F.concat(*parts, F.lit("\nAnswer A or B:"))


def tagged_prompt(prompt: Column) -> Column:
    """A prompt as a turn of the user; one that has role tags already stays as it is."""
    return F.when(prompt.rlike(r"<\|(?:user|assistant|system)\|>"), prompt).otherwise(F.concat(F.lit("<|user|> "), prompt, F.lit("\n<|assistant|>")))


def mixed_with_replies(ranked: DataFrame, replies: DataFrame, scored: int = SCORED) -> DataFrame:
    """(qid, doc_id, rank, score): the first ``scored`` rows by 0.7 of the reply's score and 0.3 of their own, the rest behind in their order.

    ``ranked`` has qid, doc_id, rank and score, ``replies`` qid, doc_id and reply, at
    most one for each; a missing or unreadable reply counts as 0.5.  Ties keep their order.
    """
    both = ranked.join(replies, ["qid", "doc_id"], "left").withColumn("late", F.col("rank") > scored)
    mixed = both.withColumn("score", F.when(F.col("late"), F.col("score")).otherwise(0.7 * parsed_score(F.col("reply")) + 0.3 * F.col("score")))
    order = Window.partitionBy("qid").orderBy("late", F.when(~F.col("late"), F.round("score", 9)).desc_nulls_last(), "rank")
    return mixed.select("qid", "doc_id", F.row_number().over(order).alias("rank"), "score")


def mixed_over_tops(ranked: DataFrame, replies: DataFrame, scored: int = SCORED) -> DataFrame:
    """The same in one list: rows beyond ``scored`` have 0 from the reply, and both parts count over the largest of the question."""
    both = ranked.join(replies, ["qid", "doc_id"], "left").withColumn("told", F.when(F.col("rank") <= scored, parsed_score(F.col("reply"))).otherwise(0.0))
    mixed = 0.7 * F.coalesce(by_top(F.col("told")), F.lit(0.0)) + 0.3 * F.coalesce(by_top(F.col("score")), F.lit(0.0))
    rows = both.select("qid", "doc_id", F.col("rank").alias("old"), mixed.alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "old"))).drop("old")


def cited_context(ranked: DataFrame, budget: int = 6000, docs: int = 5) -> DataFrame:
    """(qid, cited, context): numbered excerpts of the best documents; each may fill its share of the budget, the first overflow ends the list.

    ``ranked`` has qid, rank, source, title and text; null texts count as empty.  No
    share is above the budget, so texts are cut to it before they are shuffled.
    """
    cut = ranked.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, budget))
    listed = cut.where(F.col("rank") <= docs).withColumn("share", (F.lit(budget) / F.count("*").over(Window.partitionBy("qid"))).cast("int"))
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("source", F.lit("unknown")), F.lit(" - "), F.coalesce("title", F.lit("untitled")), F.lit("]"))
    parts = listed.withColumn("head", head).withColumn("body", F.substr("text", F.lit(1), F.col("share")))
    upto = F.sum(F.length("head") + F.length("body")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = parts.withColumn("upto", upto).where(F.col("upto") <= budget)
    part = F.struct("rank", F.concat("head", F.lit("\n"), "body").alias("part"))
    return kept.groupBy("qid").agg(F.count("*").alias("cited"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n---\n").alias("context"))


def joint_confidence(rows: DataFrame, key: str, confidence: str) -> DataFrame:
    """(key, answers, confidence): the mean over the rows that have one, 0.1 more for each further row up to 0.2, at most 1; 0 without any."""
    n = F.count(confidence)
    return rows.groupBy(key).agg(n.alias("answers"), F.when(n > 0, F.least(F.lit(1.0), F.avg(confidence) + F.least(F.lit(0.2), (n - 1) * 0.1))).otherwise(0.0).alias("confidence"))

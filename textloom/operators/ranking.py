"""Lexical ranking, fusion, diversity and pairwise comparison.

Shapes: ``documents`` has an id, a text and whatever else; ``queries`` has qid and
text.  Results are long: one row for each query and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.once import computed_once
from textloom.functions.text import words
from textloom.session import checkpointed

K1, B = 1.5, 0.75


def postings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dl, tokens): each document's words and their number; null text has none."""
    given = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    return computed_once(given, tokens=tokens).select("doc_id", "tokens", F.size("tokens").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf): words of each query with the number of times it has them."""
    return queries.select("qid", F.explode(words(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def matches(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, dl, term, qtf, tf, df, n_docs, avgdl) of each query word a document has.

    Texts are read and split once: a document leaves one row for each different
    query word it has, and one without a word that carries its length for the
    totals.  These rows are written, and document frequencies, totals and scores
    come from them.
    """
    terms = query_terms(queries)
    vocabulary = terms.select("term").distinct()
    docs = postings(documents).select("doc_id", "dl", F.explode(F.array_append("tokens", F.lit(None).cast("string"))).alias("term"))
    known = vocabulary.withColumn("asked", F.lit(True))
    rows = docs.join(known, "term", "left").where("asked or term is null").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    rows = checkpointed(documents.sparkSession, rows)
    totals = rows.where("term is null and dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = rows.where("term is not null")
    weighted = terms.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(F.broadcast(totals))  # totals: one row
    return tf.join(weighted, "term")


def bm25_scores(matched: DataFrame) -> DataFrame:
    """(qid, doc_id, score), Okapi weights with idf ln((N - df + 0.5) / (df + 0.5)), negative for common words."""
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return matched.groupBy("qid", "doc_id").agg(F.sum(weight).alias("score"))


def tfidf_scores(matched: DataFrame) -> DataFrame:
    """(qid, doc_id, score) with tf / length times ln(N / (df + 1))."""
    weight = F.col("qtf") * F.col("tf") / F.col("dl") * F.log(F.col("n_docs") / (F.col("df") + 1))
    return matched.groupBy("qid", "doc_id").agg(F.sum(weight).alias("score"))


def bm25(documents: DataFrame, queries: DataFrame) -> DataFrame:
    return bm25_scores(matches(documents, queries))


def tfidf(documents: DataFrame, queries: DataFrame) -> DataFrame:
    return tfidf_scores(matches(documents, queries))


def hybrid(documents: DataFrame, queries: DataFrame, bm25_weight: float = 0.6, tfidf_weight: float = 0.4) -> DataFrame:
    """Both scorers over one set of matches, each over its top, summed by document."""
    matched = matches(documents, queries)
    return fused(bm25_scores(matched), tfidf_scores(matched), bm25_weight, tfidf_weight)


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "qid", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each key with their rank from 1; ties at 9 places go to the smaller id."""
    order = Window.partitionBy(key).orderBy(F.round(F.col(score), 9).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_top(score: Column, key: str = "qid") -> Column:
    """A score over the largest of its query; null where that is 0."""
    return score / F.nullif(F.max(score).over(Window.partitionBy(key)), F.lit(0.0))


def fused(left: DataFrame, right: DataFrame, left_weight: float, right_weight: float) -> DataFrame:
    """(qid, doc_id, score): weighted sum of two scorers' scores over their tops, paired by document.

    A document one scorer lacks has 0 there; a scorer whose best is 0 counts as 0.
    """
    a = left.select("qid", "doc_id", by_top(F.col("score")).alias("a"))
    b = right.select("qid", "doc_id", by_top(F.col("score")).alias("b"))
    both = a.join(b, ["qid", "doc_id"], "full")
    return both.select("qid", "doc_id", (left_weight * F.coalesce("a", F.lit(0.0)) + right_weight * F.coalesce("b", F.lit(0.0))).alias("score"))


def with_prior(scored: DataFrame, prior: DataFrame, score_weight: float, prior_weight: float, missing: float = 0.0) -> DataFrame:
    """Scores mixed with a prior (doc_id, prior), both over the largest of the query; all-zero scores leave the prior alone.

    Every scored document stays; one without a prior, or with a null one, has ``missing``.
    """
    both = scored.join(prior, "doc_id", "left").withColumn("prior", F.coalesce("prior", F.lit(missing)))
    mixed = F.coalesce(score_weight * by_top(F.col("score")), F.lit(0.0)) + F.coalesce(prior_weight * by_top(F.col("prior")), F.lit(0.0))
    return both.select("qid", "doc_id", mixed.alias("score"))


def diversified(ranked: DataFrame, tokens: DataFrame, threshold: float = 0.5, penalty: float = 0.1) -> DataFrame:
    """Lower the score of documents much like one ranked above them in the same query.

    For every earlier document with Jaccard similarity above the threshold the
    score is multiplied by 1 - penalty * similarity.  ``ranked`` holds a bounded
    list for each query (qid, doc_id, rank, score), so pairs are bounded too.
    """
    listed = ranked.join(tokens.select("doc_id", F.array_distinct("tokens").alias("set")), "doc_id")
    early = listed.select("qid", F.col("rank").alias("early_rank"), F.col("set").alias("early_set"))
    pairs = listed.join(early, "qid").where("early_rank < rank")
    alike = F.size(F.array_intersect("set", "early_set")) / F.size(F.array_union("set", "early_set"))
    factor = F.when(alike > threshold, F.log(1 - penalty * alike)).otherwise(0.0)
    lowered = pairs.groupBy("qid", "doc_id").agg(F.sum(factor).alias("log_factor"))
    kept = ranked.join(lowered, ["qid", "doc_id"], "left")
    return kept.withColumn("diverse_score", F.col("score") * F.exp(F.coalesce("log_factor", F.lit(0.0)))).drop("log_factor")


def tournament(ranked: DataFrame, better: Column) -> DataFrame:
    """(qid, doc_id, wins, score) of all pairs of a bounded list; ``better`` compares columns a_* and b_* and is 1, -1 or 0.

    A win is one point, a tie none; scores are wins over the most wins of the query.
    """
    a = ranked.select("qid", *[F.col(c).alias(f"a_{c}") for c in ranked.columns if c != "qid"])
    b = ranked.select("qid", *[F.col(c).alias(f"b_{c}") for c in ranked.columns if c != "qid"])
    pairs = a.join(b, "qid").where("a_rank < b_rank").withColumn("result", better)
    points = pairs.select(
        "qid", F.explode(F.array(F.struct(F.col("a_doc_id").alias("doc_id"), (F.col("result") > 0).cast("bigint").alias("won")), F.struct(F.col("b_doc_id").alias("doc_id"), (F.col("result") < 0).cast("bigint").alias("won")))).alias("p")
    )
    wins = points.groupBy("qid", F.col("p.doc_id").alias("doc_id")).agg(F.sum("p.won").alias("wins"))
    most = F.max("wins").over(Window.partitionBy("qid"))
    return wins.withColumn("score", F.when(most > 0, F.col("wins") / most).otherwise(0.0))


def parsed_score(reply: Column) -> Column:
    """A score in a model's reply: first number (over 10 as per cent, over 1 as of ten), else a keyword ladder, else 0.5."""
    number = F.regexp_extract(reply, r"([0-9]+(?:\.[0-9]+)?)", 1)
    value = F.nullif(number, F.lit("")).cast("double")
    scaled = F.when(value > 10, value / 100).when(value > 1, value / 10).otherwise(value)
    low = F.lower(reply)
    ladder = (
        F.when(low.contains("excellent"), 0.9).when(low.contains("not relevant") | low.contains("irrelevant"), 0.1).when(low.contains("highly"), 0.9)
        .when(low.contains("somewhat"), 0.5).when(low.contains("slightly"), 0.3).when(low.contains("relevant"), 0.7)
    )
    return F.coalesce(F.when(scaled.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))), ladder, F.lit(0.5))


def parsed_winner(reply: Column) -> Column:
    """1 if a reply names only A, -1 if only B or it starts with it, 0 for a tie."""
    low = F.lower(F.trim(reply))
    a, b = low.contains("document a"), low.contains("document b")
    return F.when(a & ~b, 1).when(b & ~a, -1).when(low.startswith("a"), 1).when(low.startswith("b"), -1).otherwise(0)

"""Ranking queries: titles of every fiftieth document ask, all documents answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.operators import best, ranking
from textloom.plans import sql
from textloom.session import spread
from textloom.sources.tables import table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source", "user_id"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, text): each different title of the documents whose id is divisible by 50, under the smallest id."""
    titles = table(spark, sf, "documents").where("doc_id % 50 = 0 and title is not null")
    return titles.groupBy(F.col("title").alias("text")).agg(F.min("doc_id").alias("qid")).select("qid", "text")


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("prior"))


def _out(ranked: DataFrame, score: str = "score") -> DataFrame:
    return ranked.select("qid", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round(score, 6).alias("score"))


def bm25_topk(spark, sf, questions=_queries):
    return _out(ranking.top_k(ranking.bm25(_documents(spark, sf), questions(spark, sf)), 5))


def tfidf_topk(spark, sf, questions=_queries):
    return _out(best.best(_documents(spark, sf), questions(spark, sf), 5, "tfidf"))


def bm25_with_prior(spark, sf, questions=_queries):
    """Among documents that have a label, as the SQL twin has it; ``bm25_with_any_prior`` ranks them all."""
    prior = _prior(spark, sf)
    scored = ranking.bm25(_documents(spark, sf), questions(spark, sf)).join(prior, "doc_id", "left_semi")
    return _out(ranking.top_k(ranking.with_prior(scored, prior, 0.7, 0.3), 5))


def tfidf_with_prior(spark, sf, questions=_queries):
    """Among documents that have a label, as the SQL twin has it; ``tfidf_with_any_prior`` ranks them all."""
    prior = _prior(spark, sf)
    scored = ranking.tfidf(_documents(spark, sf), questions(spark, sf)).join(prior, "doc_id", "left_semi")
    return _out(ranking.top_k(ranking.with_prior(scored, prior, 0.6, 0.4), 5))


def bm25_with_any_prior(spark, sf, questions=_queries):
    """Among all documents; one without a label has a prior of 0."""
    return _out(best.best_with_prior(_documents(spark, sf), questions(spark, sf), _prior(spark, sf), 5, 0.7, 0.3))


def tfidf_with_any_prior(spark, sf, questions=_queries):
    """Among all documents; one without a label has a prior of 0."""
    scored = ranking.tfidf(_documents(spark, sf), questions(spark, sf))
    return _out(ranking.top_k(ranking.with_prior(scored, _prior(spark, sf), 0.6, 0.4), 5))


def _hybrid(spark, sf, questions=_queries):
    return ranking.hybrid(_documents(spark, sf), questions(spark, sf))


def hybrid_topk(spark, sf, questions=_queries):
    return _out(ranking.top_k(_hybrid(spark, sf, questions), 5))


def hybrid_diverse(spark, sf, questions=_queries):
    ranked = ranking.top_k(_hybrid(spark, sf, questions), 20)
    listed = ranked.select("doc_id").distinct()
    tokens = ranking.postings(_documents(spark, sf).join(listed, "doc_id", "left_semi"))
    diverse = ranking.diversified(ranked, tokens)
    again = ranking.top_k(diverse.withColumnRenamed("rank", "old_rank"), 5, "diverse_score")
    return again.select("qid", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("diverse_score", 6).alias("score"))


def pairwise_tournament(spark, sf, questions=_queries):
    """The ten best by BM25 meet in pairs; the longer document with at least the same score at two places wins."""
    ranked = ranking.top_k(ranking.bm25(_documents(spark, sf), questions(spark, sf)), 10)
    sized = ranked.join(_documents(spark, sf).select("doc_id", F.length("text").alias("size")), "doc_id")
    better = F.signum(F.round(F.col("a_score"), 2) - F.round(F.col("b_score"), 2)) * 2 + F.signum(F.col("a_size") - F.col("b_size"))
    won = ranking.tournament(sized.select("qid", "doc_id", "rank", "score", "size"), F.signum(better))
    return won.select("qid", "doc_id", "wins", F.round("score", 6).alias("score"))


def similarity_rerank(spark, sf):
    """Documents of each source by their label, missing ones as 1.0, in stable order."""
    scored = _documents(spark, sf).join(_prior(spark, sf), "doc_id", "left").select(F.coalesce("source", F.lit("?")).alias("qid"), "doc_id", F.coalesce("prior", F.lit(1.0)).alias("score"))
    return ranking.top_k(scored, 10).select("qid", "doc_id", F.col("rank").cast("bigint").alias("rank"), "score")


def rerank_method_choice(spark, sf, questions=_queries):
    """How many candidates a query has decides how they are reranked."""
    n = ranking.matches(_documents(spark, sf), questions(spark, sf)).groupBy("qid").agg(F.countDistinct("doc_id").alias("candidates"))
    asked = questions(spark, sf).join(n, "qid", "left").select("qid", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.size(ranking.words(F.col("text"))).alias("terms"))
    complex_query = F.col("terms") > 3
    method = (
        F.when(F.col("candidates") <= 5, F.when(complex_query, "pairwise").otherwise("bm25"))
        .when(F.col("candidates") <= 20, F.when(complex_query, "hybrid").otherwise("bm25"))
        .otherwise(F.when(complex_query, "hybrid").otherwise("bm25"))
    )
    return asked.select("qid", "candidates", method.alias("method"))


def _replies(spark, sf):
    return table(spark, sf, "conversations").where("text is not null and lower(role) = 'assistant'")


def score_parse(spark, sf):
    """The score an assistant's reply states, and its winner."""
    replies = _replies(spark, sf)
    return replies.select("conv_id", "turn", F.round(ranking.parsed_score(F.col("text")), 6).alias("score"), ranking.parsed_winner(F.col("text")).alias("winner"))


def rerank_cache_key(spark, sf, questions=_queries):
    """One key for a query and its five best documents, whatever their order."""
    ranked = best.best(_documents(spark, sf), questions(spark, sf), 5)
    listed = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("ids"))
    return listed.select("qid", F.md5(F.concat_ws("|", F.col("qid").cast("string"), F.concat_ws(",", "ids"), F.lit("bm25"))).alias("key"))


_BASE = f"""
q AS (SELECT min(doc_id) AS qid, title AS text FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL GROUP BY title),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({sql.words('text')}) AS term FROM q) GROUP BY qid, term),
d AS (SELECT doc_id, tokens, len(tokens) AS dl FROM (SELECT doc_id, {sql.words('text')} AS tokens FROM documents WHERE text IS NOT NULL) WHERE len(tokens) > 0),
n AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT qid, doc_id, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN n GROUP BY qid, doc_id),
ti AS (SELECT qid, doc_id, sum(qtf * CAST(tf AS DOUBLE) / dl * ln(n_docs / (df + 1))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN n GROUP BY qid, doc_id),
prior AS (SELECT doc_id, CAST(max(quality) AS DOUBLE) AS prior FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
hy AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, 0.6 * coalesce(a.s, 0) + 0.4 * coalesce(b.s, 0) AS score
       FROM (SELECT qid, doc_id, score / nullif(max(score) OVER (PARTITION BY qid), 0) AS s FROM bm) a
       FULL JOIN (SELECT qid, doc_id, score / nullif(max(score) OVER (PARTITION BY qid), 0) AS s FROM ti) b ON a.qid = b.qid AND a.doc_id = b.doc_id)
"""


def _top(source: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k}"


def _topk_sql(source: str) -> str:
    return f"WITH {_BASE}, r AS ({_top(source, 5)}) SELECT qid, doc_id, rank, round(score, 6) AS score FROM r"


def _prior_sql(source: str, a: float, b: float) -> str:
    mixed = f"""SELECT qid, doc_id, coalesce({a} * score / nullif(max(score) OVER (PARTITION BY qid), 0), 0) + coalesce({b} * prior / nullif(max(prior) OVER (PARTITION BY qid), 0), 0) AS score
                FROM {source} JOIN prior USING (doc_id)"""
    return f"WITH {_BASE}, m AS ({mixed}), r AS ({_top('m', 5)}) SELECT qid, doc_id, rank, round(score, 6) AS score FROM r"


def _any_prior_sql(source: str, a: float, b: float) -> str:
    mixed = f"""SELECT qid, doc_id, coalesce({a} * score / nullif(max(score) OVER (PARTITION BY qid), 0), 0) + coalesce({b} * coalesce(prior, 0) / nullif(max(coalesce(prior, 0)) OVER (PARTITION BY qid), 0), 0) AS score
                FROM {source} LEFT JOIN prior USING (doc_id)"""
    return f"WITH {_BASE}, m AS ({mixed}), r AS ({_top('m', 5)}) SELECT qid, doc_id, rank, round(score, 6) AS score FROM r"


_DIVERSE = f"""
WITH {_BASE}, r AS ({_top('hy', 20)}),
s AS (SELECT r.*, list_distinct(d.tokens) AS toks FROM r JOIN d USING (doc_id)),
f AS (SELECT b.qid, b.doc_id, sum(CASE WHEN j > 0.5 THEN ln(1 - 0.1 * j) ELSE 0 END) AS lf FROM (
        SELECT b.qid, b.doc_id, CAST(len(list_intersect(a.toks, b.toks)) AS DOUBLE) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) AS j
        FROM s a JOIN s b ON a.qid = b.qid AND a.rank < b.rank) b GROUP BY b.qid, b.doc_id),
v AS (SELECT r.qid, r.doc_id, r.score * exp(coalesce(lf, 0)) AS score FROM r LEFT JOIN f USING (qid, doc_id)),
w AS ({_top('v', 5)})
SELECT qid, doc_id, rank, round(score, 6) AS score FROM w
"""

_TOURNAMENT = f"""
WITH {_BASE}, r AS (SELECT x.qid, x.doc_id, x.rank, x.score, length(t.text) AS size FROM ({_top('bm', 10)}) x JOIN documents t USING (doc_id)),
p AS (SELECT a.qid, a.doc_id AS a, b.doc_id AS b, sign(sign(round(a.score, 2) - round(b.score, 2)) * 2 + sign(a.size - b.size)) AS result FROM r a JOIN r b ON a.qid = b.qid AND a.rank < b.rank),
g AS (SELECT qid, a AS doc_id, CAST(result > 0 AS BIGINT) AS won FROM p UNION ALL SELECT qid, b, CAST(result < 0 AS BIGINT) FROM p),
w AS (SELECT qid, doc_id, CAST(sum(won) AS BIGINT) AS wins FROM g GROUP BY qid, doc_id)
SELECT qid, doc_id, wins, round(CASE WHEN max(wins) OVER (PARTITION BY qid) > 0 THEN CAST(wins AS DOUBLE) / max(wins) OVER (PARTITION BY qid) ELSE 0.0 END, 6) AS score FROM w
"""

_SCORE_PARSE = r"""
WITH r AS (SELECT conv_id, turn, text, lower(text) AS low, TRY_CAST(nullif(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS v FROM conversations WHERE text IS NOT NULL AND lower(role) = 'assistant')
SELECT conv_id, turn, round(coalesce(CASE WHEN v > 10 THEN least(1.0, v / 100) WHEN v > 1 THEN v / 10 WHEN v >= 0 THEN v END,
  CASE WHEN contains(low, 'excellent') THEN 0.9 WHEN contains(low, 'not relevant') OR contains(low, 'irrelevant') THEN 0.1 WHEN contains(low, 'highly') THEN 0.9
       WHEN contains(low, 'somewhat') THEN 0.5 WHEN contains(low, 'slightly') THEN 0.3 WHEN contains(low, 'relevant') THEN 0.7 END, 0.5), 6) AS score,
  CASE WHEN contains(low, 'document a') AND NOT contains(low, 'document b') THEN 1 WHEN contains(low, 'document b') AND NOT contains(low, 'document a') THEN -1
       WHEN starts_with(trim(low), 'a') THEN 1 WHEN starts_with(trim(low), 'b') THEN -1 ELSE 0 END AS winner
FROM r
"""

QUERIES = {f.__name__: f for f in (bm25_topk, tfidf_topk, bm25_with_prior, tfidf_with_prior, bm25_with_any_prior, tfidf_with_any_prior, hybrid_topk, hybrid_diverse, pairwise_tournament, similarity_rerank, rerank_method_choice, score_parse, rerank_cache_key)}

SQL = {
    "bm25_topk": _topk_sql("bm"),
    "tfidf_topk": _topk_sql("ti"),
    "hybrid_topk": _topk_sql("hy"),
    "bm25_with_prior": _prior_sql("bm", 0.7, 0.3),
    "tfidf_with_prior": _prior_sql("ti", 0.6, 0.4),
    "bm25_with_any_prior": _any_prior_sql("bm", 0.7, 0.3),
    "tfidf_with_any_prior": _any_prior_sql("ti", 0.6, 0.4),
    "hybrid_diverse": _DIVERSE,
    "pairwise_tournament": _TOURNAMENT,
    "similarity_rerank": f"""WITH {_BASE}, s AS (SELECT coalesce(source, '?') AS qid, doc_id, coalesce(prior, 1.0) AS score FROM documents LEFT JOIN prior USING (doc_id)), r AS ({_top('s', 10)})
        SELECT qid, doc_id, rank, score FROM r""",
    "rerank_method_choice": f"""WITH {_BASE}, c AS (SELECT qid, count(DISTINCT doc_id) AS candidates FROM tf JOIN qt USING (term) GROUP BY qid),
        z AS (SELECT q.qid, coalesce(candidates, 0) AS candidates, len({sql.words('q.text')}) > 3 AS hard FROM q LEFT JOIN c USING (qid))
        SELECT qid, candidates, CASE WHEN candidates <= 5 THEN CASE WHEN hard THEN 'pairwise' ELSE 'bm25' END WHEN hard THEN 'hybrid' ELSE 'bm25' END AS method FROM z""",
    "score_parse": _SCORE_PARSE,
    "rerank_cache_key": f"""WITH {_BASE}, r AS ({_top('bm', 5)}), l AS (SELECT qid, list_sort(list(CAST(doc_id AS VARCHAR))) AS ids FROM r GROUP BY qid)
        SELECT qid, md5(concat_ws('|', CAST(qid AS VARCHAR), array_to_string(ids, ','), 'bm25')) AS key FROM l""",
}

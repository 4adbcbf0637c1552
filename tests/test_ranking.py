import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import ranking

DOCS = [(1, "red apple tree"), (2, "red red wine"), (3, "green tea"), (4, None), (5, "..."), (6, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "qid long, text string")


def test_word_in_most_documents_weighs_negative(spark, docs):
    scores = {r.doc_id: r.score for r in ranking.bm25(docs, ask(spark, "red")).collect()}
    assert set(scores) == {1, 2} and all(s < 0 for s in scores.values())


def test_bm25_by_hand(spark, docs):
    got = {r.doc_id: r.score for r in ranking.bm25(docs, ask(spark, "wine wine")).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5)
    assert got == pytest.approx({2: 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (8 / 3)))})


def test_tfidf_of_a_word_in_all_is_negative(spark):
    same = spark.createDataFrame([(1, "tea cup"), (2, "tea pot")], "doc_id long, text string")
    assert all(r.score < 0 for r in ranking.tfidf(same, ask(spark, "tea")).collect())


def test_fusion_pairs_by_document(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "qid long, doc_id long, score double")
    b = spark.createDataFrame([(1, 2, 4.0), (1, 3, 2.0)], "qid long, doc_id long, score double")
    assert {r.doc_id: round(r.score, 6) for r in ranking.fused(a, b, 0.6, 0.4).collect()} == {1: 0.6, 2: 0.7, 3: 0.2}


def test_zero_scores_keep_the_prior(spark):
    zero = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "qid long, doc_id long, score double")
    prior = spark.createDataFrame([(1, 5.0), (2, 10.0)], "doc_id long, prior double")
    assert {r.doc_id: r.score for r in ranking.with_prior(zero, prior, 0.7, 0.3).collect()} == {1: 0.15, 2: 0.3}


def test_a_document_without_a_prior_stays(spark):
    scored = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 3, 1.0)], "qid long, doc_id long, score double")
    prior = spark.createDataFrame([(2, 5.0), (3, None)], "doc_id long, prior double")
    assert {r.doc_id: round(r.score, 6) for r in ranking.with_prior(scored, prior, 0.7, 0.3).collect()} == {1: 0.7, 2: 0.65, 3: 0.175}
    assert {r.doc_id: round(r.score, 6) for r in ranking.with_prior(scored, prior, 0.7, 0.3, missing=1.0).collect()} == {1: 0.76, 2: 0.65, 3: 0.235}
    none = ranking.with_prior(scored, prior.limit(0), 0.7, 0.3).collect()
    assert {r.doc_id: round(r.score, 6) for r in none} == {1: 0.7, 2: 0.35, 3: 0.175}


def test_ties_go_to_the_smaller_id(spark):
    tied = spark.createDataFrame([(1, 9, 1.0), (1, 3, 1.0), (1, 5, 1.0 + 1e-12)], "qid long, doc_id long, score double")
    assert [r.doc_id for r in ranking.top_k(tied, 2).orderBy("rank").collect()] == [3, 5]


def test_diversity_spares_half_alike(spark):
    ranked = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 1.0)], "qid long, doc_id long, rank int, score double")
    tokens = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["a", "b", "c"])], "doc_id long, tokens array<string>")
    got = {r.doc_id: round(r.diverse_score, 6) for r in ranking.diversified(ranked, tokens).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.9}  # Jaccard 0.5 brings no penalty, 1.0 brings a tenth


def test_tournament(spark):
    ranked = spark.createDataFrame([(1, 7, 1, 3.0), (1, 8, 2, 2.0), (1, 9, 3, 2.0)], "qid long, doc_id long, rank int, score double")
    won = ranking.tournament(ranked, F.signum(F.col("a_score") - F.col("b_score")))
    assert {r.doc_id: (r.wins, r.score) for r in won.collect()} == {7: (2, 1.0), 8: (0, 0.0), 9: (0, 0.0)}


@pytest.mark.parametrize("reply, score", [("1", 1.0), ("7", 0.7), ("10", 1.0), ("85", 0.85), ("11", 0.11), ("300", 1.0), ("highly so", 0.9), ("not relevant", 0.1), ("no idea", 0.5)])
def test_parsed_score(spark, reply, score):
    assert spark.createDataFrame([(reply,)], "r string").select(ranking.parsed_score(F.col("r"))).first()[0] == pytest.approx(score)


def test_nothing_asked_or_stored(spark, docs):
    assert ranking.bm25(docs, ask(spark, "zzz", "")).count() == 0
    assert ranking.bm25(docs.limit(0), ask(spark, "red")).count() == 0

import numpy as np
import pytest

from textloom.operators import knn
from textloom.plans.vectors import knn_bucketed_recall

RNG = np.random.default_rng(0)
ROWS = RNG.normal(size=(400, 64))
ROWS[7] = 0
ROWS[9] = ROWS[8]


@pytest.fixture(scope="module")
def tables(spark):
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ROWS)] + [(900, None)], "vec_id long, vector array<double>")
    asked = vectors.where("vec_id % 50 = 8").selectExpr("vec_id as qid", "vector")
    return vectors, asked


def brute(k):
    unit = ROWS / np.maximum(np.linalg.norm(ROWS, axis=1, keepdims=True), 1e-300)
    out = {}
    for q in range(8, 400, 50):
        sims = np.round(unit @ unit[q], 9)
        sims[7] = -np.inf
        out[q] = sorted(range(400), key=lambda i: (-sims[i], i))[:k]
    return out


def test_exact(tables):
    got = {}
    for r in knn.knn(*tables, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    assert got == brute(5)


def test_queries_in_blocks(tables, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BYTES", 64 * 8 * 3)
    got = {(r.qid, r.vec_id) for r in knn.knn(*tables, 5).collect()}
    assert got == {(q, i) for q, found in brute(5).items() for i in found}


def test_bucketed_recall(spark):
    centre = RNG.normal(size=(20, 64))
    rows = np.vstack([c + 0.25 * RNG.normal(size=(30, 64)) for c in centre])
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, vector array<double>")
    asked = vectors.where("vec_id % 50 = 0").selectExpr("vec_id as qid", "vector")
    exact = {(r.qid, r.vec_id) for r in knn.knn(vectors, asked, 5).collect()}
    near = {(r.qid, r.vec_id) for r in knn.knn_bucketed(vectors, asked, 5, 64).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_bucketed_recall_on_the_given_embeddings(spark, data):
    got = knn_bucketed_recall(spark, data).first()
    assert got.wanted == 50 and got.recall >= 0.9


def test_probes_are_the_bucket_and_those_one_bit_away(tables):
    own = {(r.vec_id, r.table): r.bucket for r in knn.signatures(tables[1].withColumnRenamed("qid", "vec_id"), 64).collect()}
    near = {}
    for r in knn.signatures(tables[1].withColumnRenamed("qid", "vec_id"), 64, near=True).collect():
        near.setdefault((r.vec_id, r.table), []).append(r.bucket)
    assert {k: sorted(v) for k, v in near.items()} == {k: sorted([b, *(b ^ (1 << i) for i in range(6))]) for k, b in own.items()}


def test_empty(tables):
    vectors, asked = tables
    assert knn.knn(vectors, asked.limit(0), 5).count() == 0
    assert knn.knn(vectors.limit(0), asked, 5).count() == 0


def test_scores_in_small_blocks(tables, monkeypatch):
    monkeypatch.setattr(knn, "SCORE_BYTES", 8 * 8 * 3)
    got = {(r.qid, r["rank"]): r.vec_id for r in knn.knn(*tables, 5).collect()}
    assert got == {(q, n + 1): i for q, found in brute(5).items() for n, i in enumerate(found)}

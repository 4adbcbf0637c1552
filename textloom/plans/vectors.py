"""Vector queries: every fiftieth vector asks, all vectors answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.functions.vectors import doubles, norm, unit
from textloom.operators import knn
from textloom.sources.tables import table


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("vector"), "label")


def _asked(spark, sf):
    return _vectors(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "vector")


def _out(found: DataFrame) -> DataFrame:
    return found.select("qid", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def knn_topk(spark, sf):
    return _out(knn.knn(_vectors(spark, sf), _asked(spark, sf), 5))


def knn_filtered(spark, sf):
    """Only rows of an even label; the filter reaches the scan."""
    return _out(knn.knn(_vectors(spark, sf).where("label % 2 = 0"), _asked(spark, sf), 5))


def knn_batch_summary(spark, sf):
    """Results, mean and best score of the whole batch."""
    found = knn.knn(_vectors(spark, sf), _asked(spark, sf), 3)
    return found.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("results"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.min("score"), 6).alias("worst"))


def knn_bucketed_recall(spark, sf):
    """Share of the true five nearest that the hash buckets find, over all queries."""
    vectors, asked = _vectors(spark, sf), _asked(spark, sf)
    exact = knn.knn(vectors, asked, 5).select("qid", "vec_id")
    near = knn.knn_bucketed(vectors, asked, 5, dim=64).select("qid", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["qid", "vec_id"], "left").agg(F.count("*").alias("wanted"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def vector_pooling(spark, sf):
    pooled = knn.pooled(_vectors(spark, sf), "label")
    return pooled.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"), F.round("first", 6).alias("first"))


def vector_norms(spark, sf):
    """Length before and after normalising."""
    return _vectors(spark, sf).select("vec_id", F.round(norm(F.col("vector")), 6).alias("before"), F.round(norm(unit(F.col("vector"))), 6).alias("after"))


def label_centroid(spark, sf):
    """Length of each label's mean vector: how tight the label is."""
    mean = knn.pooled(_vectors(spark, sf), "label").groupBy("label").agg(F.sum(F.col("mean") * F.col("mean")).alias("sq"))
    sizes = _vectors(spark, sf).groupBy("label").agg(F.count("*").alias("vectors"))
    return mean.join(sizes, "label").select("label", "vectors", F.round(F.sqrt("sq"), 6).alias("length"))


def store_stats(spark, sf):
    """Chunks, documents and the newest upload of each user and model."""
    chunks = table(spark, sf, "document_chunks").select("user_id", "model_id", "document_id", "ingested_at")
    return chunks.groupBy(F.coalesce("user_id", F.lit("default")).alias("user_id"), F.coalesce("model_id", F.lit("default")).alias("model_id")).agg(
        F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.max("ingested_at").alias("newest")
    )


def user_namespaces(spark, sf):
    docs = table(spark, sf, "documents").select("user_id", "namespace")
    return docs.groupBy("user_id").agg(F.count("*").alias("documents"), F.concat_ws(",", F.array_sort(F.collect_set("namespace"))).alias("namespaces"))


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings), q AS (SELECT vec_id AS qid, vector FROM v WHERE vec_id % 50 = 0)"


def _knn_sql(k: int, where: str = "") -> str:
    return f"""{_V}, s AS (SELECT qid, vec_id, round(list_cosine_similarity(q.vector, v.vector), 9) AS score FROM q, v {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {k})"""


_LONG = "l AS (SELECT label, vec_id, unnest(vector) AS x, unnest(range(len(vector))) AS dim FROM v)"

QUERIES = {f.__name__: f for f in (knn_topk, knn_filtered, knn_batch_summary, knn_bucketed_recall, vector_pooling, vector_norms, label_centroid, store_stats, user_namespaces)}

SQL = {
    "knn_topk": f"WITH {_knn_sql(5)} SELECT qid, vec_id, rank, round(score, 6) AS score FROM r",
    "knn_filtered": f"WITH {_knn_sql(5, 'WHERE label % 2 = 0')} SELECT qid, vec_id, rank, round(score, 6) AS score FROM r",
    "knn_batch_summary": f"WITH {_knn_sql(3)} SELECT count(DISTINCT qid) AS queries, count(*) AS results, round(avg(score), 6) AS mean_score, round(min(score), 6) AS worst FROM r",
    "vector_pooling": f"WITH {_V}, {_LONG} SELECT label, dim, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min_by(x, vec_id), 6) AS first FROM l GROUP BY label, dim",
    "vector_norms": f"""WITH {_V}, n AS (SELECT vec_id, vector, sqrt(list_sum([x * x for x in vector])) AS s FROM v)
        SELECT vec_id, round(s, 6) AS before, round(CASE WHEN s > 0 THEN sqrt(list_sum([(x / s) * (x / s) for x in vector])) ELSE 0.0 END, 6) AS after FROM n""",
    "label_centroid": f"""WITH {_V}, {_LONG}, m AS (SELECT label, dim, avg(x) AS mean FROM l GROUP BY label, dim), c AS (SELECT label, count(*) AS vectors FROM v GROUP BY label)
        SELECT label, vectors, round(sqrt(sum(mean * mean)), 6) AS length FROM m JOIN c USING (label) GROUP BY label, vectors""",
    "store_stats": """SELECT coalesce(user_id, 'default') AS user_id, coalesce(model_id, 'default') AS model_id, count(*) AS chunks, count(DISTINCT document_id) AS documents, max(ingested_at) AS newest
        FROM document_chunks GROUP BY 1, 2""",
    "user_namespaces": "SELECT user_id, count(*) AS documents, coalesce(string_agg(DISTINCT namespace, ',' ORDER BY namespace), '') AS namespaces FROM documents GROUP BY user_id",
}

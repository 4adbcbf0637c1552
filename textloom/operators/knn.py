"""Nearest neighbours over a vector table: exact in blocks, and through hash buckets.

A stated query set runs against all rows: each task holds the queries as one
matrix, scores its rows block by block and keeps the k best so far, so what is
shuffled is k rows for each query and task, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: One block of queries is broadcast as a matrix of at most this many bytes; more queries run as several blocks.
QUERY_BYTES = 64 << 20
#: Scores of one block of rows against all queries of a task take at most this many bytes.
SCORE_BYTES = 64 << 20


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries as (ids, unit rows) matrices of bounded size."""
    shape = queries.where(F.col("vector").isNotNull()).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    blocks = max(1, -(-shape.n * (shape.dim or 1) * 8 // QUERY_BYTES))
    for block in range(blocks if shape.n else 0):
        rows = queries.where(F.col("vector").isNotNull() & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)).select("qid", "vector").collect()
        if rows:
            matrix = np.array([r.vector for r in rows], dtype="float64")
            yield np.array([r.qid for r in rows], dtype="int64"), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score, rank): the k rows of largest cosine for each query (qid, vector), ties to the smaller id.

    ``vectors`` has vec_id and vector; null and zero vectors never match.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vector").isNotNull()).select("vec_id", "vector")
    scored = None
    for block in _query_blocks(queries):
        part = rows.mapInPandas(_block_scorer(spark.sparkContext.broadcast(block), k), "qid bigint, vec_id bigint, score double")
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return spark.createDataFrame([], "qid bigint, vec_id bigint, score double, rank int")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_scorer(shared, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        step = max(1, SCORE_BYTES // (8 * len(qids)))
        best, ids = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), dtype="int64")
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                rows = np.array(part["vector"].tolist(), dtype="float64")
                size = np.linalg.norm(rows, axis=1)
                sims = np.round(q @ (rows / np.where(size > 0, size, 1.0)[:, None]).T, 9)
                sims[:, size == 0] = -np.inf
                # a score as good as the k-th so far may win by its id; queries without one keep what they have
                better = np.flatnonzero((sims >= best[:, -1:]).any(axis=1))
                scores = np.hstack([best[better], sims[better]])
                vec = np.hstack([ids[better], np.broadcast_to(part["vec_id"].to_numpy(), (len(better), len(part)))])
                order = np.lexsort((vec, -scores), axis=1)[:, :k]
                best[better], ids[better] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(vec, order, axis=1)
        flat = pd.DataFrame({"qid": np.repeat(qids, k), "vec_id": ids.ravel(), "score": best.ravel()})
        yield flat[np.isfinite(flat["score"])]

    return score


def signatures(vectors: DataFrame, dim: int, tables: int = 16, bits: int = 6, seed: int = 7, near: bool = False) -> DataFrame:
    """(vec_id, table, bucket) for each hash table: sign bits against fixed random planes; ``near`` adds the buckets one bit away."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    flips = np.array([0, *(1 << np.arange(bits))]) if near else np.array([0])

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits)
        for batch in batches:
            if not len(batch):
                continue
            rows = np.array(batch["vector"].tolist(), dtype="float64")
            codes = ((np.einsum("tbd,nd->ntb", planes, rows) > 0) * weights).sum(axis=2)
            probed = codes[:, :, None] ^ flips
            ids, at = np.repeat(batch["vec_id"].to_numpy(), tables * len(flips)), np.tile(np.repeat(np.arange(tables), len(flips)), len(rows))
            yield pd.DataFrame({"vec_id": ids, "table": at, "bucket": probed.ravel()})

    return vectors.where(F.col("vector").isNotNull()).select("vec_id", "vector").mapInPandas(sign, "vec_id bigint, table int, bucket int")


def knn_bucketed(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 16, bits: int = 6) -> DataFrame:
    """(qid, vec_id, score, rank) among rows whose bucket is the query's or one bit from it in some table.

    Every row is indexed once for each table; the query's side probes the buckets
    at Hamming distance 1 as well, as neighbours at a wide angle seldom share all
    bits.  The index spreads by table and bucket; only ids meet, vectors join the
    distinct pairs afterwards.
    """
    from textloom.functions.vectors import cosine, doubles

    index = signatures(vectors, dim, tables, bits)
    probes = signatures(queries.select(F.col("qid").alias("vec_id"), "vector"), dim, tables, bits, near=True).withColumnRenamed("vec_id", "qid")
    pairs = index.join(probes, ["table", "bucket"]).select("qid", "vec_id").distinct()
    full = pairs.join(queries.select("qid", doubles(F.col("vector")).alias("q")), "qid").join(vectors.select("vec_id", doubles(F.col("vector")).alias("v")), "vec_id")
    scored = full.select("qid", "vec_id", F.round(cosine(F.col("q"), F.col("v")), 9).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pooled(vectors: DataFrame, key: str) -> DataFrame:
    """(key, dim, mean, max, first): vectors of a key pooled for each dimension; first is that of the smallest id."""
    long = vectors.select(key, "vec_id", F.posexplode("vector").alias("dim", "x"))
    return long.groupBy(key, "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min_by("x", "vec_id").alias("first"))

import random
from datetime import datetime, timedelta

from textloom.operators.relational import asof_join, range_join

START = datetime(2024, 1, 1)


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.randint(1, 4), START + timedelta(minutes=rng.randint(0, 20_000)), float(i)) for i in range(n)]


def test_asof_against_brute_force(spark):
    left, right = rows(300, 1), rows(120, 2)
    l = spark.createDataFrame(left, "id long, k int, ts timestamp, v double").drop("v")
    r = spark.createDataFrame(right, "rid long, k int, ts timestamp, v double")
    got = {x.id: x.rid for x in asof_join(l, r, "k", "ts", ["rid", "v"]).collect()}
    for i, k, ts, _ in left:
        best = max(((t, j) for j, kk, t, _ in right if kk == k and t <= ts), default=(None, None))
        assert got[i] == best[1]


def test_range_against_brute_force(spark):
    left, right = rows(200, 3), rows(200, 4)
    l = spark.createDataFrame(left, "id long, k int, ts timestamp, v double").drop("v")
    r = spark.createDataFrame(right, "rid long, k int, rts timestamp, v double").drop("v")
    got = {(x.id, x.rid) for x in range_join(l, r, "k", "ts", "rts", 7200).collect()}
    assert got == {(i, j) for i, k, t, _ in left for j, kk, u, _ in right if k == kk and timedelta(0) <= u - t <= timedelta(hours=2)}


def test_empty_sides(spark):
    l = spark.createDataFrame([], "id long, k int, ts timestamp")
    r = spark.createDataFrame(rows(3, 1), "rid long, k int, ts timestamp, v double")
    assert asof_join(l, r, "k", "ts", ["rid"]).count() == 0
    alone = asof_join(r, l.withColumnRenamed("id", "other"), "k", "ts", ["other"]).collect()
    assert len(alone) == 3 and all(x.other is None for x in alone)

"""Joins Spark has no operator for: as-of and range joins without a cross product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], bucket_s: int = 86_400) -> DataFrame:
    """Each left row with ``columns`` of the last right row of its key at or before its time; null where there is none.

    Both sides are put in one stream, cut into time buckets: a running last value
    within (key, bucket) needs no more than a bucket in one task, and what a
    bucket ends with is carried to later ones over one row for each bucket.  Of
    right rows at the same time the one with the largest columns wins.
    """
    value = F.struct(ts, *columns)
    rows = left.select(*left.columns, F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (key, ts)]
    others = right.select(key, ts, *empty, value.alias("_v"), F.lit(0).alias("_side")).select(*left.columns, "_v", "_side")
    both = rows.unionByName(others).withColumn("_bucket", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bucket_s * 1_000_000)))
    order = Window.partitionBy(key, "_bucket").orderBy(ts, "_side", "_v")
    inside = both.withColumn("_near", F.last("_v", ignorenulls=True).over(order))
    ends = others.withColumn("_bucket", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bucket_s * 1_000_000))).groupBy(key, "_bucket").agg(F.max("_v").alias("_end"))
    wanted = both.select(key, "_bucket").distinct().join(ends, [key, "_bucket"], "left")
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).select(key, "_bucket", "_before")
    found = inside.where("_side = 1").join(carried, [key, "_bucket"], "left").withColumn("_found", F.coalesce("_near", "_before"))
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within_s: int) -> DataFrame:
    """Pairs of a key whose right time is at, or up to ``within_s`` seconds after, the left time.

    Time is cut into buckets as long as the range: a left row meets the rights of
    its own bucket and the next one, by an equi-join on key and bucket.
    """
    width = within_s * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.floor(micros(left_ts) / width)
    probes = left.withColumn("_bucket", F.explode(F.array(own, own + 1)))
    build = right.withColumn("_bucket", F.floor(micros(right_ts) / width))
    gap = micros(right_ts) - micros(left_ts)
    return probes.join(build, [key, "_bucket"]).where((gap >= 0) & (gap <= width)).drop("_bucket")

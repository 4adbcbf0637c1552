"""Statistics of runs: per-agent figures, moving averages, trends, levels, rates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

#: Weight of the old value in the moving average.
KEEP = 0.9
#: Rows of a smaller weight than this are below the precision of a double.
EMA_WEIGHT = 1e-19


def agent_stats(runs: DataFrame, agent: str, value: str, failed: str) -> DataFrame:
    """(agent, runs, mean, failures, success_rate, consistency); consistency is 1 less the population variance of value / 100, at least 0."""
    return runs.groupBy(agent).agg(
        F.count("*").alias("runs"), F.avg(value).alias("mean"), F.sum(F.col(failed).cast("int")).alias("failures"), F.avg(1.0 - F.col(failed).cast("int")).alias("success_rate"),
        F.greatest(F.lit(0.0), 1 - F.coalesce(F.var_pop(F.col(value) / 100), F.lit(0.0))).alias("consistency"),
    )


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, keep: float = KEEP) -> DataFrame:
    """(key, average): ``keep`` of the old value and the rest of the new one, over all rows of a key in order.

    ``keep`` lies above 0 and below 1.  Only the newest rows weigh more than the
    precision of a double (for 0.9 about 400), so the group limit takes those
    before the exchange and no group is gathered whole.
    """
    if not 0 < keep < 1:
        raise ValueError(f"keep must lie between 0 and 1, not {keep}")
    weighing = math.ceil(math.log(EMA_WEIGHT) / math.log(keep))
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    kept = rows.where(F.col(value).isNotNull()).select(key, *order, value).withColumn("age", F.row_number().over(newest) - 1).where(F.col("age") <= weighing)
    oldest = F.max("age").over(Window.partitionBy(key))
    weight = F.when(F.col("age") == oldest, F.pow(F.lit(keep), F.col("age"))).otherwise((1 - keep) * F.pow(F.lit(keep), F.col("age")))
    return kept.withColumn("w", weight).groupBy(key).agg(F.sum(F.col("w") * F.col(value)).alias("average"))


def newest_mean(rows: DataFrame, key: str, order: list[str], value: str, n: int = 100) -> DataFrame:
    """(key, rows, mean) over the newest n rows of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return rows.select(key, *order, value).withColumn("nth", nth).where(F.col("nth") <= n).groupBy(key).agg(F.count("*").alias("rows"), F.avg(value).alias("mean"))


def trend(rows: DataFrame, key: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """(key, slope): newest less oldest value of the last n rows, over their number."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    last = rows.select(key, *order, value).withColumn("nth", nth).where(F.col("nth") <= n)
    return last.groupBy(key).agg(((F.min_by(value, "nth") - F.max_by(value, "nth")) / F.count("*")).alias("slope"))

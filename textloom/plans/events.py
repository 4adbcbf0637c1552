"""Queries over events: run statistics, time windows, sessions, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.operators import runs
from textloom.sources.tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def agent_stats(spark, sf):
    rows = _events(spark, sf).select("user_id", "value", (F.col("event_type") == "error").alias("failed"))
    got = runs.agent_stats(rows, "user_id", "value", "failed")
    return got.select("user_id", "runs", F.round("mean", 6).alias("mean"), "failures", F.round("success_rate", 6).alias("success_rate"), F.round("consistency", 6).alias("consistency"))


def ema_latency(spark, sf):
    return runs.moving_average(_events(spark, sf), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("average", 6).alias("average"))


def last100_mean(spark, sf):
    got = runs.newest_mean(_events(spark, sf), "event_type", ["ts", "event_id"], "value")
    return got.select("event_type", "rows", F.round("mean", 6).alias("mean"))


def value_trend(spark, sf):
    return runs.trend(_events(spark, sf), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("slope", 6).alias("slope"))


def load_levels(spark, sf):
    """Events by how near their value is to 100."""
    level = F.when(F.col("value") >= 90, "critical").when(F.col("value") >= 80, "warning").otherwise("normal")
    return _events(spark, sf).groupBy(level.alias("level")).agg(F.count("*").alias("events"))


def weighted_confidence(spark, sf):
    """Mean of values by event type, weighted by type."""
    weight = F.when(F.col("event_type") == "purchase", 0.9).when(F.col("event_type") == "click", 0.8).when(F.col("event_type") == "view", 0.7).otherwise(0.6)
    return _events(spark, sf).withColumn("w", weight).groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("confidence"))


def event_tumbling(spark, sf):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return _events(spark, sf).groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


def event_sliding(spark, sf):
    """Six-hour windows every three hours."""
    got = _events(spark, sf).groupBy(F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "events", "users")


def event_sessions(spark, sf):
    """Sessions of a user, ended by a gap of four hours; sessions are merged before the exchange as well as after it."""
    got = _events(spark, sf).groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last"))
    return got.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first"), "last", "events", "total")


def rate_limit(spark, sf):
    """Users with more than two events within one hour of the clock."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return _events(spark, sf).groupBy("user_id", hour.alias("hour")).agg(F.count("*").alias("events")).where("events > 2")


def props_values(spark, sf):
    """A value inside the JSON properties, by its tens."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf).select((F.floor(k / 10) * 10).cast("bigint").alias("bucket"), "value").groupBy("bucket").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean"))


QUERIES = {f.__name__: f for f in (agent_stats, ema_latency, last100_mean, value_trend, load_levels, weighted_confidence, event_tumbling, event_sliding, event_sessions, rate_limit, props_values)}

SQL = {
    "agent_stats": """SELECT user_id, count(*) AS runs, round(avg(value), 6) AS mean, count(*) FILTER (event_type = 'error') AS failures, round(avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS success_rate,
        round(greatest(0.0::DOUBLE, 1 - coalesce(var_pop(value / 100), 0)), 6) AS consistency FROM events GROUP BY user_id""",
    "ema_latency": """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
        SELECT user_id, round(sum((CASE WHEN age = n - 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) * pow(0.9::DOUBLE, age) * value), 6) AS average FROM o GROUP BY user_id""",
    "last100_mean": """SELECT event_type, count(*) AS rows, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 100) GROUP BY event_type""",
    "value_trend": """SELECT user_id, round((min_by(value, nth) - max_by(value, nth)) / count(*), 6) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 10) GROUP BY user_id""",
    "load_levels": "SELECT CASE WHEN value >= 90 THEN 'critical' WHEN value >= 80 THEN 'warning' ELSE 'normal' END AS level, count(*) AS events FROM events GROUP BY 1",
    "weighted_confidence": """SELECT user_id, round(sum(w * value) / sum(w), 6) AS confidence FROM (SELECT user_id, value, CAST(CASE event_type WHEN 'purchase' THEN 0.9 WHEN 'click' THEN 0.8 WHEN 'view' THEN 0.7 ELSE 0.6 END AS DOUBLE) AS w FROM events) GROUP BY user_id""",
    "event_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sliding": """SELECT start, count(*) AS events, count(DISTINCT user_id) AS users FROM (
        SELECT user_id, unnest([time_bucket(INTERVAL 3 HOURS, ts), time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL 3 HOURS]) AS start FROM events) GROUP BY start""",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 4 * 3600 * 1000000::BIGINT THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
        SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events, round(sum(value), 4) AS total FROM n GROUP BY user_id, session""",
    "rate_limit": "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS events FROM events GROUP BY 1, 2 HAVING count(*) > 2",
    "props_values": "SELECT CAST(floor(CAST(json_extract(props, '$.k') AS INTEGER) / 10) * 10 AS BIGINT) AS bucket, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY 1",
}

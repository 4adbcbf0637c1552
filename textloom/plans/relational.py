"""Relational queries over the star schema: joins, grouping sets, windows, set operations, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.operators.relational import asof_join, range_join
from textloom.sources.tables import table


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def _money(name: str):
    """A price as an exact decimal, so that sums do not depend on the order of rows."""
    return F.col(name).cast("decimal(15,2)")


def _net():
    return _money("l_extendedprice") * (F.lit(1).cast("decimal(3,2)") - _money("l_discount"))


def pricing_summary(spark, sf):
    items = _t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-06-01").cast("timestamp_ntz"))
    net = _net().cast("decimal(18,4)")
    charge = net * (F.lit(1).cast("decimal(3,2)") + _money("l_tax"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(_money("l_quantity")).cast("double").alias("sum_qty"), F.sum(net).cast("double").alias("sum_net"), F.sum(charge.cast("decimal(20,6)")).cast("double").alias("sum_charge"),
        F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("items"),
    )


def star_joins(spark, sf):
    """Revenue by customer region and supplier nation; the dimension tables are joined where the optimizer sees fit."""
    items = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", _net().cast("decimal(18,4)").alias("net"))
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = _t(spark, sf, "nation")
    regions = _t(spark, sf, "region").select("r_regionkey", "r_name")
    suppliers = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey"))
    where_from = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    supply = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(where_from, F.col("o_custkey") == F.col("c_custkey")).join(supply, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("net").cast("double").alias("revenue"), F.count("*").alias("items"))


def semi_anti(spark, sf):
    """Customers with and without orders, by segment."""
    customers = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    buyers = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    active = customers.join(buyers, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("active"))
    idle = customers.join(buyers, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("idle"))
    return active.join(idle, "c_mktsegment", "full").select("c_mktsegment", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("idle", F.lit(0)).alias("idle"))


def rollup_orders(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    got = orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum(_money("o_totalprice")).cast("double").alias("total"), F.grouping_id().cast("bigint").alias("level"))
    return got


def cube_items(spark, sf):
    got = _t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("items"), F.grouping_id().cast("bigint").alias("level"))
    return got


def grouping_sets(spark, sf):
    _t(spark, sf, "customer").createOrReplaceTempView("textloom_customer")
    return spark.sql("""SELECT c_mktsegment, c_nationkey, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS balance
        FROM textloom_customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")


def window_frames(spark, sf):
    """Each customer's orders with rank, running total, previous price and mean of three."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return orders.select(
        "o_custkey", "o_orderkey", F.row_number().over(by).cast("bigint").alias("nth"), F.round(F.sum("o_totalprice").over(by.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.lag("o_totalprice").over(by), 2).alias("before"), F.round(F.avg("o_totalprice").over(by.rowsBetween(-2, 0)), 4).alias("mean3"),
    )


def set_ops(spark, sf):
    """Parts sold at a discount but never returned, and those returned."""
    items = _t(spark, sf, "lineitem").select("l_partkey", "l_discount", "l_returnflag")
    cheap, back = items.where("l_discount >= 0.05").select("l_partkey"), items.where("l_returnflag = 'R'").select("l_partkey")
    return cheap.subtract(back).withColumn("kind", F.lit("kept")).unionByName(cheap.intersect(back).withColumn("kind", F.lit("returned"))).groupBy("kind").agg(F.count("*").alias("parts"), F.sum("l_partkey").alias("checksum"))


def topk_per_group(spark, sf):
    nth = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    parts = _t(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice").withColumn("nth", nth.cast("bigint"))
    return parts.where("nth <= 3").select("p_brand", "p_partkey", F.round("p_retailprice", 2).alias("price"), "nth")


def asof_orders(spark, sf):
    """Each purchase with the last click of the same user before it."""
    events = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    got = asof_join(bought, clicks, "user_id", "ts", ["click_id", "click_value"])
    return got.select("event_id", "user_id", "click_id", F.round("click_value", 4).alias("click_value"))


def range_events(spark, sf):
    """Errors followed by a purchase of the same user within two hours: how many of each."""
    events = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_ts"))
    pairs = range_join(errors, bought, "user_id", "ts", "other_ts", 2 * 3600)
    return pairs.groupBy("user_id").agg(F.count("*").alias("pairs"), F.countDistinct("event_id").alias("errors"))


def pivot_status(spark, sf):
    got = _t(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return got.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


QUERIES = {f.__name__: f for f in (pricing_summary, star_joins, semi_anti, rollup_orders, cube_items, grouping_sets, window_frames, set_ops, topk_per_group, asof_orders, range_events, pivot_status)}

_NET = "CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(18,4))"
SQL = {
    "pricing_summary": f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS sum_qty, CAST(sum({_NET}) AS DOUBLE) AS sum_net,
        CAST(sum(CAST({_NET} * (CAST(1 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(15,2))) AS DECIMAL(20,6))) AS DOUBLE) AS sum_charge,
        round(avg(l_discount), 6) AS mean_discount, count(*) AS items FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-06-01' GROUP BY 1, 2""",
    "star_joins": f"""SELECT r_name, sn.n_name, CAST(sum({_NET}) AS DOUBLE) AS revenue, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""",
    "semi_anti": """SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS active, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS idle
        FROM customer GROUP BY 1""",
    "rollup_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_items": "SELECT l_returnflag, l_linestatus, count(*) AS items, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS balance FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "window_frames": """SELECT o_custkey, o_orderkey, row_number() OVER w AS nth, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, round(lag(o_totalprice) OVER w, 2) AS before,
        round(avg(o_totalprice) OVER (w ROWS 2 PRECEDING), 4) AS mean3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "set_ops": """WITH c AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount >= 0.05), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')
        SELECT 'kept' AS kind, count(*) AS parts, CAST(sum(l_partkey) AS BIGINT) AS checksum FROM (SELECT * FROM c EXCEPT SELECT * FROM b) HAVING count(*) > 0 UNION ALL
        SELECT 'returned', count(*), CAST(sum(l_partkey) AS BIGINT) FROM (SELECT * FROM c INTERSECT SELECT * FROM b) HAVING count(*) > 0""",
    "topk_per_group": "SELECT p_brand, p_partkey, round(p_retailprice, 2) AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS nth FROM part QUALIFY nth <= 3",
    "asof_orders": """SELECT b.event_id, b.user_id, c.event_id AS click_id, round(c.value, 4) AS click_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON b.user_id = c.user_id AND b.ts >= c.ts""",
    "range_events": """SELECT a.user_id, count(*) AS pairs, count(DISTINCT a.event_id) AS errors FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND epoch_us(b.ts) <= epoch_us(a.ts) + 7200 * 1000000::BIGINT
        WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY 1""",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
}

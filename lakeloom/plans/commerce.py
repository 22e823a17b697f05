"""Orders, items, payments and reviews; lineitem stands for items, a supplier for a seller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_count, normal_text, sentiment, year_month
from ..operators.joins import assemble, interval_join
from .base import dealt, query, table, total


def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J1, P4] Each order with its last shipment within 90 days; open orders have none."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    created = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("created_at"))
    ended = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("final_event_at"), F.max_by("l_linestatus", F.struct("l_shipdate", "l_linenumber", "l_linestatus")).alias("final_status"))
    out = interval_join(created, ended.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "created_at", "final_event_at", "90 days")
    days = F.when(F.col("final_status") == "F", day_count("created_at", "final_event_at"))
    late = F.coalesce((F.col("final_status") == "F") & (F.col("final_event_at") > F.col("created_at") + F.expr("INTERVAL 30 DAYS")), F.lit(False))
    return out.withColumn("delivery_days", days).withColumn("is_late", late)


_LIFE = """
    WITH e AS (SELECT l_orderkey, max(l_shipdate) AS final_event_at, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_linestatus)) AS final_status FROM lineitem GROUP BY 1),
    life AS (SELECT o_orderkey, o_custkey, o_orderdate AS created_at, final_event_at, final_status,
                    cast(CASE WHEN final_status = 'F' THEN date_diff('day', o_orderdate, final_event_at) END AS INTEGER) AS delivery_days,
                    coalesce(final_status = 'F' AND final_event_at > o_orderdate + INTERVAL 30 DAY, false) AS is_late
             FROM orders LEFT JOIN e ON l_orderkey = o_orderkey AND final_event_at >= o_orderdate AND final_event_at <= o_orderdate + INTERVAL 90 DAY)
"""


@query("order_lifecycle", _LIFE + "SELECT * FROM life")
def lifecycle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lifecycle(spark, sf_dir)


@query("silver_order_items", """
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice AS price, l_tax AS freight_value,
           round(cast(l_extendedprice AS DECIMAL(18,4)) + cast(l_tax AS DECIMAL(18,4)), 2)::DOUBLE AS total_item_value
    FROM lineitem WHERE l_orderkey IS NOT NULL AND l_extendedprice > 0
""")  # fmt: skip
def silver_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P1, Q2]"""
    value = F.round(F.col("l_extendedprice").cast("decimal(18,4)") + F.col("l_tax").cast("decimal(18,4)"), 2).cast("double")
    return table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND l_extendedprice > 0").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("freight_value"), value.alias("total_item_value"),
    )


@query("silver_order_payments", "SELECT o_orderkey AS order_id, lower(trim(o_orderpriority)) AS payment_type, o_totalprice AS payment_value FROM orders WHERE o_totalprice > 0")
def silver_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P2]"""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 0").select(F.col("o_orderkey").alias("order_id"), normal_text("o_orderpriority").alias("payment_type"), F.col("o_totalprice").alias("payment_value"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of 1 to 5 from each item's quantity."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 5 + 1).cast("int").alias("score"))


_REVIEWS = "r AS (SELECT l_orderkey, l_linenumber, cast(cast(l_quantity AS BIGINT) % 5 + 1 AS INTEGER) AS score FROM lineitem)"


@query("review_sentiment", f"WITH {_REVIEWS} SELECT CASE WHEN score >= 4 THEN 'positive' WHEN score = 3 THEN 'neutral' ELSE 'negative' END AS sentiment, count(*) AS n, round(avg(score), 4) AS avg_score FROM r GROUP BY 1")
def review_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P3, A2]"""
    return _reviews(spark, sf_dir).groupBy(sentiment("score").alias("sentiment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("avg_score"))


@query("order_payments", """
    SELECT l_orderkey, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS primary_type, max(l_quantity) AS max_installments
    FROM lineitem GROUP BY 1
""")  # fmt: skip
def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A1] Sum, the first payment's type, the most installments of each order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        total("l_extendedprice").alias("total_value"), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))).alias("primary_type"), F.max("l_quantity").alias("max_installments")
    )


@query("fulfilment", _LIFE + f""", {_REVIEWS},
    p AS (SELECT l_orderkey, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS primary_type, max(l_quantity) AS max_installments FROM lineitem GROUP BY 1),
    v AS (SELECT l_orderkey, max(score) AS review_score FROM r GROUP BY 1)
    SELECT life.o_orderkey AS order_id, o_custkey, final_status, created_at, final_event_at, delivery_days, is_late, total_value, primary_type, max_installments, review_score,
           CASE WHEN review_score >= 4 THEN 'positive' WHEN review_score = 3 THEN 'neutral' WHEN review_score < 3 THEN 'negative' END AS sentiment
    FROM life JOIN p ON p.l_orderkey = o_orderkey LEFT JOIN v ON v.l_orderkey = o_orderkey WHERE final_status IS NOT NULL
""")  # fmt: skip
def fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A3, J3] One row for each completed order."""
    life = order_lifecycle(spark, sf_dir).filter("final_status IS NOT NULL").withColumnRenamed("o_orderkey", "order_id")
    payments = order_payments(spark, sf_dir).withColumnRenamed("l_orderkey", "order_id")
    reviews = _reviews(spark, sf_dir).groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("score").alias("review_score"))
    out = assemble(life.join(payments, "order_id"), [reviews], ["order_id"])
    return out.select("order_id", "o_custkey", "final_status", "created_at", "final_event_at", "delivery_days", "is_late", "total_value", "primary_type", "max_installments", "review_score", sentiment("review_score").alias("sentiment"))


@query("seller_performance", _LIFE + f""", {_REVIEWS},
    i AS (SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem),
    v AS (SELECT l_orderkey, avg(score) AS avg_score FROM r GROUP BY 1),
    f AS (SELECT l_suppkey, i.l_orderkey, sum(cast(l_extendedprice AS DECIMAL(18,2))) AS revenue, count(*) AS items, max(CASE WHEN final_status = 'F' THEN delivery_days END) AS days,
                 bool_or(coalesce(is_late AND final_status = 'F', false)) AS late, max(avg_score) AS score
          FROM i LEFT JOIN life ON o_orderkey = i.l_orderkey LEFT JOIN v ON v.l_orderkey = i.l_orderkey GROUP BY 1, 2)
    SELECT l_suppkey AS seller_id, count(*) AS total_orders, cast(sum(revenue) AS DOUBLE) AS total_revenue, cast(sum(revenue) AS DOUBLE) / sum(items) AS avg_item_price,
           round(avg(days), 4) AS avg_delivery_days, round(count(*) FILTER (WHERE late) * 100.0 / count(*), 4) AS late_rate_pct, round(avg(score), 4) AS avg_review_score
    FROM f GROUP BY 1
""")  # fmt: skip
def seller_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A4, J4] One row a seller; late and review figures are taken once an order, so a rate can't exceed 100 %."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("seller_id"), "l_extendedprice")
    life = order_lifecycle(spark, sf_dir).filter("final_status = 'F'").select(F.col("o_orderkey").alias("order_id"), "delivery_days", "is_late")
    reviews = _reviews(spark, sf_dir).groupBy(F.col("l_orderkey").alias("order_id")).agg(F.avg("score").alias("score"))
    per_order = items.groupBy("seller_id", "order_id").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"), F.count(F.lit(1)).alias("items"))
    joined = assemble(per_order, [life, reviews], ["order_id"])
    return joined.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total_orders"), F.sum("revenue").cast("double").alias("total_revenue"),
        (F.sum("revenue").cast("double") / F.sum("items")).alias("avg_item_price"), F.round(F.avg("delivery_days"), 4).alias("avg_delivery_days"),
        F.round(F.count_if("is_late") * 100.0 / F.count(F.lit(1)), 4).alias("late_rate_pct"), F.round(F.avg("score"), 4).alias("avg_review_score"),
    )


@query("category_month_revenue", """
    SELECT coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'unknown') AS category, strftime(o_orderdate, '%Y-%m') AS order_month, count(DISTINCT o_orderkey) AS total_orders, count(*) AS total_units,
           cast(sum(l_linenumber) AS BIGINT) AS item_number_sum, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2
""")  # fmt: skip
def category_month_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A5, J5] Finished orders only; products without a category are 'unknown'."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", year_month("o_orderdate").alias("order_month"))
    rows = items.count()  # footers only
    items, parts = dealt(rows, (items, "l_partkey"), (parts, "p_partkey"))
    items, orders = dealt(rows, (items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left"), "l_orderkey"), (orders, "o_orderkey"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.coalesce("p_brand", F.lit("unknown")).alias("category"), "order_month").agg(
        F.count_distinct("o_orderkey").alias("total_orders"), F.count(F.lit(1)).alias("total_units"), F.sum("l_linenumber").alias("item_number_sum"), total("l_extendedprice").alias("total_revenue")
    )

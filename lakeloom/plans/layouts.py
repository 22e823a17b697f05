"""Mergeable distinct counts, layouts and drifting payloads over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distinct as D
from ..sources import layout as L
from ..streaming import windows as W
from .base import ntz, query, table, total
from .streams import event_stream, work_folder

_LISTENS = "events, (SELECT max(ts) AS last FROM events) WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= last - INTERVAL 60 SECOND"


@query("stream_sketches", f"""
    SELECT cast(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS stream_count, count(DISTINCT user_id) AS users, count(DISTINCT event_id % 500) AS tracks, true AS users_within, true AS tracks_within FROM {_LISTENS} GROUP BY 1, 2
""")  # fmt: skip
def stream_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M3, M4, A24] Hourly windows of a stream with two sketches each, stored, then united to days; whether both are within their error of the exact counts."""
    folder = work_folder(spark)
    measures = {"stream_count": F.count(F.lit(1)), "mean_value": F.avg("value"), **D.sketches({"users": "user_id", "tracks": F.col("event_id") % 500})}
    hours = W.tumbling(event_stream(spark, sf_dir), "ts", "1 hour", ["event_type"], measures, "60 seconds")
    W.start(hours, "parquet", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.schema(hours.schema).parquet(f"{folder}/out").withColumn("day", ntz(F.date_trunc("day", "window_start")))
    days = D.united(stored, ["day", "event_type"], ["users", "tracks"], ["stream_count"])
    events = table(spark, sf_dir, "events")
    closed = stored.select(ntz("window_start").alias("hour"), "event_type")
    rows = events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).join(closed, ["hour", "event_type"], "left_semi")
    exact = rows.groupBy(ntz(F.date_trunc("day", "ts")).alias("day"), "event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.col("event_id") % 500).alias("n_tracks"))
    return days.join(exact, ["day", "event_type"]).select(
        "day", "event_type", "stream_count", F.col("n_users").alias("users"), F.col("n_tracks").alias("tracks"),
        D.within("users", "n_users").alias("users_within"), D.within("tracks", "n_tracks").alias("tracks_within"),
    )


@query("users_from_bitmaps", """
    SELECT 'day' AS grain, cast(date_trunc('day', ts) AS TIMESTAMP) AS since, count(DISTINCT user_id) AS users, count(*) AS rows FROM events GROUP BY 2
    UNION ALL SELECT 'week', cast(date_trunc('week', ts) AS TIMESTAMP), count(DISTINCT user_id), count(*) FROM events GROUP BY 2
""")  # fmt: skip
def users_from_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A18, A20] Exact distinct users of days and weeks from stored hourly bitmaps; the rows are read once."""
    folder, events = work_folder(spark), table(spark, sf_dir, "events")
    hours = D.bitmaps(events, [ntz(F.date_trunc("hour", "ts")).alias("hour")], "user_id", "users")
    hours.write.parquet(f"{folder}/hours")
    stored = spark.read.schema(hours.schema).parquet(f"{folder}/hours")
    days = D.united_bitmaps(stored, [ntz(F.date_trunc("day", "hour")).alias("since")], "users")
    weeks = D.united_bitmaps(days, [ntz(F.date_trunc("week", "since")).alias("since")], "users")
    one = lambda grain, df: D.distinct_of(df, ["since"], "users", "users").select(F.lit(grain).alias("grain"), "since", "users", "rows")
    return one("day", days).unionByName(one("week", weeks))


@query("country_users_from_bitmaps", """
    SELECT strftime(ts, '%Y-%m-%d') AS metric_date, coalesce(n_name, 'unknown') AS user_country, count(*) AS stream_count, count(DISTINCT user_id) AS unique_users
    FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2
""")  # fmt: skip
def country_users_from_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A20] Countries by day from bitmaps by hour and country."""
    users = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), "n_name")
    joined = table(spark, sf_dir, "events").join(users, "user_id", "left").withColumn("user_country", F.coalesce("n_name", F.lit("unknown")))
    hours = D.bitmaps(joined, [F.date_trunc("hour", "ts").alias("hour"), "user_country"], "user_id")
    days = D.united_bitmaps(hours, [F.date_format("hour", "yyyy-MM-dd").alias("metric_date"), "user_country"])
    return D.distinct_of(days, ["metric_date", "user_country"], as_name="unique_users").withColumnRenamed("rows", "stream_count")


@query("interleaved_orders", """
    SELECT 'custkey' AS filter, o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 40 UNION ALL SELECT 'date', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'
""")  # fmt: skip
def interleaved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[C18] Orders along a curve through customer and date: ranges of either read few row groups (a test counts them)."""
    path, orders = f"{work_folder(spark)}/orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    L.write_interleaved(orders, path, ["o_custkey", "o_orderdate"], 8)
    stored = spark.read.schema(orders.schema).parquet(path)
    dates = (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1995-04-01").cast("timestamp_ntz"))
    one = lambda name, rows: stored.filter(rows).select(F.lit(name).alias("filter"), "o_orderkey")
    return one("custkey", F.col("o_custkey").between(10, 40)).unionByName(one("date", dates))


@query("bucketed_fulfilment", """
    WITH i AS (SELECT l_orderkey, count(*) AS items, cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS order_key, o_orderstatus, items, revenue FROM orders LEFT JOIN i ON l_orderkey = o_orderkey
""")  # fmt: skip
def bucketed_fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J10, J3] Orders and aggregated items of tables bucketed on the order: grouped and joined without a shuffle."""
    folder, tag = work_folder(spark), uuid.uuid4().hex[:12]
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_extendedprice")
    o, i = (L.write_bucketed(df, f"{name}_{tag}", f"{folder}/{name}", ["order_key"], 8) for df, name in ((orders, "orders"), (items, "items")))
    per_order = i.groupBy("order_key").agg(F.count(F.lit(1)).alias("items"), total("l_extendedprice").alias("revenue"))
    return L.join_bucketed(o, [per_order], ["order_key"])


@query("drifting_payloads", """
    SELECT event_id AS id, CASE WHEN event_id % 3 < 2 THEN user_id END AS user_id, CASE WHEN event_id % 3 = 1 THEN event_type END AS user_kind, CASE WHEN event_id % 3 = 1 THEN value END AS value,
           CASE WHEN event_id % 3 = 2 THEN '["' || event_type || '",' || event_id % 10 || ']' END AS tags
    FROM events
""")  # fmt: skip
def drifting_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S19, C14, X16] JSON payloads of three shapes, their common schema found by aggregation, as columns."""
    one = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id")).alias("user")))
    two = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("user"), "value"))
    three = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "tags": ["'), "event_type", F.lit('", '), (F.col("event_id") % 10).cast("string"), F.lit("]}"))
    shape = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, two).otherwise(three)
    out = L.drifting(table(spark, sf_dir, "events").select(shape.alias("payload")), "payload")
    return out.select("id", "user_id", "user_kind", F.col("value").cast("double").alias("value"), "tags")

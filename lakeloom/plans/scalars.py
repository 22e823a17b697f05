"""The scalar functions over whole tables, and sources that derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.files import bronze, dataset_of, flatten, known_columns, status_views, tagged
from .base import ntz, query, table


@query("time_of_day", """
    SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 'morning_rush' WHEN hour(ts) BETWEEN 10 AND 15 THEN 'midday' WHEN hour(ts) BETWEEN 16 AND 19 THEN 'evening_rush' WHEN hour(ts) BETWEEN 20 AND 22 THEN 'evening' ELSE 'overnight' END AS part,
           cast(dayofweek(ts) + 1 AS INTEGER) AS weekday, dayname(ts) AS day_name, strftime(ts, '%Y-%m') AS year_month, cast(quarter(ts) AS INTEGER) AS quarter, strftime(ts, '%Y-%m-%d') AS day
    FROM events
""")  # fmt: skip
def time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X6, X10, X12]"""
    return table(spark, sf_dir, "events").select("event_id", C.day_part(F.hour("ts")).alias("part"), C.weekday_number("ts").alias("weekday"), C.weekday_name("ts").alias("day_name"), C.year_month("ts").alias("year_month"), F.quarter("ts").alias("quarter"), F.to_date("ts").cast("string").alias("day"))


@query("safe_ratios", "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value / (event_id % 3) END, 6) AS ratio, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / (event_id % 3), 6) END AS ratio_or_null FROM events")
def safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X7, X15]"""
    den = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", F.round(C.safe_divide("value", den), 6).alias("ratio"), F.round(C.safe_divide("value", den, None), 6).alias("ratio_or_null"))


@query("row_keys", """
    SELECT o_orderkey, md5(cast(o_custkey AS VARCHAR) || '-' || o_orderstatus) AS surrogate, sha256(cast(o_orderkey AS VARCHAR) || '||' || o_orderpriority) AS event_key, 'orders_' || substr(sha1(o_orderpriority), 1, 10) AS short
    FROM orders
""")  # fmt: skip
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X8, X9]"""
    return table(spark, sf_dir, "orders").select("o_orderkey", C.surrogate_key("o_custkey", "o_orderstatus").alias("surrogate"), C.event_key("o_orderkey", "o_orderpriority").alias("event_key"), C.short_name("orders", "o_orderpriority").alias("short"))


@query("text_functions", """
    SELECT c_custkey, lower(trim(' ' || c_mktsegment || ' ')) AS normal, nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, '') AS name, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
           substr(c_name, 1, 8) AS head, string_split(c_name, '#')[1] AS prefix, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS word, abs(c_acctbal) AS size
    FROM customer
""")  # fmt: skip
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X13, X14, X15]"""
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", C.normal_text(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("normal"), C.blank_to_null(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))).alias("name"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"), F.substring("c_name", 1, 8).alias("head"), F.get(F.split("c_name", "#"), F.lit(0)).alias("prefix"),
        F.when(n == 0, "zero").when(n == 1, "one").otherwise("more").alias("word"), F.abs("c_acctbal").alias("size"),
    )


@query("payload_decode", """
    SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'k' ELSE '' END AS missing FROM events
""")  # fmt: skip
def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S20, S21, X16] JSON payloads as bytes and as Base64 text, with the names of missing fields."""
    events = table(spark, sf_dir, "events")
    coded = events.select("event_id", C.decode_base64_json(F.base64(F.col("props").cast("binary")), "k long").alias("x"))
    return coded.select("event_id", "x.k", F.array_join(C.missing_fields("x", ["k"]), ",").alias("missing"))


@query("json_flatten", "SELECT l_orderkey AS order_id, cast(l_linenumber AS VARCHAR) AS line, coalesce(cast(nullif(l_returnflag, 'N') AS VARCHAR), '') AS flag FROM lineitem")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S19, X19] Nested items of an order, flattened to text rows, missing values ''."""
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_list(F.struct("l_linenumber", F.struct(F.nullif("l_returnflag", F.lit("N")).alias("flag")).alias("detail"))).alias("items"))
    return flatten(nested, "items", {"line": "l_linenumber", "flag": "detail.flag"}, ["order_id"])


@query("bronze_events", "SELECT event_id, event_type, TIMESTAMP '2024-02-01' AS _ingested_at, 'events' AS source_name, 'run-7' AS run_id FROM events")
def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S2, S5, S11] Ingest time and metadata on a scan."""
    rows = bronze(table(spark, sf_dir, "events"), ntz(F.lit("2024-02-01")), file_name=False)
    return tagged(rows, source_name="events", run_id="run-7").select("event_id", "event_type", "_ingested_at", "source_name", "run_id")


@query("status_views", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def order_status_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S3] One view for each status, counted."""
    views = status_views(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"])
    parts = [v.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")) for v in views.values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("monthly_load", "SELECT o_orderkey AS trip_id, o_totalprice AS total, TIMESTAMP '2024-02-01' AS _loaded_at, '2024-01' AS _source_month FROM orders")
def monthly_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S9] Known columns only, renamed."""
    return known_columns(table(spark, sf_dir, "orders"), {"o_orderkey": "trip_id", "o_totalprice": "total", "absent": "x"}, "2024-01", ntz(F.lit("2024-02-01")))


@query("dataset_routes", """
    SELECT event_type || '_' || cast(event_id % 9 AS VARCHAR) || '.csv' AS file, CASE WHEN event_type = 'signup' THEN 'users' WHEN event_type IN ('view', 'click') THEN 'streams' END AS dataset, count(*) AS n FROM events GROUP BY 1, 2
""")  # fmt: skip
def dataset_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S14] Files routed to datasets by the prefix of their name."""
    files = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_"), (F.col("event_id") % 9).cast("string"), F.lit(".csv")).alias("file"))
    return files.groupBy("file", dataset_of("file", {"signup": "users", "view": "streams", "click": "streams"}).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))

"""Streams of songs; events are listens, parts are tracks, customers are users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, clean_number, clip, event_key, in_range_or_null, title
from ..operators.history import aligned_text
from ..operators.joins import join_latest
from ..operators.rows import duplicate_flag, ranked
from .base import query, table


def _listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns as in a curated layer; every seventh user is blank."""
    events = table(spark, sf_dir, "events")
    user = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string"))
    return events.select("event_id", "ts", user.alias("user_id"), (F.col("event_id") % 50 + 1).cast("string").alias("track_id"))


_LISTENS = "WITH l AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN '' ELSE cast(user_id AS VARCHAR) END AS user_id, cast(event_id % 50 + 1 AS VARCHAR) AS track_id FROM events)"


@query("daily_stream_metrics", _LISTENS + "SELECT strftime(ts, '%Y-%m-%d') AS metric_date, count(*) AS total_streams, count(DISTINCT nullif(user_id, '')) AS unique_users, count(DISTINCT nullif(track_id, '')) AS unique_tracks FROM l GROUP BY 1")
def daily_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A18]"""
    return _listens(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("total_streams"), F.count_distinct(blank_to_null("user_id")).alias("unique_users"), F.count_distinct(blank_to_null("track_id")).alias("unique_tracks")
    )


@query("daily_top_tracks", _LISTENS + """,
    d AS (SELECT strftime(ts, '%Y-%m-%d') AS metric_date, track_id, count(*) AS stream_count FROM l GROUP BY 1, 2),
    s AS (SELECT * FROM (SELECT cast(p_size AS VARCHAR) AS track_id, p_name, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part) WHERE rn = 1)
    SELECT metric_date, d.track_id, coalesce(p_name, 'unknown') AS track_name, stream_count, cast(row_number() OVER (PARTITION BY metric_date ORDER BY stream_count DESC, d.track_id) AS INTEGER) AS rank_in_day
    FROM d LEFT JOIN s ON s.track_id = d.track_id QUALIFY rank_in_day <= 10
""")  # fmt: skip
def daily_top_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A19, J16, W3, W10] Each day's top ten with the latest names."""
    counts = _listens(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("metric_date"), "track_id").agg(F.count(F.lit(1)).alias("stream_count"))
    top = ranked(counts, ["metric_date"], [F.desc("stream_count"), F.asc("track_id")], "rank_in_day", 10)
    songs = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("track_id"), "p_name", "p_retailprice", "p_partkey")
    named = join_latest(top, songs, "track_id", [F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")])
    return named.select("metric_date", "track_id", F.coalesce("p_name", F.lit("unknown")).alias("track_name"), "stream_count", "rank_in_day")


@query("country_streams_daily", _LISTENS + """
    SELECT strftime(ts, '%Y-%m-%d') AS metric_date, coalesce(n_name, 'unknown') AS user_country, count(*) AS stream_count, count(DISTINCT l.user_id) AS unique_users
    FROM l LEFT JOIN customer ON cast(c_custkey AS VARCHAR) = l.user_id LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2
""")  # fmt: skip
def country_streams_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A20]"""
    users = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("user_id"), "n_name")
    joined = _listens(spark, sf_dir).join(users, "user_id", "left")
    return joined.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("metric_date"), F.coalesce("n_name", F.lit("unknown")).alias("user_country")).agg(F.count(F.lit(1)).alias("stream_count"), F.count_distinct("user_id").alias("unique_users"))


@query("listeners_within_error", """
    SELECT cast(event_id % 50 + 1 AS VARCHAR) AS track_id, count(DISTINCT CASE WHEN event_id % 7 = 0 THEN '' ELSE cast(user_id AS VARCHAR) END) AS listeners, true AS within FROM events GROUP BY 1
""")  # fmt: skip
def listeners_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A24] Exact listeners, and whether the approximate count at a relative deviation of 5 % is within three of these (or one listener)."""
    counts = _listens(spark, sf_dir).groupBy("track_id").agg(F.count_distinct("user_id").alias("listeners"), F.approx_count_distinct("user_id", 0.05).alias("near"))
    return counts.select("track_id", "listeners", (F.abs(F.col("near") - F.col("listeners")) <= F.greatest(F.lit(1.0), F.col("listeners") * 0.15)).alias("within"))


@query("approximate_listeners")
def approximate_listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A24] Approximate distinct counts; tests hold them against exact ones."""
    return _listens(spark, sf_dir).groupBy("track_id").agg(F.approx_count_distinct("user_id").alias("listeners"))


@query("songs_normalised", """
    SELECT p_partkey, least(greatest(p_retailprice - 950, 0), 100) AS popularity, round_even(p_retailprice / 1000, 1) AS duration_s, p_type,
           array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS artists
    FROM part
""")  # fmt: skip
def songs_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P12]"""
    return table(spark, sf_dir, "part").select("p_partkey", clip(F.col("p_retailprice") - 950, 0.0, 100.0).alias("popularity"), F.bround(F.col("p_retailprice") / 1000, 1).alias("duration_s"), "p_type", title("p_name").alias("artists"))


@query("users_normalised", """
    SELECT c_custkey, CASE WHEN c_acctbal / 50 BETWEEN 13 AND 120 THEN c_acctbal / 50 END AS user_age, upper(c_name) AS user_country,
           CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN lower(c_mktsegment) ELSE 'unknown' END AS tier
    FROM customer
""")  # fmt: skip
def users_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P13]"""
    tier = F.lower("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", in_range_or_null(F.col("c_acctbal") / 50, 13, 120).alias("user_age"), F.upper("c_name").alias("user_country"),
        F.when(tier.isin("building", "machinery"), tier).otherwise("unknown").alias("tier"),
    )


@query("streams_keyed", """
    SELECT *, row_number() OVER (PARTITION BY stream_event_id ORDER BY event_id) > 1 AS is_duplicate FROM (
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:00:00') AS listen_time, coalesce(try_cast(try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS BIGINT), 0) AS play_count,
               sha256(cast(user_id AS VARCHAR) || '||' || event_type || '||' || strftime(ts, '%Y-%m-%d %H:00:00')) AS stream_event_id FROM events)
""")  # fmt: skip
def streams_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P14, X9, X16, W11] Canonical time, default counts, deterministic id, duplicate flag."""
    events = table(spark, sf_dir, "events")
    listened = F.date_format("ts", "yyyy-MM-dd HH:00:00")
    made = events.select(
        "event_id", listened.alias("listen_time"), F.coalesce(clean_number(F.get_json_object("props", "$.k"), "bigint"), F.lit(0).cast("long")).alias("play_count"),
        event_key("user_id", "event_type", listened).alias("stream_event_id"),
    )
    return duplicate_flag(made, ["stream_event_id"], [F.asc("event_id")])


@query("curated_text", "SELECT cast(c_acctbal AS VARCHAR) AS c_acctbal, cast(c_custkey AS VARCHAR) AS c_custkey, trim(c_mktsegment) AS c_mktsegment, c_name, cast(c_nationkey AS VARCHAR) AS c_nationkey, cast(NULL AS VARCHAR) AS genre, 'run-1' AS run_id FROM customer")
def curated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P15, C14] All columns as text, aligned with a stored schema that has one more."""
    df = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.trim("c_mktsegment")).withColumn("run_id", F.lit("run-1"))
    return aligned_text(df, ["c_custkey", "genre"], ["run_id"])

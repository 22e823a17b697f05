"""Trips: events stand for completed trips, (event_type, user_id) for a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hour_parts, safe_divide
from ..operators.joins import lifecycle
from ..operators.rows import first_rows, ranked
from ..sources.files import affected_hours, after_mark, closed_window, next_mark, pending
from .base import ntz, query, table, total


def completed(trips: DataFrame) -> DataFrame:
    """[P16, W1] Valid trips, the latest row of each id."""
    valid = trips.filter(F.col("event_type").isNotNull() & F.col("user_id").isNotNull() & F.col("ts").isNotNull() & (F.col("event_type") != "error"))
    return first_rows(valid, ["event_id"], [F.desc_nulls_last("ts"), F.desc_nulls_last("value"), F.asc("user_id")])


def hourly_routes(trips: DataFrame) -> DataFrame:
    """[A6] Trips and sums of each hour and route."""
    by_hour = completed(trips).withColumn("event_hour", ntz(F.date_trunc("hour", "ts")))
    out = by_hour.groupBy("event_hour", "event_type", "user_id").agg(F.count(F.lit(1)).alias("trip_count"), total("value").alias("fare_sum"))
    return out.withColumns(hour_parts("event_hour"))


def top_routes(trips: DataFrame, n: int = 3) -> DataFrame:
    """[W3, P18] The busiest routes of each hour, with ratios."""
    top = ranked(hourly_routes(trips), ["event_hour"], [F.desc("trip_count"), F.desc("fare_sum"), F.asc("event_type"), F.asc("user_id")], "route_rank", max(n, 0))
    return top.withColumn("avg_fare", F.round(safe_divide("fare_sum", "trip_count"), 6)).drop("year", "month", "day", "hour")


_HOURLY = """
    WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC NULLS LAST, value DESC NULLS LAST, user_id) AS rn
                              FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND event_type <> 'error') WHERE rn = 1),
    h AS (SELECT date_trunc('hour', ts) AS event_hour, event_type, user_id, count(*) AS trip_count, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS fare_sum
          FROM d GROUP BY 1, 2, 3)
"""


@query("top_routes_per_hour", _HOURLY + """
    SELECT event_hour, event_type, user_id, trip_count, fare_sum, cast(rn AS INTEGER) AS route_rank, round(CASE WHEN trip_count = 0 THEN 0 ELSE fare_sum / trip_count END, 6) AS avg_fare
    FROM (SELECT *, row_number() OVER (PARTITION BY event_hour ORDER BY trip_count DESC, fare_sum DESC, event_type, user_id) AS rn FROM h) WHERE rn <= 3
""")  # fmt: skip
def top_routes_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_routes(table(spark, sf_dir, "events"))


@query("hourly_route_metrics", _HOURLY + """
    SELECT *, strftime(event_hour, '%Y') AS year, strftime(event_hour, '%m') AS month, strftime(event_hour, '%d') AS day, strftime(event_hour, '%H') AS hour FROM h
""")  # fmt: skip
def hourly_route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_routes(table(spark, sf_dir, "events"))


@query("hour_totals", _HOURLY + "SELECT event_hour, cast(sum(trip_count) AS BIGINT) AS trips FROM h GROUP BY 1")
def hour_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A21]"""
    return hourly_routes(table(spark, sf_dir, "events")).groupBy("event_hour").agg(F.sum("trip_count").alias("trips"))


@query("top_pairs_by_fare", _HOURLY + """
    SELECT event_type, user_id, cast(sum(cast(fare_sum AS DECIMAL(18,2))) AS DOUBLE) AS fare, cast(sum(trip_count) AS BIGINT) AS trips
    FROM h GROUP BY 1, 2 ORDER BY fare DESC, event_type, user_id LIMIT 20
""")  # fmt: skip
def top_pairs_by_fare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A21, T1, T3] The feature is a top-20."""
    out = hourly_routes(table(spark, sf_dir, "events")).groupBy("event_type", "user_id").agg(total("fare_sum").alias("fare"), F.sum("trip_count").alias("trips"))
    return out.orderBy(F.desc("fare"), "event_type", "user_id").limit(20)


@query("run_summary", _HOURLY + "SELECT count(DISTINCT event_hour) AS affected_hours, count(*) AS metric_rows FROM h")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A27]"""
    return hourly_routes(table(spark, sf_dir, "events")).agg(F.count_distinct("event_hour").alias("affected_hours"), F.count(F.lit(1)).alias("metric_rows"))


@query("trip_lifecycle", """
    WITH s AS (SELECT user_id, min(ts) AS started_at FROM events WHERE event_type = 'signup' GROUP BY 1),
    e AS (SELECT event_id, user_id, ts AS ended_at, value FROM events WHERE event_type = 'purchase')
    SELECT e.user_id, event_id, ended_at, value, started_at,
           CASE WHEN started_at <= ended_at THEN 'ok' ELSE 'missing_start' END AS data_quality,
           CASE WHEN started_at <= ended_at THEN 'trip_end_update' ELSE 'trip_end_upsert' END AS record_source
    FROM e LEFT JOIN s ON e.user_id = s.user_id
""")  # fmt: skip
def trip_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J12] In order of arrival: a start after the end doesn't count."""
    events = table(spark, sf_dir, "events")
    starts = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("started_at"))
    starts = starts.withColumn("at", F.col("started_at"))
    ends = events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("ended_at"), "value", F.col("ts").alias("at"))
    return lifecycle(starts, ends, "user_id", received="at").drop("at")


@query("completed_trip_events", """
    WITH s AS (SELECT user_id, min(ts) AS started_at FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_id, e.user_id, started_at, ts AS ended_at, round(value, 2) AS fare
    FROM events e JOIN s ON e.user_id = s.user_id WHERE event_type = 'purchase'
""")  # fmt: skip
def completed_trip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P17] Compact events of ends that have a start."""
    events = table(spark, sf_dir, "events")
    starts = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("started_at"))
    ends = events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("ended_at"), F.round("value", 2).alias("fare"))
    return lifecycle(starts, ends, "user_id").filter("data_quality = 'ok'").select("event_id", "user_id", "started_at", "ended_at", "fare")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that events would make: one file for each hour and type, modified with its last event."""
    parts = hour_parts("ts")
    path = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()], F.concat("event_type", F.lit(".json")))
    return table(spark, sf_dir, "events").groupBy(path.alias("path")).agg(F.max(F.col("ts").cast("timestamp")).alias("modified"))


_FILES = "WITH f AS (SELECT strftime(ts, 'year=%Y/month=%m/day=%d/hour=%H/') || event_type || '.json' AS path, max(ts) AS modified FROM events GROUP BY 1)"


@query("files_after_mark", _FILES + "SELECT path, modified FROM f WHERE modified > TIMESTAMP '2024-01-15 12:00:00' OR (modified = TIMESTAMP '2024-01-15 12:00:00' AND path > 'year=2024')")
def files_after_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S16]"""
    return after_mark(_files(spark, sf_dir), "modified", "path", ("2024-01-15 12:00:00", "year=2024")).select("path", ntz("modified").alias("modified"))


@query("next_mark", _FILES + "SELECT modified AS last_modified, path AS last_key, (SELECT count(*) FROM f) AS processed FROM f ORDER BY modified DESC, path DESC LIMIT 1")
def next_high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S16]"""
    return next_mark(_files(spark, sf_dir), "modified", "path").select(ntz("last_modified").alias("last_modified"), "last_key", "processed")


@query("pending_files", _FILES + "SELECT path FROM f WHERE path NOT LIKE '%click%'")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S15, U4] The manifest holds the files of clicks."""
    files = _files(spark, sf_dir)
    return pending(files, files.filter(F.col("path").contains("click"))).select("path")


@query("affected_hours", """
    SELECT date_trunc('hour', ts) AS hour, count(DISTINCT event_type) AS files, epoch(TIMESTAMP '2024-01-20 15:30:00' - date_trunc('hour', ts)) / 60.0 - 60 <= 1440 AS in_time
    FROM events GROUP BY 1
""")  # fmt: skip
def hours_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S18, X17, M8]"""
    now = F.lit("2024-01-20 15:30:00").cast("timestamp")
    return affected_hours(_files(spark, sf_dir), "path", now, 1440).select(ntz("hour").alias("hour"), "files", "in_time")


@query("closed_hour_rows", """
    SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events
    WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-20 15:00:00' - INTERVAL 25 HOUR AND date_trunc('hour', ts) < TIMESTAMP '2024-01-20 15:00:00' GROUP BY 1
""")  # fmt: skip
def closed_hour_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S17, S8] Events of the closed hours of a window of a day."""
    first, end = closed_window(F.lit("2024-01-20 15:30:00").cast("timestamp"), 1440)
    events = table(spark, sf_dir, "events").filter((F.col("ts") >= ntz(first)) & (F.col("ts") < ntz(end)))
    return events.groupBy(ntz(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))

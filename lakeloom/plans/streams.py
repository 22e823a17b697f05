"""Streaming queries, run to the end over the files of ``events``; their results are read back from the sink.

The files of a table are one batch, after which the watermark is the last event time less the delay; the SQL leaves out what it still holds back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lifecycle
from ..streaming import windows as W
from .base import query, table


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one only where that is unset on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base}/streams-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(df: DataFrame) -> DataFrame:
    """The rows that the query has put out once all files are read."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession)
    W.start(df, "parquet", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


_CLOSED = "date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL {} SECOND"


@query("stream_windows", f"""
    SELECT cast(date_trunc('day', ts) AS TIMESTAMP) AS window_start, cast(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, user_id, event_type, count(*) AS stream_count, max(ts) AS last_event
    FROM events WHERE {_CLOSED.format(30)} GROUP BY 1, 2, 3, 4
""")  # fmt: skip
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S1, M1, M2, M5, M6] Counts and last event of each day, user and type."""
    measures = {"stream_count": F.count(F.lit(1)), "last_event": F.max("ts")}
    return _plain(run_to_end(W.tumbling(event_stream(spark, sf_dir), "ts", "1 day", ["user_id", "event_type"], measures, "30 seconds")))


@query("stream_top_types")
def stream_top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M3, M4, A24] Approximate listeners of each day and type."""
    measures = {"stream_count": F.count(F.lit(1)), "listeners": F.approx_count_distinct("user_id"), "mean_value": F.round(F.avg("value"), 4)}
    return _plain(run_to_end(W.tumbling(event_stream(spark, sf_dir), "ts", "1 day", ["event_type"], measures, "60 seconds")))


@query("stream_dimensions", "SELECT event_id, ts, user_id, n_name FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey")
def stream_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J15] A stream enriched with two static dimensions."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = W.enrich(event_stream(spark, sf_dir), (users, "user_id"), (nations, "c_nationkey"))
    return _plain(run_to_end(out.select("event_id", "ts", "user_id", "n_name")))


@query("stream_interval_join", """
    WITH s AS (SELECT user_id, event_id AS start_id, ts AS start_at FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, event_id AS end_id, ts AS end_at FROM events WHERE event_type = 'purchase'),
    j AS (SELECT s.*, end_id, end_at FROM s LEFT JOIN e ON e.user_id = s.user_id AND end_at >= start_at AND end_at <= start_at + INTERVAL 2 DAY)
    SELECT * FROM j WHERE end_id IS NOT NULL OR start_at + INTERVAL 2 DAY < (SELECT least((SELECT max(start_at) FROM s), (SELECT max(end_at) FROM e))) - INTERVAL 2 DAY
""")  # fmt: skip
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J1, M1] Each signup with the user's purchases of the next two days; without one, once the watermark has passed."""
    events = event_stream(spark, sf_dir)
    starts = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), F.col("ts").alias("start_at"))
    ends = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("end_id"), F.col("ts").alias("end_at"))
    return _plain(run_to_end(W.order_lifecycle(starts, ends, "user_id", "start_at", "end_at", "2 days")))


@query("stream_fan_out", f"""
    SELECT 'by_user' AS name, count(*) AS n FROM (SELECT DISTINCT date_trunc('day', ts), user_id FROM events WHERE {_CLOSED.format(30)})
    UNION ALL SELECT 'by_type', count(*) FROM (SELECT DISTINCT date_trunc('day', ts), event_type FROM events WHERE {_CLOSED.format(30)}) UNION ALL SELECT 'rows', count(*) FROM events
""")  # fmt: skip
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M7] One source, three queries with checkpoints of their own; row counts of their outputs."""
    folder, events = work_folder(spark), event_stream(spark, sf_dir)
    count = {"n": F.count(F.lit(1))}
    frames = {name: W.tumbling(events, "ts", "1 day", [key], count, "30 seconds") for name, key in (("by_user", "user_id"), ("by_type", "event_type"))}
    frames["rows"] = events.select("event_id")
    for q in W.fan_out(frames, f"{folder}/out", f"{folder}/checkpoint"):
        q.awaitTermination()
    parts = [spark.read.schema(df.schema).parquet(f"{folder}/out/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_scd1", "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[M10, C2] Changes of a stream merged into a type 1 table, a new snapshot for each batch."""
    folder = work_folder(spark)
    at: list[str] = []

    def store(df: DataFrame) -> None:
        path = f"{folder}/snapshot-{len(at)}"
        df.write.mode("overwrite").parquet(path)
        at.append(path)

    changes = event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    sink = W.change_sink(lambda: spark.read.parquet(at[-1]) if at else None, store, ["user_id"], ["ts", "event_id"])
    changes.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _plain(spark.read.parquet(at[-1]) if at else spark.createDataFrame([], changes.schema))


@query("batch_lifecycle", """
    SELECT b.event_id AS end_id, b.user_id, a.event_id AS start_id, CASE WHEN a.event_id IS NULL THEN 'missing_start' ELSE 'ok' END AS data_quality, CASE WHEN a.event_id IS NULL THEN 'trip_end_upsert' ELSE 'trip_end_update' END AS record_source
    FROM events b LEFT JOIN events a ON a.user_id = b.user_id AND a.event_type = 'signup' AND a.event_id % 2 = 0 WHERE b.event_type = 'error'
""")  # fmt: skip
def batch_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J12] Any order of arrival: a start counts if it exists at all."""
    events = table(spark, sf_dir, "events")
    starts = events.filter("event_type = 'signup' AND event_id % 2 = 0").select("user_id", F.col("event_id").alias("start_id"))
    ends = events.filter("event_type = 'error'").select(F.col("event_id").alias("end_id"), "user_id")
    return lifecycle(starts, ends, "user_id")
